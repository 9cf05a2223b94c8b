"""Language ID by multilingual mixture inference.

A document is a mixture: each of its words comes from one of the learned
languages, in unknown proportions. A word's likelihood in a language is that of
its character trigrams, of which the TRIGRAMS most frequent have an entry of their
own and the others count as the least likely. Expectation-maximisation estimates the
proportions; then languages join the set in the order of their proportions, as long
as the likelihood less a penalty per language grows, up to all of them, and the
document's language is the largest of that set.

Nulls: a null text, or one without a letter, is ``und`` with score 0, as is every
text where nothing could be learned; rows with a null lang or text are not learned
from. Whole texts are read. Ties go to the first language in code-point order.
Repeated rows give repeated rows; other columns and their names don't matter. A null
doc_id counts as the text 'null' for the held-out share. An empty table gives an empty
one. The classifier learns from about TRAIN_DOCS labelled documents, chosen by a hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.textchunk import slices

#: Labelled documents to learn from, about; trigrams kept, the most frequent ones.
TRAIN_DOCS, TRIGRAMS = 40_000, 30_000
#: Rounds of expectation-maximisation over all languages, and for each smaller set.
ROUNDS, SET_ROUNDS = 12, 4
#: Nats that another language must gain, beside half the logarithm of the number of words.
PENALTY = 4.0
MEMORY = 300_000

_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]
    table: np.ndarray  # log-likelihood by trigram and language; the last row: any other trigram


def _grams(word: str) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + 3] for i in range(len(word) - 2)]


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS, trigrams: int = TRIGRAMS) -> Model:
    """Trigram likelihoods by language of rows with text and lang: about train_docs of them, chosen by a hash of doc_id."""
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    share = min(1.0, train_docs / max(1, labelled.count()))
    if share < 1:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(_WORDS(text.lower()))
            rows = []
            for lang, own in found.items():
                grams: Counter = Counter()
                for word, n in own.items():
                    for g in _grams(word):
                        grams[g] += n
                rows += [(lang, g, n) for g, n in grams.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    top = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")).orderBy(F.desc("total"), "gram").limit(trigrams).collect()
    langs = sorted({x["lang"] for row in top for x in row["by"]})
    own = np.zeros((len(top), len(langs)))
    for i, row in enumerate(top):
        for x in row["by"]:
            own[i, langs.index(x["lang"])] = x["n"]
    if not langs:
        return Model([], {}, np.zeros((1, 0), np.float32))
    likely = np.log((own + 0.5) / (own.sum(0) + 0.5 * len(top)))
    return Model(langs, {row["gram"]: i for i, row in enumerate(top)}, np.vstack((likely, np.full(len(langs), likely.min()))).astype(np.float32))


class Words:
    """Log-likelihoods of words, kept from batch to batch."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)

    def likely(self, words: list[str]) -> np.ndarray:
        new = sorted(set(words) - self.at.keys())
        if new and len(self.at) + len(new) > MEMORY:
            self._clear()
            new = sorted(set(words))
        if new:
            other, grams = len(self.model.grams), [_grams(w) for w in new]
            ids = np.fromiter((self.model.grams.get(g, other) for g in chain.from_iterable(grams)), np.int64)
            first = np.concatenate(([0], np.cumsum([len(g) for g in grams])[:-1]))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.rows = np.vstack((self.rows, np.add.reduceat(self.model.table[ids], first, axis=0)))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def _rounds(p: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log-likelihood (less each word's largest) before the last."""
    fit = np.zeros(len(n))
    for _ in range(rounds):
        joint = p * share[doc]
        total = joint.sum(1)
        fit = np.add.reduceat(np.log(np.maximum(total, 1e-30)), first)
        share = np.add.reduceat(joint / np.maximum(total, 1e-30)[:, None], first, axis=0) / n[:, None]
    return share, fit


def infer(likely: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest language of each document's selected set and its proportion. n: words of each document, at least 1."""
    langs = likely.shape[1]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    doc = np.repeat(np.arange(len(n)), n)
    p = np.exp(likely - likely.max(1, keepdims=True)).astype(np.float32)
    share, _ = _rounds(p, doc, first, n, np.full((len(n), langs), 1 / langs, np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen = np.full(len(n), -np.inf), np.zeros_like(share)
    at = np.arange(len(n))  # documents whose set may still grow
    for k in range(1, langs + 1):
        words = np.flatnonzero(np.isin(doc, at)) if len(at) < len(n) else slice(None)
        own_n = n[at]
        own_first = np.concatenate(([0], np.cumsum(own_n)[:-1]))
        held, few = np.zeros((len(at), langs), share.dtype), order[at, :k]
        np.put_along_axis(held, few, np.maximum(np.take_along_axis(share[at], few, 1), 1e-3), 1)
        start = (held / held.sum(1, keepdims=True)).astype(np.float32)
        own, fit = _rounds(p[words], np.repeat(np.arange(len(at)), own_n), own_first, own_n, start, SET_ROUNDS if k > 1 else 1)
        worth = fit - (k - 1) * (PENALTY + 0.5 * np.log(own_n))
        better = worth > best[at]
        best[at[better]], chosen[at[better]] = worth[better], own[better]
        at = at[better]
        if not len(at):
            break
    top = chosen.argmax(1)
    return top, np.clip(chosen[np.arange(len(n)), top], 0, 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, and every other column of docs."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("lang_pred", "score")]
    names = [f.name for f in docs.schema if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model)
        for batch in slices(batches):
            found: list[list[str]] = []
            for text in batch.column("text").to_pylist():
                ws = _WORDS(text.lower()) if text else []
                found.append(ws if any(c.isalpha() for w in ws for c in w) else [])
            n = np.array([len(x) for x in found])
            langs, scores = np.full(len(n), "und", object), np.zeros(len(n))
            real = np.flatnonzero(n)
            if len(real) and model.langs:
                top, score = infer(known.likely(list(chain.from_iterable(found))), n[real])
                langs[real], scores[real] = np.array(model.langs, object)[top], score
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs.tolist(), pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the model learns from those that aren't held out."""
    model = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents with a language; those that are ``und`` go."""
    model = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).filter(F.col("lang_pred") != "und").select(*docs.columns)
