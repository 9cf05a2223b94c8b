"""URL filters: rules first, then host word segmentation and naive Bayes.

Names in hosts and paths are cut into words by Viterbi over unigrams: the counts are those of delimited path
and hyphenated host parts of all urls. A multinomial naive Bayes over the words of host and path decides where
no rule fits. It learns from all urls that a rule fits: the rule's verdict is the label, so the model carries
the policy of the rules over to urls that they don't name.

Counts and totals are over all urls. A word or token with a share of RARE or less of all has no entry of its
own, at whatever size of the table: such words are unknown letters to the segmentation, such tokens count
together as one of their kind. So a model has 1 / RARE entries at most.

Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule; a url without a token
is allowed, as is one with even odds, and every url where no rule fits any. A null page_id is kept. Whole urls
are read, however long, in time linear in their length: words are MAX_WORD letters at most. An empty table
gives an empty one. Repeated rows give repeated rows; other columns don't matter. Of segmentations that tie the
one that ends in the longer word is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.session import staged

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Share of all words, or tokens, that one must exceed to have an entry; letters of a word at most.
RARE, MAX_WORD = 1e-6, 24
SMOOTHING = 0.5
#: Letters of a name that is remembered, names that are.
KEPT_NAME, MEMORY = 64, 100_000
OTHER = "*"
_NAMES = re.compile("[a-z]+").findall


def parts(url: str) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce({url}, ''), instr(coalesce({url}, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for action, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi; an unknown letter costs more than any known word, and runs of them are joined."""

    def __init__(self, counts: dict[str, int], total: int):
        total = max(total, 1)
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, self.cost), default=0)
        self.letter = math.log(total) + 1
        self.seen: dict[str, list[str]] = {}

    def words(self, name: str) -> list[str]:
        if name in self.seen:
            return self.seen[name]
        if len(self.seen) > MEMORY:
            self.seen.clear()
        out = self._cut(name)
        if len(name) <= KEPT_NAME:
            self.seen[name] = out
        return out

    def _cut(self, name: str) -> list[str]:
        best, back = [0.0] + [math.inf] * len(name), [(0, False)] * (len(name) + 1)
        for j in range(1, len(name) + 1):
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(name[i:j])
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, (i, True)
            if best[j - 1] + self.letter < best[j]:
                best[j], back[j] = best[j - 1] + self.letter, (j - 1, False)
        out: list[tuple[str, bool]] = []
        unknown = j = len(name)
        while j:
            i, known = back[j]
            if known or not i or back[i][1]:
                out.append((name[i : j if known else unknown], known))
                unknown = i
            j = i
            if known:
                unknown = i
        return [w for w, _ in reversed(out)]


@dataclass
class Bayes:
    odds: dict[str, float]  # log P(token | block) - log P(token | allow)
    prior: float

    def score(self, tokens: list[str]) -> float:
        """Log odds of block; 0 without tokens."""
        if not tokens or not self.odds:
            return 0.0
        return reduce(lambda s, t: s + self.odds.get(t, self.odds.get(t[:2] + OTHER, 0.0)), tokens, self.prior)


def tokens_of(host: str, path: str, cut: Segmenter) -> list[str]:
    """Words of the host, its last label whole, and of the path."""
    labels = host.split(".")
    own = [w for label in labels[:-1] for name in _NAMES(label) for w in cut.words(name)] + [x for x in labels[-1:] if x]
    return [f"h:{w}" for w in own] + [f"p:{w}" for name in _NAMES(path.lower()) for w in cut.words(name)]


def learn_words(urls: DataFrame) -> Segmenter:
    """Counts of the delimited words of all urls (host, path) with a share over RARE, and the total of all."""
    hyphened = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    names = F.split(F.concat_ws("/", F.array_join(hyphened, "/"), F.lower("path")), "[^a-z]+")
    counts = urls.select(F.explode(names).alias("w")).filter(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n"))
    counts = staged(counts, "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.filter((F.col("n") > RARE * total) & (F.length("w") <= MAX_WORD))  # 1 / RARE rows at most
    return Segmenter({r["w"]: r["n"] for r in kept.collect()}, total)


def learn(urls: DataFrame, cut: Segmenter) -> Bayes:
    """Token counts by class over all urls (host, path, action: a rule's verdict)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, path, action in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "action")), strict=True):
                found["", action] += 1
                found.update((t, action) for t in tokens_of(host, path, cut))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([a == "block" for _, a in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], ["token", "block", "n"])

    counts = urls.filter("action IS NOT NULL").mapInArrow(count, "token string, block boolean, n long")
    counts = staged(counts.groupBy("token").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("a")), "url-tokens")
    real, both = counts.filter("token <> ''"), F.col("a") + F.col("b")
    total = real.agg(F.sum(both)).first()[0] or 0
    rare = both <= RARE * total
    named = F.when(rare, F.concat(F.substring("token", 1, 2), F.lit(OTHER))).otherwise(F.col("token"))
    rows = {r["t"]: (r["b"], r["a"]) for r in real.groupBy(named.alias("t")).agg(F.sum("b").alias("b"), F.sum("a").alias("a")).collect()}  # 1 / RARE rows at most, and two
    for kind in ("h:", "p:"):
        rows.setdefault(kind + OTHER, (0, 0))
    urls_of = counts.filter("token = ''").first()
    blocked, allowed = (urls_of["b"], urls_of["a"]) if urls_of else (0, 0)
    if not blocked + allowed:
        return Bayes({}, 0.0)
    all_b, all_a, v = sum(b for b, _ in rows.values()), sum(a for _, a in rows.values()), len(rows)
    odds = {t: math.log((b + SMOOTHING) / (all_b + SMOOTHING * v)) - math.log((a + SMOOTHING) / (all_a + SMOOTHING * v)) for t, (b, a) in rows.items()}
    return Bayes(odds, math.log((blocked + SMOOTHING) / (allowed + SMOOTHING)))


SCHEMA = "page_id long, host string, path string, rule string, verdict string, words array<string>, score double"


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score (log odds of block) of every url."""
    host, path = parts("url")
    rule, action = rule_of("host", "path")
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), action.alias("action"))
    cut = learn_words(urls)
    model = learn(urls.select("host", "path", "action"), cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, scores, verdicts = [], [], []
            for h, p, a in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "action")), strict=True):
                tokens = tokens_of(h, p, cut)
                score = model.score(tokens)
                words.append([t[2:] for t in tokens])
                scores.append(score)
                verdicts.append(a or ("block" if score > 0 else "allow"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdicts, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "words", "score"],
            )

    return urls.select("page_id", "host", "path", "rule", "action").mapInArrow(run, SCHEMA)
