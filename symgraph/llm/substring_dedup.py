"""Substring dedup by super-k-mers.

A window is 35 consecutive words of one document. Windows that start one after another
and share a minimiser (the least hash of the 4-word runs in them) travel as one packed
string to the minimiser's bucket; equal strings of a chunk travel once. The bucket sorts
the windows of all strings, compares equal hashes word by word, and tells each chunk
which of its windows start anywhere else. Words covered by such a window are removed.

A minimiser that makes up more than 1/2000 of all strings is hot (there are 2000 at
most): its windows go one by one, as 128-bit digests, distinct within a chunk, to buckets
of their own, so a passage in a third of all documents is one digest per chunk and window.

Nulls and texts under 35 words: nothing is removed; a null text has no words. Very long
texts and texts of one repeated word are one string, whole. Repeated rows repeat their
windows. Other columns and their names don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import buckets
from symgraph.llm.buckets import OWN, Row
from symgraph.llm.textchunk import Words, slices, words

#: Words of a window and of a minimiser.
SIZE, MINIMISER = 35, 4
#: A hot minimiser's least share of all strings is 1 / HOT; fewer than HOT_LEAST strings are never hot.
HOT, HOT_LEAST = 2000, 64
STRINGS, WINDOWS = 1, 2
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

_U = np.uint64
_BASE, _BASE_INV = _U(0xD6E8FEB86659FD93), _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def runs_of(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of size words of one document, and the runs' first words; the cost doesn't depend on size."""
    h = w.hashes()
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    up, down = np.full(len(h), _BASE, _U), np.full(n, _BASE_INV, _U)
    up[0] = down[0] = 1
    total = np.concatenate((np.zeros(1, _U), np.cumsum(h * np.cumprod(up, dtype=_U), dtype=_U)))
    doc = w.doc_of_word()
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return ((total[size:] - total[:n]) * np.cumprod(down, dtype=_U))[at], at


def strings_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first window, number of windows, minimiser."""
    doc = w.doc_of_word()
    n = len(doc) - SIZE + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    grams, at = w.grams(w.hashes(), MINIMISER)
    least = np.full(len(doc) - MINIMISER + 1, ~_U(0))
    least[at] = grams
    span, have = SIZE - MINIMISER + 1, 1
    while have < span:  # the minimum over have runs becomes that over up to twice as many
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    window = np.flatnonzero(doc[:n] == doc[SIZE - 1 :])
    if not len(window):
        return window, window, np.zeros(0, _U)
    least = least[window]
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1))))
    return window[new], np.diff(np.concatenate((new, [len(window)]))), least[new]


def canonical(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words joined by one blank each, and where each word starts there (and where a next one would)."""
    size = w.end - w.start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    edge = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(edge, w.start, 1)
    np.add.at(edge, w.end, -1)
    out[inside] = w.data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return out, at


def hot_minimisers(docs: DataFrame) -> np.ndarray:
    """Minimisers of more than 1 / HOT of all strings, counted over all documents. They steer where windows meet, not what is found."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, least = strings_of(words(batch.column("text")))
            found, n = np.unique(least, return_counts=True)
            often = n > max(1, len(least) // (4 * HOT))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(least)))], ["least", "n", "all"])

    counts = docs.select("text").mapInArrow(count, "least long, n long, all long").groupBy("least").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = F.lit(counts.agg(F.sum("all")).first()[0] or 0)
    rows = counts.filter((F.col("n") >= HOT_LEAST) & (F.col("n") * HOT > total)).select("least").limit(HOT).collect()
    return np.sort(np.array([r["least"] for r in rows], np.int64).view(_U))


def _split(hot: np.ndarray, n_buckets: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for seq, batch in enumerate(slices(batches)):
            chunk = buckets.chunk_id(seq)
            w = words(batch.column("text"))
            text, at = canonical(w)
            raw = text.tobytes()
            first, n, least = strings_of(w)
            is_hot = np.isin(least, hot)
            lo, hi = at[first].tolist(), (at[first + n + SIZE - 1] - 1).tolist()
            ids: dict[bytes, int] = {}
            which = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(lo, hi, strict=True)], np.int64)
            unique, at_first = np.unique(which, return_index=True)
            size, bucket, warm = n[at_first], (least[at_first] % _U(n_buckets)).astype(np.int64), ~is_hot[at_first]
            strings = list(ids)
            for b, members in _grouped(bucket, np.flatnonzero(warm)):
                yield b, STRINGS, chunk, b, buckets.pack(b"\n".join(strings[i] for i in members.tolist()))
            digests: dict[bytes, int] = {}
            hot_windows = []
            for i in np.flatnonzero(~warm).tolist():
                f = int(first[at_first[i]])
                spots = at[f : f + int(size[i]) + SIZE].tolist()
                hot_windows.append(np.array([digests.setdefault(xxhash.xxh3_128_digest(raw[spots[k] : spots[k + SIZE] - 1]), len(digests)) for k in range(int(size[i]))], np.int64))
            home = np.frombuffer(b"".join(digests), "<u8")[::2] % _U(n_buckets) if digests else np.zeros(0, _U)
            every = list(digests)
            for b, members in _grouped(home.astype(np.int64), np.arange(len(every))):
                yield b, WINDOWS, chunk, b, buckets.pack(b"".join(every[i] for i in members.tolist()))
            own = {
                "doc_id": buckets.column(batch.column("doc_id")), "raw": raw, "words": w.counts().astype(np.int32), "first": np.diff(first, prepend=0).astype(np.int32), "which": which.astype(np.int32),
                "size": size.astype(np.int32), "bucket": bucket.astype(np.int32), "warm": warm, "home": home.astype(np.int32), "hot_windows": hot_windows,
            }
            yield ~chunk, OWN, chunk, 0, buckets.pack(own)

    return split


def _grouped(bucket: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets in order, with their members in order."""
    if len(members):
        members = members[np.argsort(bucket[members], kind="stable")]
        cut = np.flatnonzero(np.diff(bucket[members])) + 1
        for own in np.split(members, cut):
            yield int(bucket[own[0]]), own


def repeated(strings: list[bytes]) -> np.ndarray:
    """Of all windows of the strings, in order: whether the same words are another window too."""
    w = words(pa.array(strings, pa.large_binary()).cast(pa.large_string()))
    hashes, at = runs_of(w, SIZE)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    out = np.zeros(len(at), bool)
    raw, lo, hi = w.data.tobytes(), w.start[at], w.end[at + SIZE - 1]
    run = np.flatnonzero(np.concatenate((same, [False]))[1:] & ~same) if len(same) else []
    for k in run:
        to = k + 1
        while to < len(same) and same[to]:
            to += 1
        seen: dict[bytes, int] = {}
        for i in order[k:to].tolist():
            j = seen.setdefault(raw[lo[i] : hi[i]], i)
            if j != i:
                out[i] = out[j] = True
    return out


def _reply(key: int, rows: list[Row]) -> Iterator[Row]:
    for kind in (STRINGS, WINDOWS):
        own = [r for r in rows if r[1] == kind]
        if not own:
            continue
        if kind == STRINGS:
            parts = [buckets.unpack(r[4]).split(b"\n") for r in own]
            found = repeated([s for p in parts for s in p])
            sizes = [sum(s.count(b" ") + 2 - SIZE for s in p) for p in parts]
        else:
            parts = [np.frombuffer(buckets.unpack(r[4]), "V16") for r in own]
            _, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            found, sizes = n[inverse] > 1, [len(p) for p in parts]
        to = 0
        for (_, _, chunk, part, _), size in zip(own, sizes, strict=True):
            mine, to = found[to : to + size], to + size
            if mine.any():
                yield chunk, kind, chunk, part, buckets.bits(mine)


def _answers(kind: int, bucket: np.ndarray, members: np.ndarray, size: np.ndarray, rows: list[Row]) -> list[np.ndarray]:
    """Flags of each member, in the order of members, from the buckets' answers."""
    got = {r[3]: r[4] for r in rows if r[1] == kind}
    out: dict[int, np.ndarray] = {}
    for b, own in _grouped(bucket, members):
        cut = np.cumsum(size[own])
        found = buckets.flags(got[b], int(cut[-1])) if b in got else np.zeros(cut[-1], bool)
        out.update(zip(own.tolist(), np.split(found, cut[:-1]), strict=True))
    return [out[i] for i in members.tolist()]


def _finish(c: dict, rows: list[Row]) -> pa.RecordBatch:
    c["first"] = np.cumsum(c["first"], dtype=np.int64)
    c["length"] = np.diff(np.flatnonzero(np.frombuffer(c["raw"], np.uint8) == 32), prepend=-1)
    warm = np.flatnonzero(c["warm"])
    found: list[np.ndarray] = [np.zeros(0, bool)] * len(c["size"])
    for i, f in zip(warm.tolist(), _answers(STRINGS, c["bucket"], warm, c["size"], rows), strict=True):
        found[i] = f
    home = c["home"].astype(np.int64)
    digests = np.concatenate([np.zeros(0, bool), *_answers(WINDOWS, home, np.arange(len(home)), np.ones(len(home), np.int64), rows)])
    hot = np.flatnonzero(~c["warm"])
    inside = np.bincount(np.concatenate([np.zeros(0, np.int64), *c["hot_windows"]]), minlength=len(home)) > 1
    for i, ids in zip(hot.tolist(), c["hot_windows"], strict=True):
        found[i] = digests[ids] | inside[ids]
    step = np.zeros(len(c["length"]) + 1, np.int64)
    often = np.bincount(c["which"], minlength=len(found)) > 1
    for f, i in zip(c["first"].tolist(), c["which"].tolist(), strict=True):
        at = f + (np.arange(c["size"][i]) if often[i] else np.flatnonzero(found[i]))
        step[at] += 1
        step[at + SIZE] -= 1
    gone = np.cumsum(step[:-1]) > 0
    word = np.concatenate(([0], np.cumsum(c["words"])))
    gone_to = np.concatenate(([0], np.cumsum(gone)))
    kept = np.frombuffer(c["raw"], np.uint8)[np.repeat(~gone, c["length"])].tobytes()
    at = np.concatenate(([0], np.cumsum(np.where(gone, 0, c["length"]))))[word]
    texts = [kept[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c["doc_id"], pa.int64()), pa.array(c["words"], pa.int64()), pa.array(np.diff(gone_to[word]), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts], pa.string())],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one blank) of every document."""
    docs = docs.select("doc_id", "text")
    n = buckets.n_buckets(docs.sparkSession, buckets.size_of(docs))
    sent = buckets.send(docs, _split(hot_minimisers(docs), n))
    parts = buckets.n_parts(docs.sparkSession, n)
    return buckets.collect(buckets.answer(sent, _reply, parts), _finish, SCHEMA, parts)
