"""N-gram Jaccard join by count-vector R-trees.

A document's set holds the hashes of its distinct word shingles. Two documents link
when the overlap is at least 0.8 of the union; what is returned is each document's set
size and the least doc_id of its component.

Tokens of a set are hashed into 256 groups, 1024 for a set of over 1600, 4096 for one of
over 6400 and so on, and the group counts are a point: the sum of the coordinates'
minima bounds the overlap of two sets from above, and that of an R-tree's upper corners
the overlap of all below. Trees are over 64 sums of groups; what survives is bounded again
by all the groups that both sets have. Trees are built
for sets that share one of their least tokens, which linked sets always do (of n tokens,
the first n - ceil(0.8 n) + 1 in one global order; very frequent tokens come last in
it). Chunks send these tokens to buckets in packed blobs, and only tokens that two
different sets hold become rows, without sets that are too far in size from all others of
a token. The least common token of two linked sets is among the first n - ceil(8/9 n) + 1 of
the smaller one, so a token that is early in this sense in no set is left out, and so is a set
that has no partner for which this holds. Surviving pairs are verified on the shingles of their
texts, which are read again for the sets in question alone.

A set is known by the 64-bit hash of its tokens.

Hot groups: equal sets count as one; a token of many sets is dealt into blocks. The
first rounds take one candidate of another component for each set, so a group of near
copies becomes one component by as many pairs as it has members; a token of one block
in which no pair survives is done with in the first; the last round
verifies every surviving pair of different components, across all blocks, so no link
is lost.

Nulls and texts without words: an empty set, linked with nothing; a null doc_id has a
null component. Fewer words than a shingle: the whole sequence is one. A repeated
doc_id is one vertex with all its texts. An empty table gives an empty one; very long
texts are read whole, each as a chunk of its own. Of candidates that tie the one with
the least id is taken. Other columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm import buckets
from symgraph.llm.checked import join_skewed, join_small
from symgraph.llm.components import components
from symgraph.llm.textchunk import mix, slices, words
from symgraph.session import drop_staged, staged, staged_with_path

SIZE, GROUPS, LEAST_GROUPS = 5, 64, 256
#: Tokens up to which a point is a list of their groups, a byte each, in place of the counts.
LISTED = 200
#: Sets of more tokens than STEP have four times LEAST_GROUPS, of four times STEP sixteen times, and so on.
STEP = 1600
#: Links need PART * overlap >= WHOLE * union.
PART, WHOLE = 100, 80
#: Tokens held by more than 1 / HOT of all documents (64 at least) come last in the order; so many of them at most.
HOT, HOT_LEAST, HOT_MOST = 1000, 64, 100_000
#: Sets of a token in one block, in the last round, and of a tree's leaf.
BLOCK, LAST_BLOCK, LEAF = 256, 2048, 24
ROUNDS = 2
TOKENS = 1
#: Bytes of packed texts that are verified at once.
VERIFIED = 1 << 20
SETS = "doc_id long, th long, n_shingles long, id long, point binary, key long, chunk long, blob binary"
ROWS = "token long, id long, n_sets long, early boolean, members binary"
_U = np.uint64
_TOP = _U(1 << 63)


class Hot:
    """Frequent tokens, ascending, and a table of their low bits by which others are told apart at once."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        self.table = np.zeros(1 << 21, bool)
        self.table[self._low(tokens)] = True

    @staticmethod
    def _low(tokens: np.ndarray) -> np.ndarray:
        return (tokens & _U((1 << 21) - 1)).astype(np.int64)

    def mark(self, tokens: np.ndarray) -> None:
        """Sets the top bit of frequent tokens, in place."""
        if len(self.tokens):
            at = np.flatnonzero(self.table[self._low(tokens)])
            found = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
            at = at[self.tokens[found] == tokens[at]]
            tokens[at] |= _TOP


NONE = Hot(np.zeros(0, _U))


def shingle_sets(texts: pa.Array, hot: Hot = NONE, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the documents' sets, and the sets one after another, each in the global order."""
    w = words(texts)
    upper = (w.data >= 65) & (w.data <= 90)
    w.data = np.where(upper, w.data + np.uint8(32), w.data)
    hashes, counts = w.hashes(), w.counts()
    grams, _ = w.grams(hashes, size)
    few = np.flatnonzero((counts > 0) & (counts < size))
    n = np.maximum(counts - size + 1, 0)
    n[few] = 1
    to = np.cumsum(n)
    key = np.empty(int(to[-1]) if len(to) else 0, _U)
    own = np.ones(len(key), bool)
    own[to[few] - 1] = False
    key[own] = grams
    key[~own] = [xxhash.xxh3_64_intdigest(hashes[w.first[d] : w.first[d + 1]].tobytes()) for d in few.tolist()]
    key >>= _U(1)
    hot.mark(key)
    first = (to - n)[n > 0]
    for a, b in zip(first.tolist(), to[n > 0].tolist(), strict=True):
        key[a:b].sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[first] = True
    sizes = np.zeros(len(n), np.int64)
    if len(first):
        sizes[n > 0] = np.add.reduceat(new, first, dtype=np.int64)
    return sizes, key[new]


def hot_tokens(docs: DataFrame) -> tuple[Hot, int]:
    """Tokens of more than 1 / HOT of all documents (counted over all, kept where a chunk holds them twice), and the bytes of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in slices(batches):
            size += batch.column("text").nbytes
            _, tokens = shingle_sets(batch.column("text"))
            tokens.sort()
            begin = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate((begin, [len(tokens)])))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[begin[n > 1]].view(np.int64)), pa.array(n[n > 1], pa.int64())], ["token", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([size], pa.int64())], ["token", "n"])

    least = F.lit(max(HOT_LEAST, docs.count() // HOT))
    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("token") == -1))
    rows = {r["token"]: r["n"] for r in counts.orderBy(F.col("token") != -1, F.desc("n"), "token").limit(HOT_MOST + 1).collect()}
    size = rows.pop(-1, 0)
    return Hot(np.sort(np.array(list(rows), np.int64).view(_U))), size


def _prefix(sizes: np.ndarray) -> np.ndarray:
    """Tokens of each set that are looked up."""
    return np.where(sizes > 0, sizes - -(-WHOLE * sizes // PART) + 1, 0)


def _early(sizes: np.ndarray) -> np.ndarray:
    """Tokens of each set among which is the least that it shares with a linked set of its size or larger."""
    return np.where(sizes > 0, sizes - -(-2 * WHOLE * sizes // (PART + WHOLE)) + 1, 0)


def _prefix_tokens(sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = _prefix(sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return n, tokens[at]


def set_ids(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    to = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return np.array([xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) or 1 if b > a else 0 for a, b in zip(to[:-1], to[1:], strict=True)], _U).reshape(-1)


def _groups(n: float) -> int:
    """Groups of a set of n tokens."""
    g = LEAST_GROUPS
    while n > STEP:
        g, n = 4 * g, n / 4
    return g


def point(tokens: np.ndarray) -> bytes:
    """A set's groups: a zero byte and the group of each token, or the counts by group with one, two or four bytes each after a byte that says so. Group i of 64 is groups 4 i to 4 i + 3 of 256."""
    g = _groups(len(tokens))
    own = (mix(tokens) >> _U(65 - g.bit_length())).astype(np.int64)
    if len(tokens) <= LISTED:
        return b"\0" + own.astype(np.uint8).tobytes()
    counts = np.bincount(own, minlength=g)
    most = int(counts.max())
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def counts_of(points: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, f"<u{p[0]}", offset=1).astype(np.int64) if p[0] else np.bincount(np.frombuffer(p, np.uint8, offset=1), minlength=LEAST_GROUPS) for p in points]


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(1)


def _sets(hot: Hot, n_buckets: int):
    """Documents (doc_id, th, text) to SETS: one row each, an empty set without id and point; and the distinct (token, set id) of a chunk, a blob for each bucket (key)."""

    def rows_of_docs(batch: pa.RecordBatch, sizes: np.ndarray, tokens: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        to, none = np.cumsum(sizes), sizes == 0
        points = [point(tokens[a:b]) if b > a else None for a, b in zip((to - sizes).tolist(), to.tolist(), strict=True)]
        nothing = pa.nulls(len(sizes), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(ids.view(np.int64), pa.int64(), mask=none), pa.array(points, pa.binary()), nothing, nothing, pa.nulls(len(sizes), pa.binary())],
            _NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(slices(batches)):
            chunk = buckets.chunk_id(seq)
            sizes, tokens = shingle_sets(batch.column("text"), hot)
            ids = set_ids(sizes, tokens)
            yield rows_of_docs(batch, sizes, tokens, ids)
            real = np.flatnonzero((sizes > 0) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            first = np.zeros(len(ids), bool)
            first[real[np.unique(ids[real], return_index=True)[1]]] = True
            n, looked = _prefix_tokens(sizes, tokens)
            keep = np.repeat(first, n)
            early = np.arange(len(looked)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(_early(sizes), n)
            looked, early, owner = looked[keep], early[keep], np.repeat(np.arange(len(ids)), n)[keep]
            home = (mix(looked) % _U(n_buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            out: list[tuple[int, bytes]] = []
            for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                docs, at = np.unique(owner[own], return_inverse=True)
                out.append((int(home[own[0]]), np.array([len(own), len(docs)], "<i8").tobytes() + looked[own].tobytes() + ids[docs].tobytes() + at.astype("<u4" if len(docs) > 1 << 16 else "<u2").tobytes() + np.packbits(early[own]).tobytes()))
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(out), pa.binary()), pa.array([k for k, _ in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], _NAMES)

    return run


_NAMES = [x.split()[0] for x in SETS.split(", ")]


def _of_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their sets' ids, and which are early in their set."""
    n, docs = np.frombuffer(blob, "<i8", 2).tolist()
    tokens, ids = np.frombuffer(blob, _U, n, 16), np.frombuffer(blob, _U, docs, 16 + 8 * n)
    at = np.frombuffer(blob, "<u4" if docs > 1 << 16 else "<u2", n, 16 + 8 * (n + docs))
    return tokens, ids[at], np.unpackbits(np.frombuffer(blob, np.uint8, -1, 16 + 8 * (n + docs) + at.nbytes), count=n).astype(bool)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's blobs (key, chunk, blob) to ROWS of the tokens that two sets hold, early in one of them; a token's first row has a 128-bit hash of its sets and of where it is early."""
    rows = ((k, b) for batch in batches for k, b in zip(batch.column("key").to_pylist(), batch.column("blob").to_pylist(), strict=True))
    for _, group in groupby(rows, key=lambda r: r[0]):
        token, owner, early = (np.concatenate(x) for x in zip(*(_of_blob(b) for _, b in group), strict=True))
        order = np.argsort(token, kind="stable")
        token, owner, early = token[order], owner[order], early[order]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        n = np.diff(np.concatenate((begin, [len(token)])))
        keep = np.repeat(n > 1, n)  # the others are of one set
        token, owner, early = token[keep], owner[keep], early[keep]
        order = np.lexsort((owner, token))
        token, owner, early = token[order], owner[order], early[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner, early = token[new], owner[new], early[new]
        begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((begin, [len(token)])))
        good = (n > 1) & (np.logical_or.reduceat(early, begin) if len(begin) else False)
        members = np.full(len(token), None, object)
        for i, k in zip(begin[good].tolist(), n[good].tolist(), strict=True):
            members[i] = xxhash.xxh3_128_digest(owner[i : i + k].tobytes() + early[i : i + k].tobytes())
        good, n = np.repeat(good, n), np.repeat(n, n)
        token, owner, early, members, n = token[good], owner[good], early[good], members[good], n[good]
        for a in range(0, len(token), 20_000):
            z = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(token[z].view(np.int64)), pa.array(owner[z].view(np.int64)), pa.array(n[z], pa.int64()), pa.array(early[z]), pa.array(members[z].tolist(), pa.binary())], ["token", "id", "n_sets", "early", "members"])


class CountTree:
    """R-tree over count vectors, loaded by halving along the dimension of largest variance; nodes keep their upper corner and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, int, int, int, np.ndarray]] = []  # upper corner, least and largest size, children or -1, members
        self.root = self._load(np.arange(len(points)))

    def _load(self, members: np.ndarray) -> int:
        own = self.points[members]
        a = b = -1
        if len(members) > LEAF:
            order = members[np.argsort(own[:, own.astype(float).var(0).argmax()], kind="stable")]
            a, b = self._load(order[: len(order) // 2]), self._load(order[len(order) // 2 :])
        self.nodes.append((own.max(0), int(self.sizes[members].min()), int(self.sizes[members].max()), a, b, members))
        return len(self.nodes) - 1

    def leaves(self, left: int | None = None, right: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members of each pair of leaves (one leaf twice too) that may hold linked sets."""
        stack = [(self.root, self.root)] if left is None else [(left, right)]
        while stack:
            i, j = stack.pop()
            x, y = self.nodes[i], self.nodes[j]
            if i != j and (PART * min(x[2], y[2]) < WHOLE * max(x[1], y[1]) or (PART + WHOLE) * int(np.minimum(x[0], y[0]).sum()) < WHOLE * (x[1] + y[1])):
                continue
            if x[3] < 0 and y[3] < 0:
                yield x[5], y[5]
            elif i == j:
                stack += [(x[3], x[3]), (x[3], x[4]), (x[4], x[4])]
            elif y[3] < 0 or x[3] >= 0 and len(x[5]) >= len(y[5]):
                stack += [(x[3], j), (x[4], j)]
            else:
                stack += [(i, y[3]), (i, y[4])]

    def pairs(self, own: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, bound on the overlap) of pairs within the bound whose values of own, and of side, differ; each pair once."""
        for x, y in self.leaves():
            bound = np.minimum(self.points[x][:, None], self.points[y][None]).sum(2, dtype=np.int64)
            ok = ((PART + WHOLE) * bound >= WHOLE * (self.sizes[x][:, None] + self.sizes[y][None])) & (own[x][:, None] != own[y][None])
            if side is not None:
                ok &= side[x][:, None] != side[y][None]
            if x is y:
                ok &= np.tri(len(x), k=-1, dtype=bool)
            i, j = np.nonzero(ok)
            if len(i):
                yield x[i], y[j], bound[i, j]


def _candidates(best: bool):
    """Rows (token, block, side, id, component, n_shingles, point) sorted by block to pairs (a, b, worth) of sets of different components, with the token.

    best: one for each set in a block. side: 0 and 1 meet only each other, where a token's blocks are taken two by two.
    """

    def bounded(counts: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sums of the minima over the groups that both sets of a pair have."""
        groups = np.array([len(c) for c in counts])
        both = np.minimum(groups[i], groups[j])
        out = np.zeros(len(i), np.int64)
        for g in np.unique(both).tolist():
            at = np.flatnonzero(both == g)
            names, where = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
            table = np.stack([folded(counts[k], g) for k in names.tolist()])
            step = max(1, (1 << 22) // g)
            for a in range(0, len(at), step):
                x, y = where[: len(at)][a : a + step], where[len(at) :][a : a + step]
                out[at[a : a + step]] = np.minimum(table[x], table[y]).sum(1)
        return out

    def of_block(ids: np.ndarray, component: np.ndarray, n: np.ndarray, side: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(ids) < 2 or (component == component[0]).all():
            return
        counts = counts_of(points.tolist())
        top = np.zeros(len(ids))
        partner = np.full(len(ids), -1)
        for i, j, _ in CountTree(np.stack([folded(c, GROUPS) for c in counts]), n).pairs(component, side if side.any() else None):
            both = n[i] + n[j]
            bound = bounded(counts, i, j)
            ok = (PART + WHOLE) * bound >= WHOLE * both
            i, j, bound, both = i[ok], j[ok], bound[ok], both[ok]
            if not len(i):
                continue
            worth = bound / both
            if not best:
                yield np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]), worth
                continue
            x, y, v = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((worth, worth))
            order = np.lexsort((ids[y], -v, x))
            order = order[np.concatenate(([True], np.diff(x[order]) > 0))]
            x, y, v = x[order], y[order], v[order]
            better = (v > top[x]) | ((v == top[x]) & (ids[y] < ids[partner[x]]))
            top[x[better]], partner[x[better]] = v[better], y[better]
        if best:
            at = np.flatnonzero(partner >= 0)
            yield ids[at], ids[partner[at]], top[at]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Token and columns of each block; one may go on in the next batch."""
        held: list[list[np.ndarray]] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, block = batch.column("token").to_numpy(), batch.column("block").to_numpy()
            columns = [*(batch.column(c).to_numpy() for c in ("id", "component", "n_shingles", "side")), np.array([*batch.column("point").to_pylist(), None], object)[:-1]]
            cut = [0, *(np.flatnonzero((np.diff(token) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(token)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and key != (token[a], block[a]):
                    yield key[0], held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                key = (token[a], block[a])
                held.append([c[a:b] for c in columns])
        if held:
            yield key[0], held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b", "worth", "token"])
        for token, columns in blocks(batches):
            for found in of_block(*columns):
                held.append((*found, np.full(len(found[0]), token)))
                size += len(found[0])
                if size > 20_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _blocks(rows: DataFrame, best: bool) -> DataFrame:
    """Rows with token, block and side: of a token with many sets, each in one of many blocks (best), or in every pair of blocks that its own is in."""
    parts = F.ceil(F.col("n_sets") / F.lit(BLOCK if best else LAST_BLOCK)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id", "token"), F.col("parts")).cast("int"))
    if best:
        return rows.withColumn("block", F.col("own")).withColumn("side", F.lit(0))
    own, other = F.col("own"), F.col("other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Blocks i <= j: i == j is the block with itself.
    return rows.withColumn("block", F.least(own, other) * F.col("parts") + F.greatest(own, other)).withColumn("side", F.when(own <= other, 0).otherwise(1))


def _join_in_trees(rows: DataFrame, best: bool) -> DataFrame:
    dealt = _blocks(rows, best).select("token", "block", "side", "id", "component", "n_shingles", "point")
    return dealt.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(_candidates(best), "a long, b long, worth double, token long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, packed): the words of each set's text, compressed."""
    for batch in slices(batches):
        texts = [buckets.pack(b" ".join((t or "").encode().lower().split())) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "packed"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, pa, pb) to the pairs (a, b) that link; each text of some rows is cut into shingles once."""
    for batch in batches:
        size = np.cumsum(pc.add(pc.binary_length(batch.column("pa")), pc.binary_length(batch.column("pb"))).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + VERIFIED, "right")))
            part, at = batch.slice(at, to - at), to
            blobs: dict[int, bytes] = {}
            pairs = list(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True))
            for c, k in (("pa", 0), ("pb", 1)):
                for i, p in enumerate(pairs):
                    if p[k] not in blobs:
                        blobs[p[k]] = buckets.unpack(part.column(c)[i].as_py())
            sizes, tokens = shingle_sets(pa.array(blobs.values(), pa.large_binary()).cast(pa.large_string()))
            sets = dict(zip(blobs, np.split(tokens, np.cumsum(sizes)[:-1]), strict=True))
            keep = []
            for a, b in pairs:
                both = len(sets[a]) + len(sets[b])
                overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                keep.append(PART * overlap >= WHOLE * (both - overlap))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that link. docs: (doc_id, th, text); sets: (id, node, th), a document with the set."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = staged(wanted.join(sets.select("id", F.col("node").alias("_d"), F.col("th").alias("_t")), "id"), "wanted")
    texts = join_small(docs, wanted, (F.col("doc_id") == F.col("_d")) & F.col("th").eqNullSafe(F.col("_t"))).select("id", "text").dropDuplicates(["id"])
    texts, path = staged_with_path(texts.mapInArrow(_packed, "id long, packed binary"), "texts")
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a").join(texts.select(F.col("id").alias("b"), F.col("packed").alias("pb")), "b")
    out = staged(both.mapInArrow(_verified, "a long, b long"), "links")
    drop_staged(docs.sparkSession, path)
    return out


def _least(node: DataFrame, found: DataFrame) -> DataFrame:
    """id, component, m (the least doc_id of the component) of sets (id, node); of one that is linked with nothing, its own."""
    own = node.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "node", F.coalesce("component", "id").alias("component"))
    least = own.groupBy("component").agg(F.min("node").alias("m"), F.count("*").alias("_n"))
    return join_skewed(own, staged(least, "least"), "component").select("id", "component", "m")


def _near_in_size(rows: DataFrame) -> DataFrame:
    """Rows (token, id, n_sets, n_shingles, early), less early, without the sets that have no partner in their token, so that their points don't travel; tokens of over BLOCK sets stay whole.

    A partner is near enough in size to link, and the token is early in the smaller one (of equal sizes in either).
    """
    by_size = Window.partitionBy("token").orderBy("n_shingles", F.desc("early"))
    n, more = F.col("n_shingles"), F.lead("n_shingles").over(by_size)
    less = F.last(F.when(F.col("early"), n), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    # The next in size is the nearest, so if it is too far all are.
    near = F.coalesce(F.lit(PART) * less >= F.lit(WHOLE) * n, F.lit(False)) | (F.col("early") & F.coalesce(F.lit(PART) * n >= F.lit(WHOLE) * more, F.lit(False)))
    few = rows.filter(F.col("n_sets") <= BLOCK).withColumn("_near", near).filter("_near").drop("_near", "early")
    return few.unionByName(rows.filter(F.col("n_sets") > BLOCK).drop("early"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every document (doc_id, th, n_shingles, id: its set's), the sets (id, node: the least doc_id with it, n) and the links (a, b) between sets, enough of them for the components."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    spark = docs.sparkSession
    hot, size = hot_tokens(docs)
    n = buckets.n_buckets(spark, size)
    made, made_path = staged_with_path(docs.mapInArrow(_sets(hot, n), SETS), "sets")
    every = made.filter("key IS NULL").select("doc_id", "th", "n_shingles", "id")
    real = made.filter("id IS NOT NULL AND doc_id IS NOT NULL")
    at = F.min(F.struct("doc_id", "th")).alias("at")
    sets = real.groupBy("id").agg(at, F.count("*").alias("n"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("point").alias("point"))
    sets = staged(sets.select("id", F.col("at.doc_id").alias("node"), F.col("at.th").alias("th"), "n", "n_shingles", "point"), "classes")
    blobs = made.filter("key IS NOT NULL").select("key", "chunk", "blob").repartition(buckets.n_parts(spark, n), "key").sortWithinPartitions("key", "chunk")
    shared, shared_path = staged_with_path(blobs.mapInArrow(_shared, ROWS), "shared")
    every = staged(every, "every")
    drop_staged(spark, made_path)
    # Tokens with the same sets would give the same pairs: one of them stays.
    single = shared.filter("members IS NOT NULL").groupBy("members").agg(F.min("token").alias("token")).select("token")
    sized, sized_path = staged_with_path(shared.drop("members").join(single, "token", "left_semi").join(sets.select("id", "n_shingles"), "id"), "sized")
    rows, rows_path = staged_with_path(_near_in_size(sized).join(sets.select("id", "point"), "id"), "rows")
    drop_staged(spark, shared_path)
    drop_staged(spark, sized_path)
    links = spark.createDataFrame([], "a long, b long")
    found, tried = None, None
    for best in [True] * ROUNDS + [False]:
        if found is None:
            now = rows.withColumn("component", F.col("id"))
        else:
            now = rows.join(found.withColumnRenamed("component", "c"), rows["id"] == found["node"], "left").withColumn("component", F.coalesce("c", "id")).drop("c", "node")
            mixed = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("_n")).filter("lo < hi").select("token", "_n")
            now = join_skewed(now, staged(mixed, "mixed"), "token")
        pairs = _join_in_trees(now, best)
        if found is None:
            pairs, pairs_path = staged_with_path(pairs, "survivors")
            live = pairs.select("token").unionByName(rows.filter(F.col("n_sets") > BLOCK).select("token")).distinct()
            few, few_path = staged_with_path(join_small(rows, staged(live, "live"), "token", "left_semi"), "rows")
        if best:
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("worth", -F.col("b").cast("decimal(20,0)"))).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        pairs = pairs.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")  # what failed once fails again
        pairs = staged(pairs.select("a", "b"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = verify(pairs, docs, sets)
        links = links.unionByName(new)
        if found is None:
            for p in (rows_path, pairs_path):
                drop_staged(spark, p)
            rows, rows_path = few, few_path
        if best and (found is None or not new.isEmpty()):
            found = staged(components(links, "a", "b"), "components")
    drop_staged(spark, rows_path)
    return every, sets, links


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    every, sets, links = classes(docs)
    # Documents that share a doc_id are one vertex: each of its sets is tied to the least.
    named = every.filter("id IS NOT NULL AND doc_id IS NOT NULL")
    twice = staged(named.groupBy("doc_id").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("doc_id", "least"), "twice")
    ties = join_small(named, twice, "doc_id").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    found = staged(components(links.unionByName(ties), "a", "b"), "components")
    least = staged(_least(sets.select("id", "node"), found).select("id", "m").join(sets.select("id", F.col("n").alias("_n")), "id"), "least")
    out = join_skewed(named, least, "id").select("doc_id", "n_shingles", F.col("m").alias("component_id"))
    return out.unionByName(every.filter("id IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of linked texts: that of the least (doc_id, text hash), once. Documents with a null doc_id or without words stay.

    Texts decide, not doc_ids: what is linked with nothing but shares a doc_id stays.
    """
    every, sets, links = classes(docs)
    found = staged(components(links, "a", "b"), "components")
    own = sets.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = own.groupBy("component").agg(F.min(F.struct("node", "th")).alias("at")).select(F.col("at.node").alias("_d"), F.col("at.th").alias("_t"))
    bare = every.filter("id IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    names = docs.columns
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("_th", F.xxhash64("text"))
    on = lambda t: (F.col("doc_id") == t["_d"]) & F.col("_th").eqNullSafe(t["_t"])
    one = named.join(first, on(first), "left_semi").dropDuplicates(["doc_id", "_th"]).select(*names)
    empty = join_small(named, staged(bare, "bare"), (F.col("doc_id") == F.col("_d")) & F.col("_th").eqNullSafe(F.col("_t")), "left_semi").select(*names)
    return one.unionByName(empty).unionByName(docs.filter(F.col("doc_id").isNull()))
