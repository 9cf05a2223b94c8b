"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines over the tropical semiring, which encode() composes with an
input and searches for the shortest path:

* the normaliser: arcs that read a character or a run of blanks and write U+2581, compiled to a substitution;
  its output is cut where no piece can cross (before U+2581, around line feeds), so each part is composed alone;
* the lexicon: a trie whose arcs read characters and write piece ids, with a byte-fallback arc for characters
  that are no piece;
* the history acceptor: its state is the last piece, and arc() gives the weight of the next one. For a unigram
  model that is minus the score. For a BPE model it is 0 where two neighbouring pieces survive all merges on both
  sides of their border and infinity elsewhere, so the one path of finite weight is the BPE result, and the state
  at a position is one piece.

Merges of equal rank (runs of U+2581 in some models) depend on their position in the run; runs have a machine of
their own with a stack, see Transducer.run. Of unigram paths that tie the first found from the left is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symgraph.llm.textchunk import slices

BLANK = "▁"
UNIGRAM, BPE = 1, 2
#: Types of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of each half of a worker's memory of composed parts; pairs of pieces that it keeps; characters of a part that it keeps.
MEMORY, PAIRS, KEPT_PART = 100_000, 400_000, 64
FAR = float("inf")
#: A character that is no piece.
_ONE_BYTE = ((1, -2),)


def default_model() -> bytes:
    """The 32k piece model of the tokenizer package, read where the query is built."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and types of a model file, and what its normaliser does."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape, chars = UNIGRAM, True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0" * 4), "<f4")[0]))
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.squeeze, self.escape, chars = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1)), own.get(2, b"")
        if chars or USER in self.types or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only models with the identity character map and without user-defined pieces are supported")


class Transducer:
    def __init__(self, data: bytes):
        m = self.model = Model(data)
        self.ids = {p: i for i, p in enumerate(m.pieces) if m.types[i] == NORMAL}
        self.bytes = {m.pieces[i]: i for i in range(len(m.pieces)) if m.types[i] == BYTE}
        self.fallback = [self.bytes.get(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = m.types.index(UNKNOWN)
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a part's border")
        self.parts = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n").findall
        self.text = [p.replace(BLANK, " ").encode() for p in m.pieces]
        for i, p in enumerate(m.pieces):
            if m.types[i] == BYTE:
                self.text[i] = bytes([int(p[3:5], 16)])
            elif m.types[i] in (UNKNOWN, CONTROL):
                self.text[i] = b" \xe2\x81\x87 " if m.types[i] == UNKNOWN else b""
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, float] = {}
        self.rank = [-s for s in m.scores]
        self.left: dict[int, list[tuple[int, float, float]]] = {}
        self.right: dict[int, list[tuple[int, float, float]]] = {}
        if m.kind == BPE:
            self._merges()
        self.trie: dict = {}
        for p, i in self.ids.items():
            if m.kind == BPE and i not in self.right:
                continue  # no merges lead to it
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.longest = max(map(len, self.ids), default=0)
        if m.kind == BPE:
            self._gather()
        self.worst = max((r for i, r in enumerate(self.rank) if m.types[i] == NORMAL), default=0.0) + 10

    def _merges(self) -> None:
        """Each piece's spines: (piece, rank, rank of what it is merged into) from the piece down to a character.

        A piece is the merge of the two better pieces that survive side by side; pieces
        are taken from the best down, so that the halves' spines are there.
        """
        runs = {p for p in self.ids if not p.strip(BLANK)}
        for p in sorted(self.ids, key=lambda p: (len(p) > 1, self.rank[self.ids[p]], len(p))):
            i = self.ids[p]
            if len(p) == 1:
                self.right[i] = self.left[i] = [(i, -FAR, FAR)]
                continue
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if p in runs:
                    good = k == len(p) - 1
                else:
                    good = a in self.right and b in self.right and max(self._made(a), self._made(b)) < self.rank[i] and self.apart(a, b, self.rank[i])
                if good:
                    r = self.rank[i]
                    self.right[i] = [(i, r, FAR)] + [(x, own, r if x == b and n == 0 else up) for n, (x, own, up) in enumerate(self.right.get(b, []))]
                    self.left[i] = [(i, r, FAR)] + [(x, own, r if x == a and n == 0 else up) for n, (x, own, up) in enumerate(self.left.get(a, []))]
                    break

    def _gather(self) -> None:
        """In place of its own piece each state of the lexicon gets (length, piece) of all pieces on the way to it, the longest last."""
        open_ = [(self.trie, 0, ())]
        while open_:
            node, depth, fits = open_.pop()
            if "" in node:
                fits = (*fits, (depth, node[""]))
            open_ += [(below, depth + 1, fits) for c, below in node.items() if c]
            node[""] = fits

    def _made(self, i: int) -> float:
        return self.right[i][0][1]

    def apart(self, a: int, b: int, until: float = FAR) -> bool:
        """Whether no merge of a rank below until joins the ends of a and b while either is still being merged.

        Of two merges of one rank the left one is first: an end that goes into its own
        piece at the same rank is gone for a border merge on its right, not on its left.
        """
        pieces, rank, ids = self.model.pieces, self.rank, self.ids
        for x, made_x, gone_x in self.right[a]:
            for y, made_y, gone_y in self.left[b]:
                if made_x >= gone_y or made_y >= gone_x:
                    continue  # never there at one time
                joint = ids.get(pieces[x] + pieces[y])
                if joint is not None and rank[joint] < min(gone_x, until) and rank[joint] <= gone_y and rank[joint] < until:
                    return False
        return True

    def run(self, n: int) -> list[int]:
        """Ids of n times U+2581: merges of one rank, the leftmost first. What is left of the stack's top can't be merged any more, so it takes linear time."""
        stack: list[int] = []
        while True:
            if len(stack) > 1 and BLANK * (stack[-2] + stack[-1]) in self.ids:
                last = stack.pop()
                stack[-1] += last
            elif n and stack and BLANK * (stack[-1] + 1) in self.ids:
                stack[-1] += 1
                n -= 1
            elif n:
                stack.append(1)
                n -= 1
            else:
                return [self.ids[BLANK * s] for s in stack]

    def _bytes(self, c: str) -> list[int]:
        return [self.fallback[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def arc(self, last: int, piece: int) -> float:
        """Weight of a piece after the last one (-1 at the beginning, -2 after a byte)."""
        if self.model.kind == UNIGRAM:
            return self.rank[piece]
        if last < 0:
            return 0.0
        key = last * len(self.model.pieces) + piece
        weight = self.pairs.get(key)
        if weight is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            weight = self.pairs[key] = 0.0 if self.apart(last, piece) else FAR
        return weight

    def _finite(self, part: str) -> list[int]:
        """The one path of finite weight of a BPE model's composition with a part: the longest piece first, back from dead ends, each of which is met once."""
        n, root, pairs, size, arc, longest = len(part), self.trie, self.pairs, len(self.model.pieces), self.arc, self.longest
        path, ends, rest, i, last, dead = [], [0], [], 0, -1, bytearray(n + 1)
        fits, k = None, 0  # pieces from i on, of which the first k weren't tried yet
        while i < n:
            if fits is None:
                node = root
                for c in part[i : i + longest]:
                    if (below := node.get(c)) is None:
                        break
                    node = below
                fits = node[""] or _ONE_BYTE
                k = len(fits)
            before = last * size
            while k:
                k -= 1
                length, t = fits[k]
                j = i + length
                if dead[j]:
                    continue
                if last >= 0 and t >= 0:
                    weight = pairs.get(before + t)
                    if (arc(last, t) if weight is None else weight) == FAR:
                        continue
                path.append(t)
                rest.append((fits, k))
                ends.append(j)
                i, last, fits = j, t, None
                break
            else:
                dead[i] = 1
                fits, k = rest.pop()
                path.pop()
                ends.pop()
                i, last = ends[-1], path[-1] if path else -1
        if -2 in path:
            return list(chain.from_iterable(self._bytes(part[a:b]) if t == -2 else [t] for t, a, b in zip(path, ends, ends[1:], strict=False)))
        return path

    def _path(self, part: str) -> list[int]:
        """Shortest path of the composition with a part, position by position."""
        if self.model.kind == BPE:
            return self._finite(part)
        n, arc, trie, fallback = len(part), self.arc, self.trie, self.worst
        far, last, begun = [0.0] + [FAR] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            here, before, node, j, single = far[i], last[i], trie, i, False
            if here == FAR:
                continue
            while j < n and (node := node.get(part[j])) is not None:
                j += 1
                t = node.get("")
                if t is None:
                    continue
                single |= j == i + 1
                if here < far[j] and (w := here + arc(before, t)) < far[j]:
                    far[j], last[j], begun[j] = w, t, i
            if not single and here + fallback < far[i + 1]:
                far[i + 1], last[i + 1], begun[i + 1] = here + fallback, -2, i
        out: list[list[int]] = []
        while n:
            out.append(self._bytes(part[begun[n] : n]) if last[n] == -2 else [last[n]])
            n = begun[n]
        return list(chain.from_iterable(reversed(out)))

    def part(self, part: str) -> tuple[int, ...]:
        """Ids of one part; the last blank of a leading run belongs to the word if the path takes it in."""
        if self.model.kind == UNIGRAM:
            return tuple(self._path(part))
        word = part.lstrip(BLANK)
        blanks = len(part) - len(word)
        if not word:
            return tuple(self.run(blanks))
        if not blanks:
            return tuple(self._path(word))
        path = self._path(BLANK + word)
        alone = self.model.pieces[path[0]] == BLANK
        return (*self.run(blanks - 1 + alone), *path[alone:])

    def normal(self, text: str) -> str:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if m.prefix else "") + text
        return text.replace(" ", BLANK) if m.escape else text

    def encode(self, text: str) -> list[int]:
        parts, seen = self.parts(self.normal(text)), self.seen
        found = list(map(seen.get, parts))
        if None in found:
            older, part = self.older, self.part
            for k, x in enumerate(found):
                if x is None:
                    own = parts[k]
                    ids = found[k] = seen.get(own) or older.get(own) or part(own)
                    if len(own) <= KEPT_PART:
                        if len(seen) >= MEMORY:  # what is still in use comes back out of the older half
                            self.older = older = seen
                            self.seen = seen = {}
                        seen[own] = ids
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        if self.model.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_COMPILED: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """One transducer, with its memory, for all tasks of a Python worker."""
    key = hash(data)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(data)
    return _COMPILED[key]


SCHEMA = "doc_id long, n_pieces long, n_fallback long, pieces array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_pieces, n_fallback (byte pieces), pieces (ids), round_trip (decoding gives the text, U+2581 read as a blank).

    A null text gives null pieces and round_trip, and 0 counts; an empty one an empty array. Every
    row gives one row, repeated rows too; other columns and their names don't matter.
    """
    data = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(data)
        is_byte = np.array([x == BYTE for x in t.model.types])
        for batch in slices(batches):
            found, same = [], []
            for text in batch.column("text").to_pylist():
                if text is None:
                    found.append(None)
                    same.append(None)
                    continue
                ids = t.encode(text)
                found.append(ids)
                back = t.decode(ids)
                same.append(back == text or back == text.replace(BLANK, " "))
            size = np.array([0 if x is None else len(x) for x in found], np.int64)
            flat = np.fromiter(chain.from_iterable(x for x in found if x), np.int32, int(size.sum()))
            offsets = np.concatenate(([0], np.cumsum(size)))
            low = np.concatenate(([0], np.cumsum(is_byte[flat])))
            arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([*(x is None for x in found), False])), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(low[offsets[1:]] - low[offsets[:-1]]), arrays, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "n_fallback", "pieces", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode_documents(pieces: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, text of a table with doc_id and pieces; null pieces give a null text."""
    data = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(data)
        for batch in batches:
            texts = [None if ids is None else t.decode(ids) for ids in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
