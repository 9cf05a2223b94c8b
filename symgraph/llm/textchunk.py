"""Arrow batches of texts as flat numpy arrays of words.

A word is a maximal run of characters other than U+0020 and U+0009 to U+000D;
those are ASCII, so words can be cut in the UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; working memory is about 100 times this.
CHUNK_BYTES = 2 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)
_C_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_D = 0xD6E8FEB86659FD93
_BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


#: Powers up to a block's length; those of whole blocks are made where they are needed, so that long texts take little memory.
_UP, _DOWN = _powers(_C, _BLOCK), _powers(_C_INV, _BLOCK)
_C_BLOCK, _C_INV_BLOCK = (_U(pow(int(c), _BLOCK, 1 << 64)) for c in (_C, _C_INV))


@dataclass
class Words:
    """data: all bytes; offsets: of documents in data; start, end: of words in data; first: of each document's words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, _U)
        blocks = -(-n // _BLOCK)
        for a, factor in zip(range(0, n, _BLOCK), _powers(_C_BLOCK, blocks), strict=True):
            part = total[a + 1 : a + 1 + _BLOCK]
            np.add(self.data[a : a + _BLOCK], _U(1), out=part, dtype=_U)
            part *= _UP[: len(part)]
            part *= factor
        np.cumsum(total, out=total)
        down = _DOWN[self.start & (_BLOCK - 1)] * _powers(_C_INV_BLOCK, blocks + 1)[self.start >> 16]
        return mix((total[self.end] - total[self.start]) * down + (self.end - self.start).astype(_U))

    def grams(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each run of size words of one document, and the runs' first words."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        doc = self.doc_of_word()
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        out, factor = np.zeros(n, _U), 1
        for j in range(size):
            out += hashes[j : n + j] * _U(factor)
            factor = factor * _D % (1 << 64)
        return mix(out[at]), at


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    data, offsets = flat(texts)
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def give_back() -> None:
    """Freed memory goes back to the system: Python workers are used again, and would hold what another stage needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text; a longer text is a batch of its own."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, np.cumsum(size)
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()
