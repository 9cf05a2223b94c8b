"""Chunks of documents meet in buckets and get answers back.

A chunk is about textchunk.CHUNK_BYTES of text of one input partition. It sends each
bucket one compressed blob of what it has for it, and itself one blob of what it needs
later. Keys of a bucket are distinct within a chunk before anything moves, so a key
that every document holds arrives once per chunk, not once per document. Answers go
back to the chunk, one blob per bucket that has any.

Rows: (key, kind, chunk, part, blob). Chunk ids come from the input partition and the
order within it, so a task that is run again sends the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key long, kind int, chunk long, part int, blob binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Kind of a chunk's own blob; what else is sent has larger kinds.
OWN = 0
#: Of the compression; what is sent is mostly text, and the disk of a shuffle costs more than the time.
LEVEL = 6
#: Bytes of blobs in an Arrow batch.
BATCH = 8 << 20

Row = tuple[int, int, int, int, bytes]


#: Bytes of text for each bucket beyond which there are more of them.
BUCKET_TEXT = 16 << 20


def n_buckets(spark: SparkSession, size: int = 0) -> int:
    """Some buckets for each shuffle partition, so that hashing them out is even, and more for more text (size, in bytes)."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_TEXT)


def size_of(df: DataFrame) -> int:
    """Bytes of a table by the optimizer's statistics, which read nothing; 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def n_parts(spark: SparkSession, n: int) -> int:
    """Partitions for n buckets."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4)


def pack(x) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else pickle.dumps(x, protocol=5), LEVEL)


def column(values: pa.Array) -> np.ndarray:
    """A copy of a column for pack(); pickling a slice of an Arrow array takes the whole array along."""
    return np.array(values.to_pylist(), object)


def unpack(blob: bytes) -> bytes:
    return zstandard.decompress(blob)


def load(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def chunk_id(seq: int) -> int:
    return (TaskContext.get().partitionId() << 32) | seq


def batches_of(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], NAMES)

    for row in rows:
        held.append(row)
        size += len(row[4]) + 64
        if size > BATCH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for batch in batches:
        keys, kinds, chunks, parts = (batch.column(c).to_pylist() for c in NAMES[:4])
        blobs = batch.column("blob")
        for i in range(batch.num_rows):
            yield keys[i], kinds[i], chunks[i], parts[i], blobs[i].as_py()


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Row]]]:
    return groupby(rows_of(batches), key=lambda r: r[0])


def _dealt(rows: DataFrame, n: int | None) -> DataFrame:
    return (rows.repartition(n, "key") if n else rows.repartition("key")).sortWithinPartitions("key", "kind", "chunk", "part")


def send(docs: DataFrame, split: Callable[[Iterator[pa.RecordBatch]], Iterator[Row]]) -> DataFrame:
    """Rows of split, which cuts a partition into chunks. Keys of buckets count from 0; a chunk's own rows have key ~chunk."""
    return docs.mapInArrow(lambda b: batches_of(split(b)), SCHEMA)


def answer(rows: DataFrame, reply: Callable[[int, list[Row]], Iterator[Row]], n: int | None = None) -> DataFrame:
    """Rows to the chunks: chunks' own rows, and the replies of each bucket to what it got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_out() -> Iterator[Row]:
            for key, group in by_key(batches):
                if key < 0:
                    for row in group:
                        yield (row[2], *row[1:])
                else:
                    yield from reply(key, list(group))

        yield from batches_of(rows_out())

    return _dealt(rows, n).mapInArrow(run, SCHEMA)


def collect(rows: DataFrame, finish: Callable[[object, list[Row]], pa.RecordBatch], schema: str, n: int | None = None) -> DataFrame:
    """finish(a chunk's own content, its answers) for every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches):
            own, *rest = group
            yield finish(load(own[4]), rest)

    return _dealt(rows, n).mapInArrow(run, schema)


def bits(flags: np.ndarray) -> bytes:
    return pack(np.packbits(flags).tobytes())


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpack(blob), np.uint8), count=n).astype(bool)
