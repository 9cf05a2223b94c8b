"""Joins whose small side is broadcast only when it has been counted and is under a bound, and joins on keys of very unequal size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side that is broadcast at most, by its rows and the sizes that its arrays and texts have on average.
BROADCAST_BYTES = 32 << 20
#: A key with more than 1 / SHARE of all rows is hot; so there are SHARE such keys at most.
SHARE = 1000


def _bytes(small: DataFrame) -> Column:
    """Bytes of a row: 16 for each plain value, what is in its strings, binaries and arrays of plain values."""
    out = F.lit(16 * len(small.columns))
    for f in small.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            out = out + F.coalesce(F.greatest(F.size(f"`{f.name}`"), F.lit(0)) * 16, F.lit(0))
    return out


def fits(small: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table, which must be staged or cheap to read, has limit bytes at most."""
    return (small.agg(F.sum(_bytes(small))).first()[0] or 0) <= limit


def join_small(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """big joined with small, which must be staged or cheap to read: broadcast up to limit bytes, shuffled beyond."""
    return big.join(F.broadcast(small) if fits(small, limit) else small, on, how)


def join_skewed(big: DataFrame, small: DataFrame, on: str, n: str = "_n") -> DataFrame:
    """big joined with small by one column; n in small is how many rows of big the key has, and goes.

    Where small is too large to be broadcast, its hot keys are (SHARE rows at most), and the others' rows are shuffled, so
    that no task gets more than a SHARE of the rows for one key.
    """
    if fits(small):
        return big.join(F.broadcast(small.drop(n)), on)
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = small.filter(F.col(n) * SHARE > total).drop(n)
    cold = small.filter(F.col(n) * SHARE <= total).drop(n)
    parts = [big.join(F.broadcast(hot), on), big.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)]
    return reduce(DataFrame.unionByName, parts)
