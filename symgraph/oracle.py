"""Compare a query with its DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def difference(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if names and rows agree."""
    names, expected = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in expected)
    have = Counter(tuple(_plain(r[n]) for n in order) for r in df.select(*order).collect())
    if want == have:
        return ""
    return f"{sum(have.values())} against {sum(want.values())} rows; extra {list((have - want).items())[:3]}, missing {list((want - have).items())[:3]}"
