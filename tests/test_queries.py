"""Every bound query against its SQL on the smallest tables."""

import os

import pytest

from symgraph.oracle import difference
from symgraph.plans.bindings import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, ORACLES[name], SF) == ""
    else:
        assert name == "slugify_ascii" and df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()  # test_whole_tables has it against brute force
