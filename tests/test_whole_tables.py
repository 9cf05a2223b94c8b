"""Queries over whole tables reach all rows; what SQL can't express is held against brute force."""

import re
import unicodedata

from symgraph.operators import search
from symgraph.plans.bindings import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_no_query_takes_a_part_of_its_tables():
    assert set(QUERIES) - set(ORACLES) == {"slugify_ascii"}
    assert not [n for n, sql in ORACLES.items() if re.search(r"(key|quantity|doc_id) *(<|>|<=|>=) *\d", sql)]


def test_ask_links_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "ask", lambda nodes, edges, words: seen.append(edges) or nodes.selectExpr("id", "0.0 AS score"))
    QUERIES["ask_ranked"](spark, SF)
    assert seen[0].filter("source = 'd/999'").count() > 0


def test_slugs_of_whole_texts(spark):
    text = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["slug"] for r in QUERIES["slugify_ascii"](spark, SF).collect()}
    plain = lambda t: re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip("-")
    assert set(got) == set(text) and any(lang == "de" for lang, _ in text.values())
    bad = [(i, plain(t)[:80], got[i][:80]) for i, (_, t) in text.items() if t is not None and got[i] != plain(t)]
    assert not bad, bad[:2]
