"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
from symgraph.session import staged

SF = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t.lower()) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(staged(stage(spark, held[-1], SF), name))
    rows = [{r["doc_id"]: r for r in x.collect()} for x in held]
    assert all(x.columns == docs.columns for x in held[:-1])
    assert set(rows[1]) == {i for i, r in rows[0].items() if any(c.isalpha() for c in r["text"] or "")}
    lines = lambda t: [x for x in t.split("\n") if words(x)]
    kept = Counter(x for r in rows[2].values() for x in lines(r["text"]))
    assert max(kept.values()) == 1 and set(kept) <= {x for r in rows[1].values() for x in lines(r["text"])}
    sets = {i: shingles(r["text"]) for i, r in rows[2].items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert set(rows[3]) == set(group.values())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for i, r in rows[3].items():
        w = words(r["text"])
        for b in items:
            c = Counter(tuple(b[k : k + 5]) for k in range(len(b) - 4))
            if not c.keys() & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
                continue
            for s in range(max(1, len(w) - len(b) + 1)):
                d = Counter(tuple(w[k : k + 5]) for k in range(s, s + min(len(b), len(w)) - 4))
                if 100 * sum((c & d).values()) >= 80 * sum((c | d).values()):
                    bad.add(i)
    assert bad and set(rows[4]) == set(rows[3]) - bad
    assert set(rows[5]) == set(rows[4]) and all(r["round_trip"] for r in rows[5].values())
