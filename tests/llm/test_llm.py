"""Operators against brute force on a table of edge cases; see conftest."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from symgraph.llm import decontaminate, jaccard_join, language_id, line_dedup, lm_scoring, piece_fst, quality_rules, sharding, substring_dedup, url_filter

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def lower(t):
    return (t or "").encode().lower().decode()


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")


# 1


def removed_words(table):
    docs = [words(r["text"]) for r in table]
    seen = Counter(tuple(d[i : i + 35]) for d in docs for i in range(len(d) - 34))
    out = []
    for r, d in zip(table, docs, strict=True):
        gone = {j for i in range(len(d) - 34) if seen[tuple(d[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(w for j, w in enumerate(d) if j not in gone)
        out.append((r["doc_id"], len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(docs, no_docs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", 2)
        assert len(substring_dedup.hot_minimisers(docs)) > 3
    got = substring_dedup.remove_repeats(docs).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == removed_words(docs.collect())
    assert substring_dedup.remove_repeats(no_docs).count() == 0


# 2


def test_pieces_equal_the_library(docs, no_docs):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = piece_fst.encode_documents(docs)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    by_id = {r["doc_id"]: r for r in out.collect()}
    for doc_id, text in texts:
        r = by_id[doc_id]
        assert r["pieces"] == (None if text is None else lib.encode(text))
        assert r["n_pieces"] == len(r["pieces"] or []) and r["round_trip"] is (None if text is None else True)
    back = {r["doc_id"]: r["text"] for r in piece_fst.decode_documents(out).collect()}
    assert all(back[i] == t for i, t in texts)
    assert out.count() == docs.count() and piece_fst.encode_documents(no_docs).count() == 0


def test_pieces_of_random_texts():
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t, rng = piece_fst.Transducer(piece_fst.default_model()), random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice("abcde th  \n\té😀▁,.0") for _ in range(rng.randrange(40))).replace("a", " " * rng.randrange(1, 30))
        assert t.encode(s) == lib.encode(s)
        assert t.decode(t.encode(s)) == s.replace("▁", " ")


def test_memory_of_parts_is_bounded_within_a_text(monkeypatch):
    """Parts and pairs that are dropped are made again, with equal results."""
    words_ = [f"{a}{b}{c}" for a in "abcdefgh" for b in "stuvwxyz" for c in ("ing", "tion", "zq", "0", "é")]
    text = " ".join(words_ + words_[::3])
    want = piece_fst.Transducer(piece_fst.default_model()).encode(text)
    for name in ("MEMORY", "PAIRS"):
        monkeypatch.setattr(piece_fst, name, 50, raising=False)
    t = piece_fst.Transducer(piece_fst.default_model())
    assert t.encode(text) == want
    assert len(t.seen) <= 50 and len(t.older) <= 50 and len(t.pairs) <= 50


def _message(*fields):
    """A protocol-buffer message of (number, value): texts, messages, floats, whole numbers."""
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number * 8 + 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number * 8) + varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(number * 8 + 2) + varint(len(raw)) + raw
    return out


def test_unigram_pieces_are_the_shortest_path():
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "aba": -6.5, "▁a": -3.25, "ba": -5.0, "▁ab": -9.0, "c": -1.0, "cc": -2.0}
    pieces = [_message((1, "<unk>"), (2, 0.0), (3, 2))] + [_message((1, p), (2, s), (3, 1)) for p, s in scores.items()] + [_message((1, f"<0x{b:02X}>"), (2, 0.0), (3, 6)) for b in range(256)]
    model = b"".join(_message((1, p)) for p in pieces) + _message((2, _message((3, 1)))) + _message((3, _message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    t, rng, ids = piece_fst.Transducer(model), random.Random(2), {p: i + 1 for i, p in enumerate(scores)}

    def best(s):
        """The least cost of all segmentations; a character that is no piece costs the worst score and 10."""
        if not s:
            return 0.0, 1
        found = {}
        for k in range(1, len(s) + 1):
            cost = -scores[s[:k]] if s[:k] in scores else 16.5 + 2.5 if k == 1 and s[0] not in scores else None
            if cost is not None:
                rest, ways = best(s[k:])
                found.setdefault(round(cost + rest, 6), 0)
                found[round(cost + rest, 6)] += ways
        return min(found), found[min(found)]

    def parse(s):
        found = []

        def walk(at, own, cost):
            if at == len(s):
                found.append((cost, own))
            for k in range(1, len(s) - at + 1):
                p = s[at : at + k]
                if p in scores:
                    walk(at + k, [*own, ids[p]], cost - scores[p])
                elif k == 1:
                    walk(at + 1, own + [1 + len(scores) + b for b in p.encode()], cost + t.worst)
        walk(0, [], 0.0)
        return found

    for _ in range(300):
        s = "".join(rng.choice("aabbc x") for _ in range(rng.randrange(1, 9)))
        every = parse("▁" + s.replace(" ", "▁"))
        least = min(c for c, _ in every)
        got = t.encode(s)
        assert got in [own for c, own in every if abs(c - least) < 1e-6]
        assert t.decode(got) == s
    assert t.encode("cc") in ([ids["▁"], ids["cc"]], [ids["▁"], ids["c"], ids["c"]])  # a tie


def test_runs_of_blanks_take_linear_time():
    import time

    t = piece_fst.Transducer(piece_fst.default_model())
    plain = lambda n: __import__("sentencepiece").SentencePieceProcessor(model_proto=piece_fst.default_model()).encode(" " * n + "x")
    assert all(t.encode(" " * n + "x") == plain(n) for n in (1, 2, 3, 15, 16, 17, 33, 100))
    began = time.perf_counter()
    assert t.decode(t.encode(" " * 1_000_000 + "x")) == " " * 1_000_000 + "x"
    assert time.perf_counter() - began < 30


# 3


def shingles_of(line):
    x = " ".join(words(line))
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def kept_lines(table):
    at = {}
    for r in table:
        if r["text"] is not None:
            for i, line in enumerate(r["text"].split("\n")):
                if words(line):
                    at.setdefault(line, []).append((r["doc_id"], i))
    lines = list(at)
    sets = [shingles_of(line) for line in lines]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for i, line in enumerate(lines):
        best.setdefault(group[i], []).extend(at[line])
    return {min(x, key=lambda y: (y[0] is not None, y[0] or 0, y[1])) for x in best.values()}


def test_line_dedup(docs, no_docs):
    out = line_dedup.dedup(docs).collect()
    kept = kept_lines(docs.collect())
    for r in out:
        assert r["source"] is None or r["source"].startswith("src")
    plain = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in out:
        original = next(t for i, t in plain if i == r["doc_id"])
        if original is None:
            assert r["text"] is None and r["n_lines"] == 0 and r["removed"] is None
            continue
        want = [i for i, line in enumerate(original.split("\n")) if words(line) and (r["doc_id"], i) not in kept]
        assert r["removed"] == want and r["n_removed"] == len(want)
        assert r["text"] == "\n".join(x for i, x in enumerate(original.split("\n")) if i not in want)
    assert len(out) == docs.count()
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert line_dedup.dedup(no_docs).count() == 0


@pytest.mark.parametrize("small", [2, 1000])
def test_line_dedup_verifies_all_lines_of_a_band(spark, monkeypatch, small):
    """Similar lines in pairs under one template: unlike lines share bands, and few are similar to the one that comes first."""
    monkeypatch.setattr(line_dedup, "SMALL", small, raising=False)
    rng = random.Random(3)
    own = lambda n: [f"{rng.randrange(10**6):06d}q" for _ in range(n)]
    template, texts = [f"t{i:05d}x" for i in range(40)], []
    for _ in range(150):
        shared = own(8)
        texts += [" ".join(template + shared + own(4)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {i: set() for i in range(len(texts))}
    for r in line_dedup.keys(docs.toDF("id", "line")).collect():
        keys[r["id"]] |= set(r["keys"])
    want = {i + 1 for i in range(0, len(texts), 2) if keys[i] & keys[i + 1]}
    assert len(want) > 120
    got = {r["doc_id"] for r in line_dedup.dedup(docs).filter("n_removed = 1").collect()}
    assert want <= got and all(i % 2 for i in got)


def test_line_dedup_reads_whole_lines(spark):
    """Lines without blanks that begin alike are different, and those that differ in their beginning alone are not."""
    rng = random.Random(4)
    tail = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    copy, han, stamp = tail(150), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(120)), tail(60)
    texts = [f"https://{tail(12)}.example/{tail(20)}", f"https://{tail(12)}.example/{tail(20)}", han[:8] + han[20:60], han[:8] + han[60:], f"2026-11-01T{tail(30)}", f"2026-11-02T{tail(30)}", "AB" + copy, "xyz12" + copy, han[60:90] + "\u2028" + han[90:], "x\u2028 z", "x\u2028 y", f"1 {stamp}", f"\t1\x0b {stamp} "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.dedup(docs).filter("n_removed > 0").collect()}
    assert got == {7, 12}


def test_line_dedup_recall(spark):
    """Of the pairs with a similarity of 0.8 or more, by brute force and by length, 0.9 or more are caught, and no other line goes."""
    rng = random.Random(8)
    letters = "aaabcdeeefghiiklmnooprsttuvwy    "
    made = lambda n: " ".join("".join(rng.choice(letters) for _ in range(n)).split())
    texts, want, different = [], {}, set()
    for length, edits in ((12, 1), (30, 1), (60, 1), (110, 1), (130, 1), (130, 2), (250, 2), (600, 6), (2000, 18)):
        for _ in range(120):
            a = made(length)
            b = list(a)
            for _ in range(edits):
                b[rng.choice([0, len(b) - 1]) if length < 100 else rng.randrange(len(b))] = rng.choice("xyzq")
            b = "".join(b)
            x, y = shingles_of(a), shingles_of(b)
            near = 100 * len(x & y) >= 80 * len(x | y)
            if near and a != b:
                want.setdefault(length, set()).add(len(texts) + 1)
            elif a != b:
                different.add(len(texts) + 1)
            texts += [a, b]
    copy = "https://example.com/" + "p" * 30
    urls = [f"https://example.com/{x}" for x in ("alpha", "beta/2", "gamma?x=1", "delta")] + [copy + f"{i:03d}" * 40 for i in range(100, 130)]
    docs = spark.createDataFrame(list(enumerate(texts + urls)), "doc_id long, text string")
    gone = {r["doc_id"] for r in line_dedup.dedup(docs).filter("n_removed = 1").collect()}
    assert all(len(v) > 30 for v in want.values()) and len(want) == 7
    assert {n: len(v & gone) / len(v) for n, v in want.items() if len(v & gone) < 0.9 * len(v)} == {}
    assert len(set().union(*want.values()) & gone) >= 0.95 * sum(map(len, want.values()))
    assert not gone & different and not {i for i in gone if i >= len(texts)}


@pytest.mark.parametrize("held", [0, 10**6])
def test_components(spark, monkeypatch, held):
    """Paths, stars, self-links, repeated and null links, by rounds and in the driver, which takes one pass over the links."""
    from symgraph.llm import components

    rng = random.Random(12)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(50)] + [(-5, -5), (-7, 2**62), (None, 3), (4, None)]
    links += [(b, a) for a, b in links[:9]] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)]
    group = {x: x for a, b in links if None not in (a, b) for x in (a, b)}
    for a, b in links:
        if None not in (a, b):
            low, high = sorted((group[a], group[b]))
            group = {x: low if g == high else g for x, g in group.items()}
    monkeypatch.setattr(components, "HELD_LINKS", held)
    made, plain = [], components.staged_with_path
    monkeypatch.setattr(components, "staged_with_path", lambda *a: made.append(1) or plain(*a))
    rng.shuffle(links)
    got = [tuple(r) for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()]
    assert sorted(got) == sorted(group.items()) and (len(made) == 1) == (held > 0)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup_deals_pairs_out_by_their_characters(spark, monkeypatch):
    """Pairs of small bytes and many shingles go to as many tasks as their counts need; what is similar stays the same."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(60)]
    texts += [t[:380] + "z" * 20 for t in texts[:30]] + ["y" * 200 + t[200:] for t in texts[30:]]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    pairs = spark.createDataFrame([(i, i + 60) for i in range(60)], "u long, v long")
    monkeypatch.setattr(line_dedup, "VERIFIED", 2000, raising=False)
    spark.sparkContext.setJobGroup("verified", "")
    got = {tuple(r) for r in line_dedup.verified(pairs, lines).collect()}
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("verified") for s in tracker.getJobInfo(j).stageIds]
    assert max(x.numTasks for x in stages if x) >= 60 * 800 // 2000
    x = {i: shingles_of(t) for i, t in enumerate(texts)}
    assert got == {(i, i + 60) for i in range(60) if 100 * len(x[i] & x[i + 60]) >= 80 * len(x[i] | x[i + 60])} and len(got) == 30


def test_line_dedup_maps_no_line_whose_bands_are_settled(spark, monkeypatch):
    """Pairs of copies need no maps of their shingles."""
    rng, plain, mapped = random.Random(13), line_dedup._maps, []
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    texts += [t[:-1] + "z" for t in texts]
    monkeypatch.setattr(line_dedup, "_maps", lambda own: mapped.append(own.count()) or plain(own))
    gone = line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("n_removed = 1").collect()
    assert {r["doc_id"] for r in gone} == set(range(40, 80)) and mapped == [0]


def test_line_dedup_of_a_large_band(spark):
    """Thousands of lines in one band, of which few are similar."""
    rng = random.Random(9)
    head = " ".join(f"w{rng.randrange(1000):03d}" for _ in range(60))
    tails = [" ".join(f"t{rng.randrange(100000):05d}" for _ in range(16)) for _ in range(1500)]
    texts = [f"{head} {x}" for x in tails] + [f"{head} {x}!" for x in tails[:200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    gone = {r["doc_id"] for r in line_dedup.dedup(docs).filter("n_removed = 1").collect()}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert not near(shingles_of(texts[0]), shingles_of(texts[1])) and near(shingles_of(texts[0]), shingles_of(texts[1500]))
    assert gone <= set(range(1500, 1700)) and len(gone) > 190


def test_line_dedup_verifies_few_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Copies of one passage with few to many edits: all similar pairs that share a band end in one group, and what is verified doesn't grow with the square."""
    rng, verified, seen = random.Random(10), line_dedup.verified, []
    passage = [f"p{rng.randrange(10**4):04d}" for _ in range(60)]
    texts = [" ".join(f"e{rng.randrange(10**5):05d}" if rng.random() < edits else w for w in passage) for edits in (0.02, 0.06, 0.12, 0.2) for _ in range(100)]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    keys = {i: set() for i in range(len(texts))}
    for r in line_dedup.keys(lines).collect():
        keys[r["id"]] |= set(r["keys"])
    sets, group = [shingles_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {i for i in range(len(texts)) if i > min(k for k in range(len(texts)) if group[k] == group[i])}
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, known: seen.append(pairs.count()) or verified(pairs, known))
    monkeypatch.setattr(line_dedup, "SMALL", 2, raising=False)
    monkeypatch.setattr(line_dedup, "BLOCK", 100, raising=False)
    got = {r["doc_id"] for r in line_dedup.dedup(lines.toDF("doc_id", "text")).filter("n_removed = 1").collect()}
    assert got == want and 100 < len(want) < len(texts) - 50
    assert sum(seen) < 12 * len(texts)


# 4


URLS = [
    None, "", "no scheme", "https://www.example.net/en/1", "http://example.net/de/1", "http://EXAMPLE.com/de/x?q#f", "http://m.example.com/DE/x", "https://a.org/fr/1", "https://a.org/fr", "http://x.net", "http://x.net?/", "http://notexample.net/en/",
    "http://freecasino.example.com/free/casino/3", "http://opengarden.example.org/open/garden/2", "http://casino-free.net/casino", "http://free.net/casino/free", "https://garden.example.org/fr/open-garden", "https://open.b.org/fr/garden/open", "https://" + "a" * 50000 + ".example.com/en/" + "b" * 5000, "http://gardengarden.com/",
]


def test_url_filters(spark):
    urls = URLS
    table = spark.createDataFrame([(None if i == 1 else i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    out = url_filter.judge(table).collect()
    got = {r["page_id"]: r for r in out}
    rule = {i: got[i]["rule"] for i in got}
    assert (rule[3], rule[4], rule[5], rule[6], rule[7], rule[8]) == ("example.net/en/", "net/", "example.com/de/", None, "org/fr/", None)
    assert (rule[9], rule[10], rule[11], rule[0]) == (None, None, "net/", None)
    assert (got[5]["host"], got[5]["path"], got[10]["host"], got[10]["path"]) == ("example.com", "/de/x", "x.net", "")
    assert [got[i]["verdict"] for i in (3, 4, 5, 7)] == ["allow", "block", "block", "allow"]
    assert got[12]["verdict"] == "block" and got[13]["verdict"] == got[0]["verdict"] == got[2]["verdict"] == "allow"
    assert got[12]["words"][:2] == ["free", "casino"] and got[13]["words"][:2] == ["open", "garden"]
    assert url_filter.judge(table.limit(0)).count() == 0
    # The model again, from the returned rows alone.
    counts, urls_of, kinds = {"block": Counter(), "allow": Counter()}, Counter(), ("h:", "p:")

    def tokens(r):
        cut = url_filter.learn_words(spark.createDataFrame([(x["host"], x["path"]) for x in out], "host string, path string")) if not hasattr(tokens, "cut") else tokens.cut
        tokens.cut = cut
        return url_filter.tokens_of(r["host"], r["path"], cut)

    for r in out:
        if r["rule"] is not None:
            urls_of[r["verdict"]] += 1
            counts[r["verdict"]].update(tokens(r))
    names = set(counts["block"]) | set(counts["allow"]) | {k + "*" for k in kinds}
    total = {c: sum(x.values()) for c, x in counts.items()}
    odds = lambda t: math.log((counts["block"][t] + 0.5) / (total["block"] + 0.5 * len(names)) * (total["allow"] + 0.5 * len(names)) / (counts["allow"][t] + 0.5))
    prior = math.log((urls_of["block"] + 0.5) / (urls_of["allow"] + 0.5))
    for r in out:
        ts = tokens(r)
        want = prior + sum(odds(t if t in names else t[:2] + "*") for t in ts) if ts else 0.0
        assert abs(r["score"] - want) < 1e-6
        assert r["verdict"] == ("block" if want > 0 else "allow") or r["rule"] is not None


def test_segmentation_is_the_best_one():
    import time

    counts = {"free": 50, "casino": 20, "casinos": 3, "s": 9, "ino": 4, "cas": 7, "fre": 2, "e": 5}
    total, rng = 130, random.Random(5)
    cut = url_filter.Segmenter(counts, total)
    letter = math.log(total) + 1

    def least(name):
        if not name:
            return 0.0
        return min([letter + least(name[1:])] + [math.log(total / counts[name[:k]]) + least(name[k:]) for k in range(1, len(name) + 1) if name[:k] in counts])

    for _ in range(200):
        name = "".join(rng.choice(["free", "cas", "ino", "casino", "s", "x", "zz", "e"]) for _ in range(rng.randrange(1, 5)))[:14]
        got = cut.words(name)
        assert "".join(got) == name
        cost = sum(math.log(total / counts[w]) if w in counts else letter * len(w) for w in got)
        assert cost <= least(name) + 1e-9
    began = time.perf_counter()
    assert "".join(cut.words("casinofreexq" * 10_000)) == "casinofreexq" * 10_000
    assert time.perf_counter() - began < 20


# 5


def test_lm_scoring(docs, no_docs):
    table = docs.collect()
    texts = [lower(r["text"]).split(" ") and words(lower(r["text"])) + [None] for r in table]
    held = [zlib.crc32(("null" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2 for r in table]
    counts = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r["doc_id"]), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t, h in zip(table, texts, held, strict=True))
    got = lm_scoring.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(-1e6 < r["score"] < 0 for r in got)
    assert lm_scoring.score(no_docs).count() == 0


def test_attention_is_causal_and_sums_to_one():
    import numpy as np

    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50, 400)
    counts = np.bincount(ids, minlength=lm_scoring.VOCABULARY)
    m = lm_scoring.build(counts, [ids[i : i + 33] for i in range(0, 360, 30)])
    rows = m.row[rng.integers(0, 50, (2, lm_scoring.WINDOW))]
    a = lm_scoring.forward(m.weights, rows)[0]
    later = rows.copy()
    later[:, 20:] = m.row[7]
    b = lm_scoring.forward(m.weights, later)[0]
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5)
    p = np.exp(a[0, 5] - a[0, 5].max())
    p /= p.sum()
    assert abs((p[m.cls] * np.exp(m.within)).sum() - 1) < 1e-3
    long = [ids, ids[:10]]
    assert np.allclose(m.log_probs(long)[1], m.log_probs([ids[:10]])[0], rtol=1e-4)


def test_scores_equal_a_plain_recomputation():
    """Window by window, with loops in place of batched products."""
    import numpy as np

    rng = np.random.default_rng(3)
    ids = [np.append(rng.integers(0, 40, n), lm_scoring.END) for n in (0, 5, 63, 64, 65, 150)]
    counts = np.bincount(np.concatenate(ids), minlength=lm_scoring.VOCABULARY)
    m = lm_scoring.build(counts, [np.concatenate(([lm_scoring.END], x))[:65] for x in ids])
    w, size, step = {k: v.astype(np.float64) for k, v in m.weights.items()}, lm_scoring.WIDTH, lm_scoring.WINDOW - lm_scoring.CONTEXT

    def plain(text):
        before, total, at = np.concatenate(([lm_scoring.END], text[:-1])), 0.0, 0
        while at < len(text):
            lo = max(0, at - lm_scoring.CONTEXT)
            rows = m.row[before[lo : lo + lm_scoring.WINDOW]]
            x = w["in"][rows] + w["pos"][: len(rows)]
            for i in range(at - lo, len(rows)):
                q = x[i] @ w["q"] * size**-0.5
                s = np.exp([q @ (x[j] @ w["k"]) for j in range(i + 1)])
                y = sum(a * (x[j] @ w["v"]) for j, a in enumerate(s / s.sum()))
                h = np.tanh(np.concatenate((x[i], y)) @ w["mix"] + w["mix_b"])
                logits = h @ w["out"] + w["bias"] + w["last"][rows[i]]
                target = text[lo + i]
                total += logits[m.cls[target]] - np.log(np.exp(logits).sum()) + m.within[target]
            at = lo + lm_scoring.WINDOW
        return total

    assert step == 48 and np.allclose(m.log_probs(ids), [plain(x) for x in ids], rtol=1e-3)
    other = b"x\0" + b"\n".join(__import__("base64").b64encode(bytes([b])) + b" %d" % b for b in range(256))
    ranks = lm_scoring.default_ranks().partition(b"\0")[0] + b"\0" + other.partition(b"\0")[2]
    assert lm_scoring.subwords([b"hello world"], lm_scoring.default_ranks())[0].tolist() != lm_scoring.subwords([b"hi"], ranks)[0].tolist() == [32, 104, 105, 256]


def test_model_counts_all_pairs_and_grows(spark, monkeypatch):
    """Word order that only documents outside the sampled windows have is learned; blocks of windows grow with the documents."""
    import numpy as np

    rng, seen = random.Random(6), []
    texts = [" ".join(rng.choice(["red", "blue", "green", "one", "two"]) for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for name, value in (("SAMPLE_DOCS", 8), ("DOCS_PER_BLOCK", 40), ("STEPS", 3), ("SAMPLE_WINDOWS", 1), ("PAIRS_AT_ONCE", 5)):
        monkeypatch.setattr(lm_scoring, name, value, raising=False)
    plain = lm_scoring._gradient
    monkeypatch.setattr(lm_scoring, "_gradient", lambda *a: seen.append(1) or plain(*a))
    ranks = lm_scoring.default_ranks()
    m = lm_scoring.learn(docs, ranks)
    assert len(seen) == 6  # STEPS for each block of 40
    ids = [np.concatenate(([lm_scoring.END], x)) for x in lm_scoring.subwords([t.encode() for t in texts], ranks)]
    after = np.zeros_like(m.weights["last"], dtype=np.float64)
    for x in ids:
        np.add.at(after, (m.row[x[:-1]], m.cls[x[1:]]), 1)
    total = np.bincount(m.cls, np.bincount(np.concatenate([x[1:] for x in ids]), minlength=lm_scoring.VOCABULARY) + 0.01, after.shape[1]) + 1e-3
    want = np.log((after + lm_scoring.PRIOR * total / total.sum()) / (after.sum(1, keepdims=True) + lm_scoring.PRIOR))
    assert np.allclose(m.weights["last"], want, atol=1e-4)


def test_weights_are_trained_on_all_windows(spark, monkeypatch):
    """Each subword of each training document is a target of some step, in both blocks, long texts and many documents alike."""
    import numpy as np

    rng, seen = random.Random(9), []
    texts = [" ".join(rng.choice(["red", "blue", "green"]) for _ in range(rng.choice([0, 3, 63, 64, 300]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, value in (("SAMPLE_DOCS", 4), ("SAMPLE_WINDOWS", 1), ("DOCS_PER_BLOCK", 20), ("STEPS", 2), ("BATCH", 1)):
        monkeypatch.setattr(lm_scoring, name, value, raising=False)
    plain = lm_scoring._gradient
    monkeypatch.setattr(lm_scoring, "_gradient", lambda w, rows, target, real: seen.append(target[real]) or plain(w, rows, target, real))
    ranks = lm_scoring.default_ranks()
    m = lm_scoring.learn(docs, ranks)
    want = np.concatenate([m.cls[x] for x in lm_scoring.subwords([t.encode() for t in texts], ranks)])
    got = np.bincount(np.concatenate(seen), minlength=m.cls.max() + 1)
    assert len(seen) == 4 and (got >= np.bincount(want, minlength=m.cls.max() + 1)).all() and got.sum() < want.size + 2 * lm_scoring.WINDOW * 2


def test_large_inputs_are_trained_by_tasks(spark, monkeypatch):
    """Beyond TRAINED_HERE subwords tasks train, on every subword; the driver gets no ids, and the weights learn what stands two words before."""
    import numpy as np

    rng, trained = random.Random(11), []
    texts = []
    for _ in range(300):
        text = ["red"]
        while len(text) < rng.choice([3, 80, 81]):
            text += [rng.choice(["one", "two"]), {"red": "blue", "blue": "green", "green": "red"}[text[-1]]]
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for name, value in (("TRAINED_HERE", 0), ("DOCS_PER_BLOCK", 60), ("SLICES", 3), ("BATCH", 1)):
        monkeypatch.setattr(lm_scoring, name, value)
    monkeypatch.setattr(lm_scoring, "train_here", lambda *a: pytest.fail("ids came to the driver"))
    plain = lm_scoring.averaged
    monkeypatch.setattr(lm_scoring, "averaged", lambda parts: trained.append([n for n, _ in parts]) or plain(parts))
    m = lm_scoring.learn(docs, lm_scoring.default_ranks())
    ids = lm_scoring.subwords([t.encode() for t in texts], lm_scoring.default_ranks())
    assert sum(map(sum, trained)) == sum(map(len, ids)) and len(trained) > 2 and max(map(len, trained)) == 3
    size = np.array([len(x) for x in ids])
    with_it, without = (m.score(np.concatenate(ids), size, attention=a).sum() for a in (True, False))
    assert with_it > 0.8 * without  # natural logarithms, below zero


def test_driver_holds_ids_of_one_block_at_a_time(spark, monkeypatch):
    """Training takes about two bytes a subword of one block in the driver, however many blocks there are, and no window twice."""
    import gc
    import weakref

    import numpy as np

    live, most, seen = weakref.WeakSet(), [], []
    plain = lm_scoring.block_of

    class Held(lm_scoring.Block):
        __hash__ = object.__hash__

    def made(texts, end):
        gc.collect()
        most.append(len(live))
        b = plain(texts, end)
        b = Held(b.ids, b.begin, b.length)
        live.add(b)
        seen.append((b.ids.nbytes, int((b.length - 1).sum())))
        return b

    monkeypatch.setattr(lm_scoring, "block_of", made)
    for name, value in (("SUBWORDS_PER_BLOCK", 4000), ("STEPS", 2)):
        monkeypatch.setattr(lm_scoring, name, value)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["red", "blue", "green"]) for _ in range(200)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    lm_scoring.learn(docs, lm_scoring.default_ranks())
    total = sum(len(x) for x in lm_scoring.subwords([t.encode() for t in texts], lm_scoring.default_ranks()))
    assert len(seen) == -(-total // 4000) > 3 and max(most) == 0  # long documents make more blocks
    assert sum(n for _, n in seen) == total and all(size < 2.1 * n + 100 for size, n in seen)


def test_gradient_equals_differences():
    import numpy as np

    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 40, 65) for _ in range(5)]
    m = lm_scoring.build(np.bincount(np.concatenate(ids), minlength=lm_scoring.VOCABULARY), ids)
    w = {k: v.astype(np.float64) for k, v in m.weights.items()}
    rows, target = (np.stack([f[x[k]] for x in ids]) for f, k in ((m.row, slice(None, -1)), (m.cls, slice(1, None))))
    real = rng.random(rows.shape) < 0.8
    g = lm_scoring._gradient(w, rows, target, real)[1]
    for name in ("in", "pos", "q", "k", "v", "mix", "mix_b", "out", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        loss = []
        for step in (1e-4, -1e-4):
            other = {k: v.copy() for k, v in w.items()}
            other[name][at] += step
            loss.append(lm_scoring._gradient(other, rows, target, real)[0])
        assert np.isclose((loss[0] - loss[1]) / 2e-4, g[name][at], rtol=1e-3, atol=1e-6), name


# 6


def test_sharding(docs, no_docs):
    got = sharding.shards(docs).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 1, zlib.crc32(text[r["doc_id"]].encode())) for r in got)
    assert sharding.shards(no_docs).count() == 0


def test_sharding_cuts_few_links(spark):
    """Sizes stay equal while the links cut fall, down to a share above those that no dealing can keep."""
    rows = [(i, "big") for i in range(150)] + [(200 + i, f"pair {i // 3}") for i in range(300)] + [(None, None), (None, ""), (7, "big")]
    docs, trace = spark.createDataFrame(rows, "doc_id long, text string"), []
    got = sharding.shards(docs, trace).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert trace == sorted(trace, reverse=True) and len(trace) > 1
    groups = {}
    for r in got:
        groups.setdefault(r["text_crc32"], Counter())[r["shard"]] += 1
    cut = sum(sum(c.values()) - max(c.values()) for c in groups.values())
    unlinked = 151 - max(sizes.values())  # the big group fills two shards and part of a third
    assert cut == trace[-1] and unlinked <= cut and 3 * (cut - unlinked) <= trace[0] - unlinked
    assert zlib.crc32(b"") in groups
    if len(groups[zlib.crc32(b"big")]) > 4:
        pytest.xfail("a group larger than a shard leaves members in shards where no swap comes back for them: a known weakness, in the README")


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i % 40}" if i < 120 else f"alone {i}") for i in range(400)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where = {}
    for r in got:
        if r["doc_id"] < 120:
            where.setdefault(r["doc_id"] % 40, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 4
    assert set(Counter(r["shard"] for r in got).values()) == {50}


# 7


def test_language_id(spark, docs, no_docs):
    got = {r["doc_id"]: r for r in language_id.predict_documents(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 13))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["lang_pred"] in ("en", "fr")
    assert language_id.predict_documents(no_docs).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in real.collect()}
    held = [r for r in language_id.predict_documents(real).collect() if r["held_out"]]
    assert len(held) > 20 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert {r["doc_id"] for r in language_id.keep_known(docs).collect()}.isdisjoint({0, 1, 2, 13})


def test_inference_equals_plain_em():
    import numpy as np

    rng = np.random.default_rng(2)
    n = np.array([1, 3, 20, 40, 7, 60])
    likely = (rng.normal(size=(n.sum(), 6)) * 4 - 20).astype(np.float32)
    first = np.cumsum(n) - n
    likely[first[3] : first[3] + 40] += np.repeat(np.eye(6)[:5], 8, 0).astype(np.float32) * 30  # five languages in equal parts
    top, score = language_id.infer(likely, n)

    def rounds(p, share, k):
        fit = 0.0
        for _ in range(k):
            joint = p * share
            fit = np.log(np.maximum(joint.sum(1), 1e-30)).sum()
            share = (joint / np.maximum(joint.sum(1), 1e-30)[:, None]).mean(0)
        return share, fit

    for d, (a, k) in enumerate(zip(first, n, strict=True)):
        p = np.exp(likely[a : a + k].astype(float) - likely[a : a + k].max(1, keepdims=True))
        share, _ = rounds(p, np.full(6, 1 / 6), language_id.ROUNDS)
        order, best, chosen = np.argsort(-share, kind="stable"), -np.inf, None
        for m in range(1, 7):
            held = np.zeros(6)
            held[order[:m]] = np.maximum(share[order[:m]], 1e-3)
            own, fit = rounds(p, held / held.sum(), language_id.SET_ROUNDS if m > 1 else 1)
            worth = fit - (m - 1) * (language_id.PENALTY + 0.5 * np.log(k))
            if worth <= best:
                break
            best, chosen = worth, own
        assert top[d] == chosen.argmax() and abs(score[d] - chosen.max()) < 1e-3
        if d == 3:
            assert (chosen > 0.1).sum() == 5


def test_language_of_ties_and_null_ids(spark):
    rows = [(None, "one two", "en"), (1, "un deux", "fr"), (2, "un deux", "en"), (None, None, None), (3, "!!!", "en")]
    got = language_id.predict_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 5 and all(isinstance(r["held_out"], bool) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {zlib.crc32(b"null") % 4 == 2}


# 8


def components(table):
    sets = []
    for r in table:
        w = words(lower(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = [r["doc_id"] for r in table]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and None not in (table[i]["doc_id"], table[j]["doc_id"]) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return sorted(((r["doc_id"], len(s), g) for r, s, g in zip(table, sets, group, strict=True)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(docs, no_docs, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 2), ("LEAF", 2), ("HOT_LEAST", 2)):
            monkeypatch.setattr(jaccard_join, name, value)
    assert sorted(map(tuple, jaccard_join.link(docs).collect()), key=str) == components(docs.collect())
    if small:
        assert jaccard_join.link(no_docs).count() == 0
        kept = jaccard_join.keep_one(docs)
        assert kept.columns == docs.columns
        first = {c for i, _, c in components(docs.collect()) if i is not None}
        assert {r["doc_id"] for r in kept.collect()} == first | {None}


def test_jaccard_join_ties_all_texts_of_a_doc_id(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (5, b), (5, c), (1, a), (7, c), (8, d), (9, None), (5, None), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.link(docs).collect()}
    assert got == {(5, 36): 1, (1, 36): 1, (7, 36): 1, (8, 36): 8, (9, 0): 9, (5, 0): 5}
    kept = sorted((r["doc_id"], r["text"] or "") for r in jaccard_join.keep_one(docs).collect())
    assert kept == sorted([(1, a), (5, b), (5, c), (8, d), (9, ""), (5, "")])


def test_jaccard_join_leaves_out_sets_far_in_size(spark, monkeypatch):
    """Short texts out of long ones share tokens with them, but never come to the trees; those near in size do, and link."""
    long = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(6)]
    short = [" ".join(t.split()[k : k + 5]) for t in long for k in range(0, 196, 4)]
    near = [long[0] + " more", " ".join(long[1].split()[30:])]
    docs = spark.createDataFrame(list(enumerate(long + short + near)), "doc_id long, text string")
    seen, plain = [], jaccard_join._join_in_trees
    monkeypatch.setattr(jaccard_join, "_join_in_trees", lambda rows, best: seen.append({r["n_shingles"] for r in rows.select("n_shingles").collect()}) or plain(rows, best))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs).collect()}
    assert seen[0] == {196, 197, 166}
    last = len(long + short)
    assert got == {i: {last: 0, last + 1: 1}.get(i, i) for i in range(last + 2)}


def test_jaccard_join_leaves_out_tokens_early_in_no_set(spark, monkeypatch):
    """Tokens that no set has among its first ninth never come to the trees; sets of all sizes about the limit link as by brute force."""
    import pyarrow as pa

    rng, texts = random.Random(13), []
    for n in list(range(5, 60, 4)) + [100, 150, 200]:
        base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.5, 0.8, 0.82, 0.86, 0.9, 0.95):
            k = max(1, round(n * share))
            other = [f"v{rng.randrange(10**7)}" for _ in range(n - k)]
            texts += [" ".join(base[:k]), " ".join(base[:k] + other[: (n - k) // 2]), " ".join(base[n - k :] + other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, plain = [], jaccard_join._join_in_trees
    monkeypatch.setattr(jaccard_join, "_join_in_trees", lambda rows, best: seen.append({r["token"] for r in rows.select("token").collect()}) or plain(rows, best))
    assert sorted(map(tuple, jaccard_join.link(docs).collect()), key=str) == components([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    sizes, tokens = jaccard_join.shingle_sets(pa.array(texts))
    first = sizes.cumsum() - sizes
    early = {t for a, n in zip(first.tolist(), sizes.tolist(), strict=True) for t in tokens[a : a + n - -(-160 * n // 180) + 1].tolist()}
    assert seen[0] and seen[0] <= early


def test_jaccard_join_of_a_frequent_token_and_long_sets(spark, monkeypatch):
    """Thousands of unlike sets share a token; sets of all sizes, some of thousands of tokens, link as by brute force."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "LAST_BLOCK", 512)
    rng = random.Random(12)
    rows = [(i, f"the same five words again {rng.randrange(10**9)} {rng.randrange(10**9)}") for i in range(3000)]
    for n in (10, 300, 500, 2000, 7000):
        base = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        near = [x if k % 100 else "edit" for k, x in enumerate(base)] if n > 100 else base + ["one"]
        far = [x if k % 9 else "edit" for k, x in enumerate(base)]
        rows += [(10_000 + 10 * n + j, " ".join(x)) for j, x in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(docs).collect() if r["component_id"] != r["doc_id"]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(t)) for i, t in rows)}
    want = {}
    for n in (10, 300, 500, 2000, 7000):
        at = 10_000 + 10 * n
        for j in (1, 2):
            if 100 * len(sets[at] & sets[at + j]) >= 80 * len(sets[at] | sets[at + j]):
                want[at + j] = at
    assert len(want) == 5 and got == want


# 9


def test_decontamination(spark, docs, no_docs):
    table = docs.collect()
    long = words(next(r["text"] for r in table if r["doc_id"] == 11))
    items = [(0, " ".join(long[100:130])), (1, " ".join(long[900:914]).upper()), (2, None), (3, ""), (4, "one"), (5, "One two"), (6, " ".join(long[50:70] + ["zzz"] + long[70:90])), (7, "nothing like it in any of these documents at all ever"), (7, "a a a a a a a a"), (8, "theta iota")]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, th long")
    want = set()
    for r in table:
        w = words(lower(r["text"]))
        for i, t in items:
            b = words(lower(t))
            g = min(5, len(b))
            c = Counter(tuple(b[k : k + g]) for k in range(len(b) - g + 1)) if b else Counter()
            for s in range(max(1, len(w) - len(b) + 1)):
                own = w[s : s + len(b)]
                d = Counter(tuple(own[k : k + g]) for k in range(len(own) - g + 1)) if c else Counter()
                if d and 100 * sum((c & d).values()) >= 80 * sum((c | d).values()):
                    want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(docs, benchmark).collect()}
    assert got == want and {(11, 0), (11, 1), (3, 4), (4, 5)} <= got
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in table if r["doc_id"] not in {i for i, _ in want})
    assert decontaminate.report(no_docs, benchmark).count() == 0 and decontaminate.report(docs, benchmark.limit(0)).count() == 0


# 10


def test_quality_rules(docs, no_docs):
    def measure(r):
        t = r["text"] or ""
        w = words(t)
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        return (r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))

    table = quality_rules.apply_policy(quality_rules.ledger(docs)).cache()
    got = sorted((tuple(r) for r in table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted(map(measure, docs.collect()), key=str)
    assert table.filter("base_failed AND kept").count() == 0
    report = {r["rule"]: r for r in quality_rules.ablation(table).collect()}
    few = table.filter("failure_bits & 1 <> 0").count()
    assert report["too_few_words"]["n_failed"] == few and set(report) == set(quality_rules.POLICIES["v2"])
    assert quality_rules.ledger(no_docs).count() == 0
