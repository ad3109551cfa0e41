import random
from collections import Counter
from itertools import combinations

import numpy as np

from millrace.llm import minhash
from tests.llm.helpers import components, prose, word


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(draw, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[draw.randrange(len(words))] = word(draw)
    return " ".join(words)


def brute(rows):
    sets = {}
    for key, text in rows:
        sets.setdefault(key, set()).add(frozenset(shingles(text)))
    flat = [(k, s) for k, group in sets.items() if k is not None for s in group if s]
    links = [(a, b) for (a, s), (b, t) in combinations(flat, 2) if 100 * len(s & t) >= 85 * len(s | t)]
    return components([k for k in sets if k is not None], links)


def test_against_brute_force(spark):
    draw = random.Random(6)
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three")]
    key = 10
    for size, words, edits in ((1, 100, 0), (60, 300, 3), (45, 200, 2), (12, 400, 8), (25, 150, 1), (30, 30, 0), (8, 60, 1), (40, 500, 14)):
        base = prose(draw, words)
        for _ in range(size):
            rows.append((key, edited(draw, base, draw.randint(0, edits))))
            key += 1
    rows += [(key + i, prose(draw, draw.randint(1, 120))) for i in range(150)]
    rows += [(20, rows[17][1]), (20, rows[30][1]), (999, "w " * 40_000)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 0, True) for k, t in rows], "doc_id long, text string, rep int, kept boolean")
    out = minhash.near_duplicates(docs).collect()
    want = brute(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in out) == Counter((k, len(shingles(t))) for k, t in rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert minhash.near_duplicates(docs.filter("doc_id < 0")).collect() == []


def test_regions_above_their_limits(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "NEAR", 2)
    monkeypatch.setattr(minhash, "LARGE", 16)
    draw = random.Random(8)
    base = prose(draw, 300)
    rows = [(i, edited(draw, base, draw.randint(0, 4))) for i in range(150)] + [(200 + i, prose(draw, 80)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == brute(rows)


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    gaps = []
    for _ in range(200):
        pool = draw.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(pool[:350]), np.unique(pool[50:])
        gaps.append((minhash.signature(a) == minhash.signature(b)).mean() - 300 / 400)
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.06


def test_threshold_of_80_against_brute_force(spark):
    import corpus_pipeline

    assert minhash.Forest.at(85) == minhash.Forest() and minhash.Forest.at(80).floor < 0.75
    draw, rows = random.Random(21), []
    for words, edits in ((60, 1), (120, 2), (200, 4), (300, 6)):
        for _ in range(12):
            base = prose(draw, words)
            rows += [(len(rows) + k, t) for k, t in enumerate((base, edited(draw, base, edits), edited(draw, base, edits)))]
    sets = dict((k, shingles(t)) for k, t in rows)
    alike = [len(a & b) / len(a | b) for a, b in combinations(sets.values(), 2)]
    assert sum(0.8 <= x < 0.85 for x in alike) > 5 and sum(0.7 <= x < 0.8 for x in alike) > 5
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(list(sets), links)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, threshold=80).collect()} == want
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(want.values())


def test_ids_of_another_type(spark):
    draw = random.Random(31)
    base = prose(draw, 60)
    rows = [("b", base), ("a", base), ("c", prose(draw, 60)), (None, base), ("d", None)]
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {"a": ("a", True), "b": ("a", False), "c": ("c", True), "d": ("d", True), None: (None, True)}
    assert {r.doc_id for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()} == {"a", "c", "d", None}
