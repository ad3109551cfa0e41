import random
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity
from tests.llm.helpers import prose, word


def fixture(spark, n=900):
    draw = random.Random(2)
    ordinary = [word(draw) for _ in range(400)]
    stems = ["zzgrob", "quixvel"]
    rows, labels = [], []
    for i in range(n):
        bad = draw.random() < 0.3
        words = prose(draw, draw.randint(20, 200), ordinary).split()
        for _ in range(max(2, len(words) // 15) if bad else 0):
            words.insert(draw.randint(0, len(words)), draw.choice(stems) + word(draw, (1, 3)))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    rows += [(None, "some text", "en"), (n, None, "en"), (n + 1, "", "en"), (n + 2, "!!!", "en"), (0, rows[0][1], "en"), (n + 3, "long " * 50_000, "en")]
    labels += [(None, 1), (5, None), (7, labels[7][1])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), rows, dict(labels[:n])


def test_held_out_accuracy(spark):
    docs, labels, rows, truth = fixture(spark)
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    empty = {r.score for r in out if r.doc_id in (900, 901, 902)}
    assert len(empty) == 1
    assert [r.score for r in out if r.doc_id == 0][0] == [r.score for r in out if r.doc_id == 0][1]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if not r.predicted)


def test_held_out_labels_and_missing_classes_do_not_matter(spark):
    docs, labels, _, _ = fixture(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b
    for some in (labels.filter("toxic = 0"), labels.filter("doc_id < 0")):
        assert {r.predicted for r in toxicity.score_toxicity(docs, some).collect()} == {0}
    assert toxicity.score_toxicity(docs.filter("doc_id < 0"), labels).collect() == []


def kneser_ney(counts):
    """log P(toxic) - log P(ordinary) of grams by plain recursion."""
    d = toxicity.DISCOUNT
    levels = {toxicity.ORDER: set(counts)}
    for k in range(toxicity.ORDER, 1, -1):
        levels[k - 1] = {g[1:] for g in levels[k]}
    cont = {k: Counter(g[1:] for g in levels[k + 1]) for k in range(1, toxicity.ORDER)}

    def shared(g):
        if len(g) == 1:
            return cont[1][g] / sum(cont[1].values())
        same = [x for x in levels[len(g)] if x[:-1] == g[:-1]]
        total = sum(cont[len(g)][x] for x in same)
        return (max(cont[len(g)][g] - d, 0) + d * len(same) * shared(g[1:])) / total

    def own(g, y):
        same = {x: c[y] for x, c in counts.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return shared(g[1:])
        return (max(counts[g][y] - d, 0) + d * sum(v > 0 for v in same.values()) * shared(g[1:])) / total

    return {g: log(own(g, 1) / own(g, 0)) for g in counts}


def test_ratios_against_plain_recursion(spark):
    draw = random.Random(4)
    texts = [(" ".join(draw.choice(["abc", "abd", "bad", "cab", "dab", "abcab"]) for _ in range(20)), y) for y in (0, 1, 0)]
    counts = defaultdict(lambda: [0, 0])
    for text, y in texts:
        for w in text.split():
            p = "\x02" * 4 + w + "\x03"
            for i in range(len(p) - 4):
                counts[p[i : i + 5]][y] += 1
    top = toxicity.gram_counts(spark.createDataFrame(texts, "text string, toxic int"))
    assert {r.gram: [r.c0, r.c1] for r in top.collect()} == dict(counts)
    seen, _, _ = toxicity.ratios(top)
    want = kneser_ney(counts)
    got = {r.gram: r.llr for r in seen.collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)


def test_table_keeps_every_gram(spark):
    """More grams than 2 ** 22 slots would hold; none is lost."""
    n = 6_000_000
    letters = F.array(*(F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"))
    place = lambda k: F.get(letters, F.pmod(F.floor(F.col("id") / 26**k), F.lit(26)).cast("int"))
    grams = spark.range(n).select(F.concat(*map(place, range(5))).alias("gram"), F.lit(1).alias("n"), (F.col("id") % 97).cast("double").alias("llr"))
    made = toxicity.Table.collect(grams, 5)
    ids = np.arange(n)
    codes = np.stack([ids // 26**k % 26 for k in range(5)], 1).astype(np.uint32) + ord("a")
    known, values = made.find(toxicity.gram_hashes(codes.ravel(), 5)[::5])
    assert known.all() and (values == ids % 97).all()
    assert not made.find(toxicity.gram_hashes(toxicity.codes_of("ABCDE"), 5))[0].any()


def test_what_only_the_fitted_fold_holds_is_known(spark):
    docs, labels, rows, _ = fixture(spark, 300)
    ids = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 5 == toxicity.FITTED[0]][:30]
    more = spark.createDataFrame([(i, rows[i - 1000][1] + " wuxxyq" * 9, "en", 0.5) for i in ids], docs.schema)
    marks = labels.unionByName(spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int"))
    tables, _ = toxicity.fit(docs.unionByName(more), marks)
    known = tables.value[0].find(toxicity.gram_hashes(toxicity.codes_of("wuxxyq"), toxicity.ORDER))
    assert known[0].all() and (known[1] > 0).all()
