import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, joins, matching, profile, reshape, rules, split, stats


def test_keep_first_and_conflicts(spark):
    df = spark.createDataFrame([(3, "a", True), (1, "a", True), (2, "a", False), (4, "b", False), (5, None, False), (6, None, True)], "id int, k string, y boolean")
    clean = dedup.drop_conflicting(df, ["k"], "y", ~F.col("y"))
    assert sorted(r.id for r in clean.collect()) == [1, 3, 4, 6]
    assert sorted(r.id for r in dedup.keep_first(clean, ["k"], ["id"]).collect()) == [1, 4, 6]
    with pytest.raises(Exception, match="differ"):
        dedup.collapse_identical(df.select("k", "id"), ["k"]).collect()


def test_one_to_one_and_diff(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (3, "z")], "k int, v string")
    with pytest.raises(ValueError, match="one to one"):
        joins.one_to_one(a, b, ["k"])
    assert {(r.k, r.status) for r in joins.revision_diff(a, b, ["k"], ["v"]).collect()} == {(1, "same"), (2, "removed"), (3, "added")}


def test_hamming_against_brute_force(spark):
    draw = random.Random(1)
    make = lambda n: [(i, *(draw.choice("abc") if draw.random() < 0.9 else None for _ in range(4))) for i in range(n)]
    left, right = make(40), make(30)
    schema = "id int, p string, q string, r string, s string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("id", "near")
    got = {r.id: (r.near, r.distance) for r in joins.hamming_nearest(a, b, "id", "near", ["p", "q", "r", "s"]).collect()}
    for row in left:
        d, near = min((sum(x != y for x, y in zip(row[1:], other[1:], strict=True)), other[0]) for other in right)
        assert got[row[0]] == (near, d)


def test_bins_and_ratio():
    assert split.contiguous_bins({2000: 5, 2001: 5, 2002: 5, 2003: 5}, 2) == [(2000, 2001), (2002, 2003)]
    assert split.contiguous_bins({2000: 1}, 4) == [(2000, 2000)] and split.contiguous_bins({}, 3) == []
    best = None
    train, hold = (110, 147), (13, 17)
    for p, n in itertools.product(range(1, 41), repeat=2):
        a, b = min(train[0] // p, train[1] // n), min(hold[0] // p, hold[1] // n)
        if math.gcd(p, n) == 1 and a and b:
            score = ((p + n) * (a + b), -abs(math.log(p / n / 0.75)), -(p + n))
            best = max(best or (score, p, n), (score, p, n))
    assert split.ratio_units(train, hold, (0, 0), 0.75, 40) == best[1:]
    with pytest.raises(ValueError, match="no exact"):
        split.ratio_units((0, 5), (1, 1), (0, 0), 1.0)


def test_holdout_is_disjoint_and_near_its_aim(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(f"c{draw.randrange(120)}", draw.random() < 0.5) for _ in range(1500)], "c string, y boolean")
    chosen = split.choose_holdout(split.cluster_stats(df, "c", F.col("y"), F.col("c") == "c7"), "c")
    both = split.assign_split(df, chosen, "c")
    assert split.shared_keys(both.filter("split = 'train'"), both.filter("split = 'holdout'"), ["c"]).collect() == []
    assert "c7" in {r.c for r in chosen.collect()}
    assert 0.08 < both.filter("split = 'holdout'").count() / 1500 < 0.12
    with pytest.raises(ValueError, match="both labels"):
        split.choose_holdout(split.cluster_stats(df.filter("y"), "c", F.col("y"), F.lit(False)), "c")


@pytest.mark.parametrize(("n", "parts"), [(12, 5), (3, 5), (0, 2), (20, 4)])
def test_shards(spark, n, parts):
    got = {r["shard"]: r["count"] for r in split.shards(spark.range(n), "id", parts).groupBy("shard").count().collect()}
    assert [got.get(k, 0) for k in range(1, parts + 1)] == [n // parts + (k < n % parts) for k in range(parts)]


def test_histogram_and_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 10)], "v double")
    assert [r.n for r in profile.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 1, 0, 1]
    assert {r.bin: r.n for r in profile.cut_bins(df, "v", [0, 1, 5, 9], ["a", "b", "c"]).collect()} == {"a": 2, "b": 3, "c": 0}
    assert profile.group_mode(spark.createDataFrame([("x", 2), ("x", 1), ("x", 2), ("x", 1), ("y", 5)], "g string, v int"), "g", "v").orderBy("g").collect() == [("x", 1), ("y", 5)]


def test_calibration(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.95), (1, 1.0), (0, 0.0)], "y int, p double")
    r = stats.calibration(df, "y", "p").first()
    assert (r.n, r.accuracy) == (4, 0.75) and r.ece == pytest.approx((0.5 + 0.95) / 4) and r.brier == pytest.approx((0.25 + 0.95**2) / 4)
    with pytest.raises(Exception, match="within"):
        stats.calibration(spark.createDataFrame([(1, None)], "y int, p double"), "y", "p").collect()


def test_intervals_and_tests(spark):
    low, high = stats.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert r.l == pytest.approx(0.2366, abs=1e-4) and r.h == pytest.approx(0.7634, abs=1e-4)
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(1, 9) == pytest.approx(0.021484375)
    lo, hi = stats.multinomial_bootstrap([50, 50], lambda c: c[:, 0] / c.sum(1))
    assert 0.38 < lo < 0.42 and 0.58 < hi < 0.62
    t = stats.mean_interval(spark.createDataFrame([(float(v),) for v in range(10)], "v double"), "v").first()
    assert t.high - t.mean == pytest.approx(2.2622 * t.sd / math.sqrt(10), rel=1e-3)


def test_option_product_order(spark):
    df = spark.createDataFrame([("m", 1, ["a", "b"], [7, 8]), ("k", 2, [], None)], "x string, y int, xs array<string>, ys array<int>")
    rows = reshape.option_product(df, {"x": "xs", "y": "ys"}).orderBy("y", "variant").collect()
    assert sorted((r.x, r.y, r.variant) for r in rows) == [("a", 7, 0), ("a", 8, 1), ("b", 7, 2), ("b", 8, 3), ("k", 2, 0)]


def test_rules(spark):
    rows = [("range", "5", "1", "9"), ("gt", "5", "5", None), ("exclusion", " A ", "a", None), ("discrete_set", "b", "a ||| B", None), ("unparsed_freetext", "x", None, None), ("lt", None, "3", None)]
    rows += [("exclusion", None, "a", None), ("discrete_set", "4,4'-bipyridine", "2,2'-bipyridine ||| 4,4'-Bipyridine", None), ("discrete_set", "1.0", "1 ||| 3", None), ("categorical_equals", None, "a", None)]
    df = spark.createDataFrame(rows, "p string, t string, a string, b string")
    got = [r.ok for r in df.select(rules.satisfied(*map(F.col, "ptab")).alias("ok")).collect()]
    assert got == [True, False, False, True, False, False, True, True, True, False]


def test_rules_of_a_window(spark):
    """One of a SINGLE window's rules is enough, free text fails ALL, and a rule over a field that is not there counts."""
    rows = [("d", 1, "SINGLE", None, "x", "gt", "9", None), ("d", 1, "SINGLE", None, "y", "categorical_equals", "a", None), ("d", 2, "ALL", None, "x", "gt", "1", None), ("d", 2, "ALL", None, "y", "unparsed_freetext", "?", None)]
    rows += [("d", 3, "ALL", None, "x", "gt", "1", None), ("d", 3, "ALL", None, "z", "gt", "1", None), ("d", 4, "AT_LEAST", 1, "z", "exclusion", "q", None)]
    windows = spark.createDataFrame(rows, "doc string, w int, logic string, needed int, field string, predicate string, value_1 string, value_2 string")
    candidates = spark.createDataFrame([("d", 7, "5", "A")], "doc string, c int, x string, y string")
    got = {r.w: r.fits for r in rules.evaluate_rules(candidates, windows, "c", "doc", "w", ["x", "y"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    literal = rules.window_columns([r[1:] for r in rows], {"x": F.lit("5"), "y": F.lit("A")})
    assert spark.range(1).select(*(c.alias(str(w)) for w, c in literal.items())).first().asDict() == {str(w): ok for w, ok in got.items()}


def test_shards_of_wide_rows(spark):
    """Ranges are the same for all readers, whatever columns they read."""
    n, parts = 20_003, 5
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("a"), (F.col("id") % 13).alias("b"))
    got = {(r.shard, r.k) for r in split.shards(df, "k", parts).collect()}
    small, extra = divmod(n, parts)
    edges = np.cumsum([0, *(small + (i < extra) for i in range(parts))])
    assert got == {(int(np.searchsorted(edges, k, side="right")), k) for k in range(n)}


def test_samples_keep_what_is_protected(spark):
    df = spark.createDataFrame([(i, i % 2, i < 6) for i in range(40)], "i int, y int, p boolean")
    got = split.sample_to_counts(df, "y", {0: 5, 1: 9}, [split.seeded(1, "i"), "i"], F.col("p")).collect()
    assert sorted(r.i for r in got if r.p) == list(range(6)) and sum(r.y for r in got) == 9 and len(got) == 14
    for wrong in ({0: 2, 1: 9}, {0: 21, 1: 9}):
        with pytest.raises(ValueError, match="asked for"):
            split.sample_to_counts(df, "y", wrong, ["i"], F.col("p"))


def test_rules_that_repeat(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, v string")
    fixes = spark.createDataFrame([("a", "x", "y"), ("a", "x", "y"), ("a", "x", "z")], "k string, value string, replacement string")
    assert sorted(map(tuple, joins.correct_values(df, fixes, "k", ["v"]).collect())) == [("a", "y"), ("b", "x")]


def test_a_long_chain_is_matched():
    n = 3000
    links = {i: [i, i + 1] for i in range(n)} | {n: [0]}
    assert len(matching.largest_matching(links)) == n + 1


def test_best_swap_against_all(spark):
    draw = np.random.default_rng(4)
    sizes = np.stack([draw.integers(1, 9, 6), np.zeros(6, int), np.ones(6, int)], 1)
    sizes[:, 1] = draw.integers(0, sizes[:, 0] + 1)
    there, taken = draw.integers(2, 9, 6), np.array([1, 2, 0, 1, 1, 0])
    total, hold = there @ sizes, taken @ sizes
    cost = lambda parts: split.holdout_costs(parts, total, (12, 5), "equal")
    want = min(float(cost((hold + n * (sizes[j] - sizes[i]))[None])[0]) for i in range(6) for j in range(6) for n in (1, 2, 4) if n <= taken[i] and n <= there[j] - taken[j])
    assert split.best_swap(taken, there, sizes, hold, cost, draw)[0] == want


def test_assignment_against_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(100):
        n, m = int(draw.integers(1, 5)), int(draw.integers(5, 7))
        cost = draw.integers(0, 9, (n, m)).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        at = matching.assign(cost)
        assert len(set(at)) == n and cost[np.arange(n), at].sum() == best


def test_largest_matching():
    assert len(matching.largest_matching({0: [0, 1], 1: [0], 2: [1, 2], 3: [2]})) == 3
    assert matching.align_slots(["b", None, "a"], ["a", "b", "c"], lambda x, y: x == y) == (2, 0, 1)


def test_match_pairs(spark):
    df = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 4.0), (1, 1, 0, 4.0), (1, 1, 1, 0.0), (2, 0, 0, 0.1)], "g int, x int, y int, s double")
    assert sorted(matching.match_pairs(df, "g", "x", "y", "s", 1.0).collect()) == [(1, 0, 1, 4.0), (1, 1, 0, 4.0)]
