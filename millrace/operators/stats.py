"""Scores, intervals, calibration, agreement and bootstraps.

Spark adds rows up to sufficient statistics; what is left (counts by label pattern, by bin, by resampled unit) is
small, and resampling runs on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: Column, guess: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, by group."""
    t, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))


def metrics(counts: DataFrame, zero: float | None = None) -> DataFrame:
    """Adds the usual scores of confusion counts; an undefined one is null, or `zero` if given."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = F.try_divide
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    all_ = {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "specificity": specificity,
        "f1": f1, "balanced_accuracy": (recall + specificity) / 2, "npv": ratio(tn, tn + fn), "mcc": mcc,
    }
    return counts.withColumns({n: c if zero is None else F.coalesce(c, F.lit(zero)) for n, c in all_.items()})


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of Wilson's interval of k out of n; null for n = 0."""
    p, m = F.try_divide(k.cast("double"), n.cast("double")), n.cast("double")
    centre = F.try_divide(p + z * z / (2 * m), 1 + z * z / m)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m)
    known = n > 0
    return F.when(known, F.greatest(centre - half, F.lit(0.0))), F.when(known, F.least(centre + half, F.lit(1.0)))


def bin_index(p: Column, bins: int) -> Column:
    """Equal bins [lo, hi), the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration(df: DataFrame, label: str, probability: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy (at 0.5, ties positive), ece and brier; fails on labels or probabilities out of range."""
    y, p = F.col(label).cast("double"), F.col(probability).cast("double")
    bad = y.isNull() | ~y.isin(0.0, 1.0) | p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    checked = df.select(*by, F.when(bad, F.raise_error(F.lit("labels must be 0 or 1 and probabilities within [0, 1]")).cast("double")).otherwise(y).alias("_y"), p.alias("_p"))
    hit = ((F.col("_p") >= 0.5) == (F.col("_y") == 1)).cast("double")
    parts = checked.groupBy(*by, bin_index(F.col("_p"), bins).alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum(hit).alias("_hit"), F.sum(F.col("_y") - F.col("_p")).alias("_gap"), F.sum((F.col("_p") - F.col("_y")) ** 2).alias("_sq")
    )
    n = F.sum("_n")
    return parts.groupBy(*by).agg(n.alias("n"), (F.sum("_hit") / n).alias("accuracy"), (F.sum(F.abs("_gap")) / n).alias("ece"), (F.sum("_sq") / n).alias("brier"))


def percentile_interval(draws: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    kept = draws[np.isfinite(draws)]
    if not len(kept):
        return math.nan, math.nan
    lo, hi = np.quantile(kept, [(1 - level) / 2, (1 + level) / 2])
    return float(lo), float(hi)


def multinomial_bootstrap(counts: Sequence[int], score, draws: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """Interval of score(counts) over multinomial resamples of the cells; score takes an array (draws, cells)."""
    total = sum(counts)
    sample = np.random.default_rng(seed).multinomial(total, np.array(counts) / total, size=draws)
    return percentile_interval(np.asarray(score(sample), float))


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided p value of the discordant pairs."""
    n, k = only_a + only_b, min(only_a, only_b)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def paired_cells(df: DataFrame, truth: Column, a: Column, b: Column) -> DataFrame:
    """(cell, n) of the eight joint outcomes: 4 truth + 2 a + b."""
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.groupBy((bit(truth) * 4 + bit(a) * 2 + bit(b)).alias("cell")).agg(F.count("*").alias("n"))


def unit_statistics(df: DataFrame, unit: str, sums: dict[str, Column]) -> DataFrame:
    """The sums of each unit that is resampled as a whole, and n."""
    return df.groupBy(unit).agg(F.count("*").alias("n"), *(F.sum(c.cast("double")).alias(n) for n, c in sums.items()))


def unit_bootstrap(stats: DataFrame, top: str, bottom: str, draws: int = 2000, seed: int = 42, most: int = 1_000_000) -> tuple[float, float]:
    """Interval of sum(top) / sum(bottom) when units are drawn with replacement.

    Units with equal sums are one cell, so what reaches the driver are distinct pairs; above `most` of them the
    units get Poisson weights in Spark instead, one draw a column.
    """
    cells = stats.groupBy(F.col(top).alias("t"), F.col(bottom).alias("b")).agg(F.count("*").alias("n"))
    if cells.count() <= most:
        rows = cells.orderBy("t", "b").toPandas()
        total = int(rows["n"].sum())
        sample = np.random.default_rng(seed).multinomial(total, rows["n"] / total, size=draws)
        with np.errstate(all="ignore"):
            return percentile_interval((sample @ rows["t"].to_numpy()) / (sample @ rows["b"].to_numpy()))
    columns = []
    for d in range(min(draws, 200)):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(d), *stats.columns), F.lit(1 << 30)) / float(1 << 30)).alias("u")
        weight, limit = F.lit(0), 0.0
        for k in range(8):
            limit += math.exp(-1) / math.factorial(k)
            weight = weight + (u >= limit).cast("int")
        columns.append((F.sum(F.col(top) * weight) / F.sum(F.col(bottom) * weight)).alias(f"d{d}"))
    return percentile_interval(np.array(stats.agg(*columns).first(), float))


def agreement(patterns: DataFrame, yes: str = "yes", no: str = "no", n: str = "n") -> DataFrame:
    """Raw pairwise agreement, Fleiss kappa, Krippendorff alpha, Gwet AC1 and unanimity of yes/no votes by pattern counts."""
    y, o, w = F.col(yes).cast("double"), F.col(no).cast("double"), F.col(n).cast("double")
    r = y + o
    usable = patterns.filter((y + o) >= 2)
    sums = usable.agg(
        F.sum(w).alias("items"), F.sum(w * r).alias("votes"), F.sum(w * y).alias("yes"),
        F.sum(w * F.try_divide(y * (y - 1) + o * (o - 1), r * (r - 1))).alias("pairs"),
        F.sum(w * F.try_divide(2 * y * o, r - 1)).alias("split"),
        F.sum(F.when((y == 0) | (o == 0), w).otherwise(0.0)).alias("same"),
        F.sum(w * y / r).alias("share"),
    )
    p = F.col("yes") / F.col("votes")
    observed = F.col("pairs") / F.col("items")
    chance = p * p + (1 - p) * (1 - p)
    q = F.col("share") / F.col("items")
    gwet = 2 * q * (1 - q)
    expected = F.try_divide(2 * F.col("yes") * (F.col("votes") - F.col("yes")), F.col("votes") - 1)
    return sums.select(
        F.col("items").cast("bigint").alias("items"), observed.alias("agreement"), F.try_divide(observed - chance, 1 - chance).alias("fleiss_kappa"),
        (1 - F.try_divide(F.col("split"), expected)).alias("alpha"), F.try_divide(observed - gwet, 1 - gwet).alias("gwet_ac1"), (F.col("same") / F.col("items")).alias("unanimous"),
    )


def pair_kappa(votes: DataFrame, item: str, rater: str, vote: str) -> DataFrame:
    """Cohen's kappa of each pair of raters a < b, with their shared items."""
    a = votes.select(item, F.col(rater).alias("a"), F.col(vote).cast("int").alias("x"))
    b = votes.select(item, F.col(rater).alias("b"), F.col(vote).cast("int").alias("y"))
    d = lambda c: F.sum(c).cast("double")
    sums = a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), d((F.col("x") == F.col("y")).cast("int")).alias("same"), d(F.col("x")).alias("xs"), d(F.col("y")).alias("ys"))
    n = F.col("n").cast("double")
    observed, chance = F.col("same") / n, (F.col("xs") * F.col("ys") + (n - F.col("xs")) * (n - F.col("ys"))) / (n * n)
    return sums.select("a", "b", "n", F.try_divide(observed - chance, 1 - chance).alias("kappa"))


def mean_interval(df: DataFrame, value: str, by: Sequence[str] = (), z: float | None = None) -> DataFrame:
    """n, mean, sd and the bounds of the mean (Student's t by its expansion in 1/n unless z is given)."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    g, d = 1.959963984540054, (F.col("n") - 1).cast("double")
    t = F.lit(z) if z else g + F.try_divide(F.lit((g**3 + g) / 4), d) + F.try_divide(F.lit((5 * g**5 + 16 * g**3 + 3 * g) / 96), d * d) + F.try_divide(F.lit((3 * g**7 + 19 * g**5 + 17 * g**3 - 15 * g) / 384), d**3)
    half = t * F.col("sd") / F.sqrt(F.col("n"))
    return out.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def with_overall(df: DataFrame, group: str, aggregates: Sequence[Column]) -> DataFrame:
    """The aggregates of each group and of all rows; is_overall tells the latter."""
    return df.rollup(group).agg(F.grouping(group).cast("int").alias("is_overall"), *aggregates)


def micro_macro(counts: DataFrame, group: str, scope: str) -> DataFrame:
    """Precision and recall of summed tp, fp, fn by scope, and the plain means over groups where they are defined."""
    parts = counts.withColumns({"_p": F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), "_r": F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))})
    tp, fp, fn = (F.sum(c).cast("double") for c in ("tp", "fp", "fn"))
    return parts.groupBy(scope).agg(F.count_distinct(group).alias("groups"), F.try_divide(tp, tp + fp).alias("micro_precision"), F.try_divide(tp, tp + fn).alias("micro_recall"), F.avg("_p").alias("macro_precision"), F.avg("_r").alias("macro_recall"))


def field_label(present: Column, expected: Column, equal: Column) -> Column:
    """TP, FP, FN, TN, or BOTH for a wrong value (one FP and one FN)."""
    return F.when(present & expected & equal, "TP").when(present & expected, "BOTH").when(present, "FP").when(expected, "FN").otherwise("TN")
