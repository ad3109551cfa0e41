"""Counts, distributions and coverage of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, top: int | None = None, ascending: bool = False) -> DataFrame:
    """(column, n), most frequent first (or least), equal ones by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranked = counts.orderBy(F.asc("n") if ascending else F.desc("n"), F.asc(column))
    return ranked.limit(top) if top else ranked


def ranked_counts(df: DataFrame, by: str, column: str, top: int) -> DataFrame:
    """The top values of each group with their rank; counts are added up before they are dealt by group."""
    counts = df.groupBy(by, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), column))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def distinct_filled(df: DataFrame, column: str) -> DataFrame:
    """How many distinct values a text column has, blanks apart."""
    value = F.trim(F.col(column))
    return df.agg(F.count_distinct(F.when(value != "", value)).alias("n_distinct"))


def rows_and_entities(df: DataFrame, category: str, entity: str) -> DataFrame:
    """Rows and distinct entities of each category."""
    return df.groupBy(category).agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def entity_medians(df: DataFrame, entity: str, value: str) -> DataFrame:
    return df.groupBy(entity).agg(F.median(value).alias("value"))


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, min, quartiles, max, mean and sum; exact, with linear interpolation."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), q(0.25).alias("q1"), F.median(value).alias("median"), q(0.75).alias("q3"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.sum(value).alias("total")
    )


def group_mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, the lowest of equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def domain_shares(df: DataFrame, column: str, domain: Sequence[str], missing: str = "Not reported") -> DataFrame:
    """Count and percentage of every value of the domain, zeros included; nulls count as `missing`."""
    spark = df.sparkSession
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate([*domain, missing])], "place int, value string")
    out = wanted.join(counts, "value", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    return out.select("value", n.alias("n"), F.try_divide(n * 100.0, F.col("total")).alias("percent"))


def cut_bins(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Counts of (lo, hi] bins, the lowest edge included, empty bins too."""
    v, label = F.col(value), F.lit(None).cast("string")
    for lo, hi, name in zip(edges[:-1], edges[1:], labels, strict=True):
        above = v >= lo if lo == edges[0] else v > lo
        label = F.when(above & (v <= hi), name).otherwise(label)
    counts = df.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(n,) for n in labels], "bin string")
    return wanted.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, n) of equal bins from 0, the last closed, empty ones included. Bounds are read off the data if not given."""
    if lo is None or hi is None:
        found = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        lo, hi = (found["lo"] if lo is None else lo), (found["hi"] if hi is None else hi)
    spark = df.sparkSession
    if lo is None:
        return spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def multiplicity(df: DataFrame, x: str, y: str, positive: bool = False) -> DataFrame:
    """How many rows share exact coordinates; on log axes only positive ones."""
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    return (kept.filter((F.col(x) > 0) & (F.col(y) > 0)) if positive else kept).groupBy(x, y).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence, prefix: str = "n_") -> DataFrame:
    """Counts of the values as columns, their total and its percentage of all rows."""
    out = df.filter(F.col(column).isin(*values)).groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values), F.count("*").alias("total"))
    whole = df.filter(F.col(column).isin(*values)).agg(F.count("*").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).withColumn("percent", F.col("total") * 100.0 / F.col("_all")).drop("_all")


def audit_mapping(df: DataFrame, raw: str, value: str, group: str, groups: Sequence[str], rare: int = 5) -> DataFrame:
    """(raw, value, counts by group, total, is_rare)"""
    out = df.groupBy(raw, value).agg(*(F.count_if(F.col(group) == g).alias(f"n_{g}") for g in groups), F.count("*").alias("total"))
    return out.withColumn("is_rare", F.col("total") <= rare)


def sorted_sets(df: DataFrame, by: Sequence[str], value: str, sep: str = ";") -> DataFrame:
    """Distinct values of each group, sorted and joined; duplicates go before anything is gathered."""
    return df.select(*by, F.col(value).cast("string").alias("_v")).distinct().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("_v")), sep).alias("members"), F.count("*").alias("n_members"))


def text_coverage(df: DataFrame, words: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(words).alias("mean_words"), F.sum(words).alias("total_words"))


def latency(df: DataFrame, by: Sequence[str], seconds: str, panel: int, projected: int) -> DataFrame:
    """Latency by arm and the serial projection: mean panel time over its questions, times the projected number."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_s"), F.stddev_samp(seconds).alias("sd_s"), F.median(seconds).alias("median_s"), (F.sum(seconds) / F.lit(panel) * projected).alias("projected_s"))


def flag_share(df: DataFrame, entity: str, flag: Column) -> DataFrame:
    """Distinct entities with the flag, of all."""
    yes, every = F.count_distinct(F.when(flag, F.col(entity))), F.count_distinct(entity)
    return df.agg(yes.alias("n_yes"), every.alias("n_all"), F.try_divide(yes * 100.0, every).alias("percent"))


def spread(df: DataFrame, value: str, skewed: bool = False) -> DataFrame:
    """Sample deviation, of log1p for skewed fields; 1 where it is 0 or undefined."""
    v = F.log1p(F.greatest(F.col(value), F.lit(0.0))) if skewed else F.col(value)
    return df.agg(F.coalesce(F.nullif(F.stddev_samp(v), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def quartile_scale(df: DataFrame, value: str) -> DataFrame:
    """Distance of the quartiles, else the deviation, else 1."""
    iqr = F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))
    return df.agg(F.coalesce(F.nullif(iqr, F.lit(0.0)), F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Half the summed gap of the two shares of every value, nulls a value of their own."""
    share = lambda df, name: df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("\0")).alias("v")).agg(F.count("*").cast("double").alias(name))
    both = share(a, "x").join(share(b, "y"), "v", "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    sums = both.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    return both.crossJoin(F.broadcast(sums)).agg((F.sum(F.abs(F.col("x") / F.col("n") - F.col("y") / F.col("m"))) / 2).alias("distance"))


def log_bin(value: Column, per_decade: int = 4) -> Column:
    """Number of the log-spaced bin of a positive value."""
    return F.when(value > 0, F.floor(F.log10(value) * per_decade).cast("int"))


def status_audit(df: DataFrame, key: str, status: str) -> DataFrame:
    """Rows, distinct and repeated keys of each status."""
    per_key = df.groupBy(status, key).agg(F.count("*").alias("_n"))
    return per_key.groupBy(status).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("_n") > 1).alias("n_repeated"))
