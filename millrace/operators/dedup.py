"""Keep-first dedup, conflicts and occurrences. Order is always given, never that of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. Spark cuts each task's rows to one a key before it deals them."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", at).filter("_nth = 1").drop("_nth")


def label_conflicts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Keys that occur with more than one label."""
    return df.groupBy(*keys).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).filter("_lo != _hi").select(*keys)


def drop_conflicting(df: DataFrame, keys: Sequence[str], label: str, loser: Column) -> DataFrame:
    """Rows where `loser` holds go if their key has both labels."""
    clash = label_conflicts(df, keys, label).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    hit = same[0]
    for s in same[1:]:
        hit = hit & s
    return df.join(clash, hit & F.coalesce(loser, F.lit(False)), "left_anti")


def prune_singletons(df: DataFrame, value: str, longest: int = 10) -> DataFrame:
    """Drops short values without parentheses that occur once. Counts are joined back, so no value is one task."""
    once = df.groupBy(value).agg(F.count("*").alias("_n")).filter((F.col("_n") == 1) & (F.length(value) <= longest) & ~F.contains(F.col(value), F.lit("(")))
    return df.join(once.select(F.col(value).alias("_v")), F.col(value) == F.col("_v"), "left_anti")


def occurrence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "occurrence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def collapse_identical(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key; an error if rows of a key differ."""
    others = [c for c in df.columns if c not in keys]
    body = F.struct(*others)
    out = df.groupBy(*keys).agg(F.min(body).alias("_lo"), F.max(body).alias("_hi"))
    return out.withColumn("_ok", F.assert_true(F.col("_lo").eqNullSafe(F.col("_hi")), "rows of one key differ")).filter("_ok IS NULL").select(*keys, "_lo.*")
