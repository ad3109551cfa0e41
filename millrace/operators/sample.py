"""Reproducible draws: donors, synthetic negatives and random drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.split import seeded

_UNIT = 1 << 30


def uniform(seed: int, *columns: str | Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(_UNIT)) / float(_UNIT)


def nearest_donors(df: DataFrame, by: Sequence[str], gap: Column, value: str, top: int = 32) -> DataFrame:
    """The rows of each group with the smallest gaps, ties by value."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(gap, value))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= top).drop("_nth")


def marginals(df: DataFrame, fields: Sequence[str], most: int = 100_000) -> dict[str, tuple[list, list[float]]]:
    """Values and running shares of each field (text), over non-null rows; an error above `most` values."""
    out = {}
    for field in fields:
        rows = df.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy("v").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{field} has more than {most} values")
        total, running, shares = sum(r["n"] for r in rows), 0, []
        for r in rows:
            running += r["n"]
            shares.append(running / total)
        out[field] = [r["v"] for r in rows], shares
    return out


def draw_from(values: Sequence[str], shares: Sequence[float], u: Column) -> Column:
    """The value whose running share covers u, by counting the shares at or below it."""
    at = F.size(F.filter(F.array(*map(F.lit, shares)), lambda s: s <= u))
    return F.get(F.array(*map(F.lit, values)), F.least(at, F.lit(len(values) - 1)))


def synthetic_negatives(positives: DataFrame, row_id: str, fields: Sequence[str], swapped: Sequence[str], seed: int = 42, attempts: int = 16) -> DataFrame:
    """For each positive one record with the swapped fields drawn from their marginals, unlike every positive and each other.

    All attempts of a row are proposed at once; what is a positive goes by an anti join, the first attempt left is
    taken, and of equal records the one of the least row. Rows whose attempts all fail have none.
    """
    known = marginals(positives, swapped)
    text = {f: F.col(f).cast("string") for f in fields}
    base = positives.select(row_id, *(c.alias(f) for f, c in text.items()))
    tries = base.select(row_id, *fields, F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("_try"))
    drawn = tries.withColumns({f: draw_from(*known[f], uniform(seed + i, row_id, "_try")) for i, f in enumerate(swapped) if known[f][0]})
    key = F.xxhash64(*(F.coalesce(F.col(f), F.lit("\0")) for f in fields))
    fresh = drawn.withColumn("_key", key).join(base.select(key.alias("_key")).distinct(), "_key", "left_anti")
    first = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(row_id).orderBy("_try"))).filter("_nth = 1")
    one = first.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(row_id))).filter("_nth = 1")
    return one.select(row_id, *fields)


def drop_random(df: DataFrame, eligible: Column, k: int, seed: int, order: str) -> DataFrame:
    """Drops k of the eligible rows (by unique `order`), chosen by a seeded hash."""
    gone = df.filter(eligible).select(F.col(order).alias("_gone")).orderBy(seeded(seed, "_gone"), "_gone").limit(k)
    return df.join(gone, F.col(order) == F.col("_gone"), "left_anti")
