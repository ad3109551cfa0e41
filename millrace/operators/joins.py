"""Lookup, coverage, priority and nearest joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides of at most this many bytes are broadcast; larger ones are joined as Spark sees fit.
BROADCAST_BYTES = 24 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The side with a broadcast hint if what its rows hold, texts and nested values included, is small enough."""
    held = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name)) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "string", "binary")]
    size = df.agg(F.sum(sum(held, F.lit(16 * (len(df.columns) + 2))).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def lookup(df: DataFrame, side: DataFrame, on: dict[str, str], take: dict[str, str], default: dict[str, object] | None = None) -> DataFrame:
    """Left join on {column of df: column of side}, bringing {column of side: new name}."""
    side = side.select(*(F.col(s).alias(f"_{s}") for s in dict.fromkeys([*on.values(), *take])))
    hit = None
    for a, b in on.items():
        one = F.col(a) == F.col(f"_{b}")
        hit = one if hit is None else hit & one
    out = df.join(small(side), hit, "left")
    new = {name: F.col(f"_{s}") for s, name in take.items()}
    for name, value in (default or {}).items():
        new[name] = F.coalesce(new[name], F.lit(value))
    return out.select(*(F.col(c) for c in df.columns if c not in new), *(c.alias(n) for n, c in new.items()))


def correct_values(df: DataFrame, rules: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replaces exact values by rules (key, value, replacement) in any of the columns; rules are a map for each key.

    Rules that repeat count once; of different replacements of one value the least is taken.
    """
    once = rules.groupBy(key, "value").agg(F.min("replacement").alias("replacement")).filter("value IS NOT NULL")
    by = once.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("value", "replacement"))).alias("_m"))
    out = df.join(small(by), F.col(key) == F.col("_k"), "left")
    new = {c: F.coalesce(F.col("_m")[F.col(c)], F.col(c)) for c in columns}
    return out.withColumns(new).select(*df.columns)


def match_by_priority(wanted: DataFrame, found: DataFrame, key: str, kind: str, priority: Sequence[str]) -> DataFrame:
    """Left join on a key in any case; of several kinds the first in `priority`, of equal ones the first by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.lower(kind)), F.lit(0))
    ranked = found.withColumn("_rank", rank).filter("_rank > 0").withColumn("_key", F.lower(key))
    first = Window.partitionBy("_key").orderBy("_rank", *(c for c in found.columns if c != key))
    best = ranked.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_key", *(F.col(c).alias(f"found_{c}") for c in found.columns if c != key))
    return wanted.withColumn("_key", F.lower(key)).join(best, "_key", "left").drop("_key")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that fails where a key repeats on either side or lacks a partner."""
    a = left.groupBy(*on).agg(F.count("*").alias("_a"))
    b = right.groupBy(*on).agg(F.count("*").alias("_b"))
    bad = a.join(b, list(on), "full").filter("coalesce(_a, 0) != 1 OR coalesce(_b, 0) != 1")
    if (n := bad.limit(5).collect()):
        raise ValueError(f"not one to one: {[r.asDict() for r in n]}")
    return left.join(right, list(on))


def missing_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of left without a row in right."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), list(on), "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side's name."""
    return missing_keys(left, right, on).withColumn("side", F.lit("left")).unionByName(missing_keys(right, left, on).withColumn("side", F.lit("right")))


def zip_rows(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Full join on an explicit row number; a row that one side lacks has null there."""
    return left.join(right, row, "full")


def revision_diff(old: DataFrame, new: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """added, removed, changed or same for each key of two revisions."""
    a = old.select(*on, F.struct(*values).alias("_old"))
    b = new.select(*on, F.struct(*values).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, list(on), "full").select(*on, status.alias("status"))


def coverage_gap(rows: DataFrame, universe: Sequence[DataFrame]) -> DataFrame:
    """Combinations of the given (bounded) domains that rows lack."""
    every = universe[0]
    for domain in universe[1:]:
        every = every.crossJoin(F.broadcast(domain))  # domains are value lists, not tables
    return every.join(rows.select(*every.columns).distinct(), every.columns, "left_anti")


def scheduled(reference: DataFrame, predictions: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Every reference row for every run, with its prediction or null, so unscored rows stay in denominators."""
    every = reference.crossJoin(F.broadcast(runs))  # runs are a short list
    return every.join(predictions, [key, *runs.columns], "left")


def paired(rows: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """(key, a, b, value_a, value_b) for every pair of runs a < b that share a key."""
    a = rows.select(key, F.col(run).alias("a"), F.col(value).alias("value_a"))
    b = rows.select(key, F.col(run).alias("b"), F.col(value).alias("value_b"))
    return a.join(b, key).filter("a < b")


def complete_cases(rows: DataFrame, run: str, key: str, runs: int) -> DataFrame:
    """Rows of the keys that every run has."""
    full = rows.groupBy(key).agg(F.count_distinct(run).alias("_n")).filter(F.col("_n") == runs).select(key)
    return rows.join(full, key, "left_semi")


def hamming_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, fields: Sequence[str], same: Column | None = None) -> DataFrame:
    """(left_id, right_id, distance): the row of right with the fewest differing fields; ties by `same`, then by id.

    Exact without a cross join: a pair at distance d < len(fields) agrees in some field, so candidates meet on one
    (field, value) each, after equal field tuples of right have been made one; rows that agree nowhere take the
    first row of right at the full distance.
    """
    value = lambda f: F.concat_ws("=", F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("\0")))
    tokens = F.array(*(value(f) for f in fields))
    a = left.select(F.col(left_id).alias("_a"), tokens.alias("_x"))
    asks = a.groupBy("_x").agg(F.min("_a").alias("_u"))
    b = right.select(F.col(right_id).alias("_b"), tokens.alias("_y"))
    kept = b.groupBy("_y").agg(F.min("_b").alias("_b"))
    met = asks.select("_u", "_x", F.explode("_x").alias("_t")).join(kept.select("_b", "_y", F.explode("_y").alias("_t")), "_t")
    agree = F.size(F.array_intersect("_x", "_y"))
    best = met.select("_u", F.struct((-agree).alias("d"), F.col("_b").alias("b")).alias("s")).groupBy("_u").agg(F.min("s").alias("s"))
    first = kept.agg(F.min("_b").alias("_first"))
    out = asks.join(best, "_u", "left").crossJoin(F.broadcast(first))  # one row
    n = len(fields)
    out = out.select("_x", F.coalesce(F.col("s.b"), F.col("_first")).alias(right_id), (F.lit(n) + F.coalesce(F.col("s.d"), F.lit(0))).alias("distance"))
    return a.join(out, "_x").select(F.col("_a").alias(left_id), right_id, "distance")
