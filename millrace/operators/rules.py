"""Filters, typed predicates over rule tables, and routing with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least(k: int, *conditions: Column) -> Column:
    """Whether k of the conditions hold; null counts as false."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total >= k


def route(df: DataFrame, reasons: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Adds reason: the first that holds, else `kept`."""
    out = F.lit(kept)
    for name, condition in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return df.withColumn("reason", out)


def eligible(number: Column, lower: float) -> Column:
    """Finite and not below the bound."""
    return number.isNotNull() & ~F.isnan(number) & (number < float("inf")) & (number >= lower)


#: What parts the members of a set in a rule; names may hold commas.
MEMBERS = r" \|\|\| "


def satisfied(predicate: Column, text: Column, a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """A typed predicate over a field's text.

    Sets are parted by " ||| "; a set of numbers is compared by value, any other by text in lower case. A missing field
    satisfies exclusions and nothing else. Free text cannot be checked and is false.
    """
    number, lo, hi = text.try_cast("double"), a.try_cast("double"), b.try_cast("double")
    low, wanted = F.lower(F.trim(text)), F.lower(F.trim(a))
    members = F.transform(F.split(a, MEMBERS), F.trim)
    values = F.transform(members, lambda m: m.try_cast("double"))
    numeric = F.forall(values, lambda v: v.isNotNull()) & number.isNotNull()
    by_value = F.exists(values, lambda v: F.abs(v - number) < tolerance)
    by_text = F.array_contains(F.transform(members, F.lower), low)
    said = (
        F.when(predicate == "categorical_equals", low == wanted)
        .when(predicate == "exclusion", F.coalesce(low != wanted, F.lit(True))).when(predicate == "discrete_set", F.when(numeric, by_value).otherwise(by_text))
        .when(predicate == "range", (number >= lo) & (number <= hi)).when(predicate == "gt", number > lo).when(predicate == "lt", number < lo)
    )
    return F.coalesce(said, F.lit(False))


def combine(results: DataFrame, by: Sequence[str], ok: str = "ok", logic: str = "logic", needed: str = "needed") -> DataFrame:
    """Whether the rules of each group hold together: ANY and SINGLE need one, AT_LEAST so many, ALL every one; null is false."""
    out = results.groupBy(*by, logic).agg(F.count_if(F.coalesce(F.col(ok), F.lit(False))).alias("_yes"), F.count("*").alias("_all"), F.max(needed).alias("_k"))
    fits = F.when(F.col(logic).isin("ANY", "SINGLE"), F.col("_yes") >= 1).when(F.col(logic) == "AT_LEAST", F.col("_yes") >= F.col("_k")).otherwise(F.col("_yes") == F.col("_all"))
    return out.select(*by, fits.alias("fits"))


def evaluate_rules(candidates: DataFrame, rules: DataFrame, candidate: str, doc: str, window: str, fields: Sequence[str]) -> DataFrame:
    """(doc, candidate, window, fits): every candidate against the windows of its document; a field it lacks is missing."""
    value = F.lit(None).cast("string")
    for f in fields:
        value = F.when(F.col("field") == f, F.col(f"_f_{f}")).otherwise(value)
    slim = candidates.select(doc, candidate, *(F.col(f).cast("string").alias(f"_f_{f}") for f in fields))
    joined = slim.join(rules, doc).withColumn("ok", satisfied(F.col("predicate"), value, F.col("value_1"), F.col("value_2")))
    return combine(joined, [doc, candidate, window])


def window_columns(windows: Sequence[tuple], fields: dict[str, Column]) -> dict:
    """{window: whether it fits} as plain columns, for rules known beforehand: no join and no shuffle.

    windows: rows (window, logic, needed, field, predicate, value_1, value_2).
    """
    groups: dict = {}
    for window, logic, needed, field, predicate, one, two in windows:
        ok = satisfied(F.lit(predicate), fields.get(field, F.lit(None).cast("string")), F.lit(one).cast("string"), F.lit(two).cast("string"))
        groups.setdefault(window, (logic, needed, []))[2].append(ok.cast("int"))
    out = {}
    for window, (logic, needed, hits) in groups.items():
        out[window] = sum(hits[1:], hits[0]) >= {"ANY": 1, "SINGLE": 1, "AT_LEAST": needed}.get(logic, len(hits))
    return out


def blank_outliers(df: DataFrame, value: str, factor: float | None = 2.0, quantile: float | None = None) -> DataFrame:
    """Blanks values above factor x mean, or above a quantile; the cutoff is one row, added up first."""
    v = F.col(value)
    cut = F.percentile(value, F.lit(quantile)) if quantile else F.avg(v) * factor
    limit = df.agg(cut.alias("_cut"))
    out = df.crossJoin(F.broadcast(limit))  # one row
    return out.withColumn(value, F.when(~F.coalesce(v > F.col("_cut"), F.lit(False)), v)).select(*df.columns)


def strict_label(text: Column, labels: Sequence[str] = ("P", "N")) -> Column:
    """A label that stands alone, else null."""
    out = F.upper(F.trim(text))
    return F.when(out.isin(*labels), out)


def expect_none(df: DataFrame, what: str) -> None:
    """An error that names the first few rows, if there are any."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def expect_unique(df: DataFrame, keys: Sequence[str]) -> None:
    expect_none(df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "repeated keys")
