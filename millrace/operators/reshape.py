"""Projections: nested to wide, wide to long, option products and rule texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def insert_column(df: DataFrame, name: str, value: Column, after: str) -> DataFrame:
    """The column right after another one; one of its name is replaced."""
    kept = [c for c in df.columns if c != name]
    at = kept.index(after) + 1
    return df.select(*kept[:at], value.alias(name), *kept[at:])


def slot(items: Column, i: int, field: str) -> Column:
    """A field of the i-th struct (from 0), null beyond the end."""
    return F.get(items, F.lit(i))[field]


def slots(items: Column, names: Sequence[str], fields: Sequence[str]) -> dict[str, Column]:
    """{name_field: column} of the first structs of an array, further ones are left out."""
    return {f"{n}_{f}": slot(items, i, f) for i, n in enumerate(names) for f in fields}


def by_role(items: Column, role: str, field: str = "role") -> Column:
    """The first struct of a role."""
    return F.get(F.filter(items, lambda s: F.lower(s[field]) == role), F.lit(0))


def explode_records(df: DataFrame, items: str, number: str = "record") -> DataFrame:
    """A row for each struct with its number from 0; rows without any keep one row with nulls."""
    kept = [c for c in df.columns if c != items]
    return df.select(*kept, F.posexplode_outer(items).alias(number, items))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], keep_empty: bool = False) -> DataFrame:
    out = df.unpivot(list(ids), list(columns), "field", "value")
    return out if keep_empty else out.filter(F.col("value").isNotNull())


def explode_json(df: DataFrame, column: str, kind: str = "string") -> DataFrame:
    """(key, value) rows of a JSON object."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.explode(F.from_json(column, f"map<string,{kind}>")).alias("key", "value"))


def option_product(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """{field: array column}: every combination, the first list slowest; an empty list keeps the row's own field.

    Combinations are made row by row, so nothing is dealt out. variant numbers them from 0.
    """
    lists = {f: F.when(F.size(F.coalesce(F.col(a), F.array())) > 0, F.col(a)).otherwise(F.array(F.col(f))) for f, a in options.items()}
    sizes = [F.size(x) for x in lists.values()]
    total = reduce(lambda a, b: a * b, sizes)
    rows = df.select("*", *(x.alias(f"_l{i}") for i, x in enumerate(lists.values())), F.explode(F.sequence(F.lit(0), total - 1)).alias("variant"))
    picks, left = {}, F.col("variant")
    for i, f in reversed(list(enumerate(lists))):
        n = F.size(f"_l{i}")
        picks[f] = F.get(f"_l{i}", F.pmod(left, n).cast("int"))
        left = F.floor(left / n)
    return rows.withColumns(picks).select(*df.columns, "variant")


def grid(spark, **values: Sequence) -> DataFrame:
    """The product of literal lists, from one range of row numbers: the first list slowest."""
    total = reduce(lambda a, b: a * b, (len(v) for v in values.values()), 1)
    left, columns = F.col("id"), {}
    for name, items in reversed(list(values.items())):
        columns[name] = F.get(F.array(*map(F.lit, items)), F.pmod(left, F.lit(len(items))).cast("int"))
        left = F.floor(left / len(items))
    return spark.range(total).select(F.col("id").alias("row_id"), *(columns[n].alias(n) for n in values))


def keep_first_half(options: Column) -> Column:
    """The first half of a list, rounded up."""
    return F.slice(options, F.lit(1), F.ceil(F.size(options) / 2).cast("int"))


def exclude_options(options: Column, excluded: Column) -> Column:
    return F.filter(options, lambda x: ~F.array_contains(excluded, x))


def parse_rules(df: DataFrame, column: str) -> DataFrame:
    """Rows of a rule text: ALL:, ANY: or AT_LEAST(k): then rules parted by ; .

    Adds logic, needed, rule_no, field, predicate and value_1, value_2. Forms: field from a to b, field > a,
    field < a, field is not x, field one of x, y, field = x; others are freetext.
    """
    head = r"^\s*(ALL|ANY|AT_LEAST)(?:\((\d+)\))?\s*:"
    logic = F.regexp_extract(column, head, 1)
    rows = df.withColumns({"logic": F.when(logic == "", "SINGLE").otherwise(logic), "needed": F.regexp_extract(column, head, 2).try_cast("int")})
    rows = rows.select("*", F.posexplode(F.split(F.regexp_replace(column, head, ""), ";")).alias("rule_no", "_r")).withColumn("_r", F.trim("_r")).filter("_r != ''")
    forms = [
        ("range", r"^(.+?)\s+from\s+(\S+)\s+to\s+(\S+)$"), ("gt", r"^(.+?)\s*>\s*(\S+)()$"), ("lt", r"^(.+?)\s*<\s*(\S+)()$"),
        ("exclusion", r"^(.+?)\s+is\s+not\s+(.+?)()$"), ("discrete_set", r"^(.+?)\s+one\s+of\s+(.+?)()$"), ("categorical_equals", r"^(.+?)\s*=\s*(.+?)()$"),
    ]
    kind, parts = F.lit("unparsed_freetext"), [F.lit(None).cast("string")] * 3
    for name, pattern in reversed(forms):
        hit = F.col("_r").rlike(pattern)
        kind = F.when(hit, name).otherwise(kind)
        parts = [F.when(hit, F.nullif(F.regexp_extract("_r", pattern, k + 1), F.lit(""))).otherwise(p) for k, p in enumerate(parts)]
    return rows.select(*df.columns, "logic", "needed", "rule_no", kind.alias("predicate"), *(p.alias(n) for p, n in zip(parts, ("field", "value_1", "value_2"), strict=True)))


def format_rule(field: Column, predicate: Column, a: Column, b: Column) -> Column:
    """The text of one rule."""
    return (
        F.when(predicate == "range", F.concat(field, F.lit(" from "), a, F.lit(" to "), b)).when(predicate == "gt", F.concat_ws(" > ", field, a)).when(predicate == "lt", F.concat_ws(" < ", field, a))
        .when(predicate == "exclusion", F.concat_ws(" is not ", field, a)).when(predicate == "discrete_set", F.concat_ws(" one of ", field, a)).otherwise(F.concat_ws(" = ", field, a))
    )


def chat_messages(system: str, user: Column, assistant: Column) -> Column:
    """The three messages of a chat record."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", F.lit(system)), say("user", user), say("assistant", assistant))
