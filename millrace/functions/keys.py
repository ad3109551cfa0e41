"""Canonical keys, hashes and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import key_text


def canonical_json(texts: dict[str, Column], numbers: dict[str, Column]) -> Column:
    """JSON with sorted names: texts as keys, numbers to 8 digits, nulls kept."""
    fields = {n: key_text(c) for n, c in texts.items()} | {n: F.bround(c.cast("double"), 8) for n, c in numbers.items()}
    return F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"})


def content_hash(*columns: Column) -> Column:
    """sha256 of the columns as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def json_list(text: Column, element: str = "string") -> Column:
    """A JSON list, empty if the text is none."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def same_json(a: Column, b: Column) -> Column:
    """Equality of two values with their types, nulls equal."""
    return F.to_json(F.struct(a.alias("v")), {"ignoreNullFields": "false"}).eqNullSafe(F.to_json(F.struct(b.alias("v")), {"ignoreNullFields": "false"}))
