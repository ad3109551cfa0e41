"""Sinks: chat lines, shards, strict appends, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import one_line
from millrace.operators.reshape import chat_messages
from millrace.operators.split import seeded


def write_chat(df: DataFrame, path: str, system: str, conditions: Sequence[str], label: Column, seed: int | None = None, order: str | None = None) -> None:
    """Chat lines with the conditions as JSON, nulls kept; in a seeded order, or that of a column."""
    body = F.to_json(F.struct(*conditions), {"ignoreNullFields": "false"})
    line = F.to_json(F.struct(chat_messages(system, body, F.when(label, "P").otherwise("N")).alias("messages")))
    by = seeded(seed, *conditions) if seed is not None else F.col(order)
    df.select(line.alias("value"), by.alias("_by")).orderBy("_by").select("value").write.mode("errorifexists").text(path)


def write_shards(df: DataFrame, path: str, shard: str, line: Column) -> None:
    """A folder for each shard, with zero-padded numbers."""
    df.select(F.lpad(F.col(shard).cast("string"), 4, "0").alias("part"), line.alias("value")).write.mode("errorifexists").partitionBy("part").text(path)


def append_strict(df: DataFrame, path: str, columns: Sequence[str]) -> int:
    """Appends rows as quoted CSV on one line each; the columns must be the given set. Returns the rows left out for an empty first column."""
    if set(df.columns) != set(columns) or len(df.columns) != len(columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(columns))}")
    rows = df.select(*(one_line(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns))
    bad = rows.filter(F.col(columns[0]) == "").count()
    rows.filter(F.col(columns[0]) != "").write.mode("append").csv(path, header=True, quoteAll=True, escape='"')
    return bad


def write_csv_text(df: DataFrame, path: str) -> None:
    """All columns as text, nulls as blanks."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def export_csv(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One CSV file with a byte-order mark, for tables of at most `most` rows; written aside and renamed."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write a folder instead")
    rows = df.toPandas()
    handle, aside = tempfile.mkstemp(dir=Path(path).parent)
    os.close(handle)
    rows.to_csv(aside, index=False, encoding="utf-8-sig", na_rep="")
    os.replace(aside, path)


def write_json(data: object, path: str) -> None:
    """JSON written aside and renamed, so readers see the old or the new file."""
    handle, aside = tempfile.mkstemp(dir=Path(path).parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(aside, path)


def manifest(inputs: Sequence[str], settings: dict, counts: dict) -> dict:
    """Hashes of the inputs, the settings and row counts of a run."""
    digest = lambda p: hashlib.sha256(Path(p).read_bytes()).hexdigest()
    return {"inputs": {str(p): digest(p) for p in inputs}, "settings": settings, "counts": counts}


def new_run_folder(root: str) -> Path:
    """run_001, run_002, ...: the first that does not exist yet."""
    for k in range(1, 10_000):
        path = Path(root) / f"run_{k:03d}"
        try:
            path.mkdir(parents=True)
        except FileExistsError:
            continue
        return path
    raise RuntimeError("too many runs")


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows but for the keys of new, then new: a forced rerun in place."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
