"""Records for training and their prompts: plans, manual questions, added fields, bundles, matched negatives."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import time
from collections.abc import Callable, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.operators.rules import expect_none

MESSAGES = "messages array<struct<role:string,content:string>>"


def flatten_plans(plans: DataFrame, keys: Sequence[str], options: Sequence[str]) -> DataFrame:
    """Plans with their option lists as JSON text; lists without entries are empty, plans without any list go."""
    some = F.lit(False)
    for o in options:
        some = some | (F.coalesce(F.size(o), F.lit(0)) > 0)
    return plans.filter(some).select(*keys, *(F.when(F.size(o) > 0, F.to_json(o)).otherwise("").alias(o) for o in options))


def manual_rows(spark: SparkSession, path: str, prompt: str, fields: Sequence[str], labels: Sequence[str] = ("P", "N")) -> DataFrame:
    """(record_id, messages, text, label, difficulty) of lines in either layout: chat messages, or the fields themselves.

    An error for lines without a label.
    """
    flat = ", ".join(f"{f} string" for f in fields)
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    rows = lines.select("_at", F.from_json("value", f"{MESSAGES}, label string, record_id string, difficulty string").alias("x"), F.from_json("value", flat, {"primitivesAsString": "true"}).alias("flat"))
    said = lambda role: F.element_at(F.filter("x.messages", lambda m: m["role"] == role), -1)["content"]
    chat = F.col("x.messages").isNotNull()
    text = F.when(chat, said("user")).otherwise(F.to_json("flat", {"ignoreNullFields": "false"}))
    label = F.upper(F.trim(F.when(chat, said("assistant")).otherwise(F.col("x.label"))))
    own = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
    messages = F.when(chat, F.filter("x.messages", lambda m: m["role"].isin("system", "user"))).otherwise(own)
    out = rows.select(F.coalesce("x.record_id", F.concat(F.lit("manual_"), F.col("_at").cast("string"))).alias("record_id"), messages.alias("messages"), text.alias("text"), label.alias("label"), F.coalesce("x.difficulty", F.lit("")).alias("difficulty"))
    expect_none(out.filter(~F.coalesce(F.col("label").isin(*labels) & F.col("text").isNotNull(), F.lit(False))).select("record_id"), "lines without a question or a label")
    return out


def replace_counted(text: str, old: str, new: str, times: int = 1) -> str:
    """The text with old replaced; an error unless it is there exactly so many times."""
    if text.count(old) != times:
        raise ValueError(f"{old!r} stands {text.count(old)} times, not {times}")
    return text.replace(old, new)


def extend_prompt(prompt: str, last_fields: str, more: Sequence[str], before: str | None = None, definition: str = "") -> str:
    """A prompt whose list of inputs ends with more fields; a definition goes in before a line that stands once."""
    *head, last = [f.strip().removeprefix("and ").rstrip(".") for f in last_fields.split(", and ")] if ", and " in last_fields else [last_fields.rstrip(".")]
    names = [*head, last, *more]
    out = replace_counted(prompt, last_fields, f"{', '.join(names[:-1])}, and {names[-1]}.")
    return replace_counted(out, before, definition + before) if before else out


def add_fields(chat: DataFrame, more: DataFrame, key: str, fields: Sequence[str], prompt: Callable[[str], str] | None = None) -> DataFrame:
    """Chat rows (key, messages) with fields of their key at the end of the user's JSON, and the system's prompt edited.

    Answers stay. An error for rows without fields. A prompt is edited once, as all rows must share it.
    """
    named = more.select(F.col(key).alias("_k"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("_more"))
    joined = chat.join(named, F.col(key) == F.col("_k"), "left")
    expect_none(joined.filter("_more IS NULL").select(key), "rows without process values")
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    system = said("system")
    if prompt:
        prompts = [r[0] for r in chat.select(system.alias("p")).distinct().limit(2).collect()]
        if len(prompts) != 1:
            raise ValueError("rows have different prompts")
        system = F.lit(prompt(prompts[0]))
    user = F.concat(F.regexp_replace(said("user"), r"\s*}\s*$", ""), F.lit(", "), F.substring("_more", 2, 1 << 30))
    content = lambda m: F.when(m["role"] == "system", system).when(m["role"] == "user", user).otherwise(m["content"])
    out = joined.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), content(m).alias("content"))))
    return out.select(*chat.columns)


def check_process_values(df: DataFrame, allowed: dict[str, Sequence[str]], volume: str) -> DataFrame:
    """The rows; an error for classes that are not allowed and volumes that are neither positive nor a status."""
    bad = F.lit(False)
    for column, values in allowed.items():
        bad = bad | ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    number = F.col(volume).try_cast("double")
    expect_none(df.filter(bad | ~F.coalesce(F.col(volume).isin("Not reported", "Ambiguous") | (number > 0), F.lit(False))), "process values out of range")
    return df


def count_tokens(tokenize: Callable[[str], int]):
    """A column function that counts tokens by an injected tokenizer, batch by batch."""

    @F.pandas_udf(IntegerType())
    def each(text: pd.Series) -> pd.Series:
        return text.fillna("").map(tokenize).astype("int32")

    return each


def prompt_bundle(chat: DataFrame, tokenize: Callable[[str], int], longest: int, labels: Sequence[str] = ("P", "N")) -> tuple[DataFrame, DataFrame]:
    """(rows with prompt, answer and n_tokens; rows that are too long) from chat rows; an error for answers that are no label."""
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    rows = chat.withColumns({"prompt": F.concat_ws("\n\n", said("system"), said("user")), "answer": F.upper(F.trim(said("assistant")))})
    expect_none(rows.filter(~F.coalesce(F.col("answer").isin(*labels), F.lit(False))).select("answer"), "answers that are no label")
    rows = rows.withColumn("n_tokens", count_tokens(tokenize)("prompt"))
    return rows.filter(F.col("n_tokens") <= longest), rows.filter(F.col("n_tokens") > longest)


def check_bundle(chat: DataFrame, fields: Sequence[str], labels: Sequence[str] = ("P", "N")) -> dict[str, int]:
    """Rows by label; an error for other roles, fields, labels, or more than one system prompt."""
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    rows = chat.select(F.transform("messages", lambda m: m["role"]).alias("roles"), F.array_sort(F.json_object_keys(said("user"))).alias("fields"), said("assistant").alias("label"), said("system").alias("prompt"))
    wrong = (F.col("roles") != F.array(*map(F.lit, ("system", "user", "assistant")))) | (F.col("fields") != F.array(*map(F.lit, sorted(fields)))) | ~F.col("label").isin(*labels)
    expect_none(rows.filter(F.coalesce(wrong, F.lit(True))), "rows of another form")
    if rows.select("prompt").distinct().limit(2).count() > 1:
        raise ValueError("rows have different prompts")
    return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}


def count_matched_negatives(rows: DataFrame, donors: DataFrame, key: str, fields: Sequence[str], changes: str, taken: DataFrame, seed: int, attempts: int = 64, rounds: int = 24) -> DataFrame:
    """Synthetic negatives: an anchor's condition with `changes` of its fields drawn anew from donors by their counts.

    rows: (key, anchor values under the names of fields, changes). A draw that equals the anchor's value, a condition in
    `taken`, or another synthetic one is rejected and drawn again; the fields that change stay chosen. An error names
    the rows that found none. Draws are hashes of seed, key, field and attempt, so any executor makes the same ones.
    """
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("\x00"))
    tables = {}
    for f in fields:  # a column's donor values with their running counts: as large as its distinct values
        counts = donors.groupBy(value(f).alias("v")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("hi", upto).orderBy("v").toPandas()
        tables[f] = (found["v"].tolist(), found["hi"].tolist())
    used = taken.select(F.xxhash64(*(value(f) for f in fields)).alias("_c")).distinct()
    chosen = F.slice(F.transform(F.array_sort(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(f)).alias("h"), F.lit(f).alias("f")) for f in fields))), lambda s: s["f"]), F.lit(1), F.col(changes))
    open_, out = rows.withColumn("_fields", chosen), None
    for r in range(rounds):
        tries = open_.withColumn("_try", F.explode(F.sequence(F.lit(r * attempts), F.lit((r + 1) * attempts - 1))))
        drawn, fresh = tries, F.lit(True)
        for f in fields:
            names, tops = tables[f]
            u = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.lit(f), F.col("_try")), F.lit(int(tops[-1]))).cast("bigint")
            at = F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t <= u))
            pick = F.get(F.array(*map(F.lit, names)), at)
            moves = F.array_contains("_fields", f)
            fresh = fresh & (~moves | (pick != value(f)))
            drawn = drawn.withColumn(f"_new_{f}", F.when(moves, pick).otherwise(value(f)))
        new = drawn.filter(fresh).withColumn("_c", F.xxhash64(*(F.col(f"_new_{f}") for f in fields))).join(used, "_c", "left_anti")
        first = Window.partitionBy(key).orderBy("_try")
        own = new.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
        once = Window.partitionBy("_c").orderBy(key)
        done = own.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1")
        done = done.select(key, *(F.nullif(F.col(f"_new_{f}"), F.lit("\x00")).alias(f) for f in fields), "_c")
        out = done if out is None else out.unionByName(done)
        open_ = open_.join(done.select(key), key, "left_anti")
        used = used.unionByName(done.select("_c"))
        if not open_.limit(1).count():
            return out.drop("_c")
    expect_none(open_.select(key), "no synthetic negative was found")
    return out.drop("_c")


# --- files, runs and paths on the driver


def shown_path(path: str | Path, root: str | Path) -> str:
    """A path without what stands before the root, or only its name when it is elsewhere."""
    path, root = Path(path), Path(root)
    return str(path.relative_to(root)) if path.is_relative_to(root) else f".../{path.name}"


def refuse_aliases(outputs: Sequence[str | Path], inputs: Sequence[str | Path]) -> None:
    """An error if an output is an input, by whatever name."""
    known = {Path(p).resolve() for p in inputs}
    for p in outputs:
        if Path(p).resolve() in known:
            raise ValueError(f"{p} is an input too")


def slug_paths(rows: DataFrame, key: str, slug: Column, root: str) -> DataFrame:
    """rows with a path below root by their slug; an error if two keys have one slug."""
    named = rows.withColumn("_slug", slug)
    expect_none(named.groupBy("_slug").agg(F.count_distinct(key).alias("n")).filter("n > 1"), "keys with the same slug")
    return named.withColumn("path", F.concat(F.lit(f"{root}/"), F.col("_slug"))).drop("_slug")


def content_hash(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def working_copy(path: str | Path, folder: str | Path) -> Path:
    """A copy of a file named by its content, made once."""
    path, folder = Path(path), Path(folder)
    target = folder / f"{content_hash(path)[:16]}-{path.name}"
    if not target.exists():
        folder.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(f"{target.suffix}.part")
        part.write_bytes(path.read_bytes())
        os.replace(part, target)
    return target


def store_payload(folder: str | Path, files: dict[str, object], keep: Sequence[str] = ()) -> None:
    """JSON files of one key's folder; files of an earlier run that are not among them go."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, value in files.items():
        part = folder / f"{name}.part"
        part.write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
        os.replace(part, folder / name)
    for old in folder.iterdir():
        if old.name not in files and old.name not in keep:
            old.unlink()


class RunRecord:
    """What a run read, where it ran and how long it took; written as JSON when the block ends, failed or not."""

    def __init__(self, path: str | Path, inputs: Sequence[str | Path]) -> None:
        self.path, self.facts = Path(path), {"inputs": {Path(p).name: content_hash(p) for p in inputs}, "python": platform.python_version(), "system": platform.system()}

    def __enter__(self) -> RunRecord:
        self.began = time.monotonic()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.facts |= {"elapsed_s": round(time.monotonic() - self.began, 3), "ok": kind is None, "error": str(value) if value else ""}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.facts, indent=1), encoding="utf-8")


def golden_differences(got: DataFrame, wanted: DataFrame, on: Sequence[str], rtol: float = 1e-9, atol: float = 0.0) -> DataFrame:
    """(on, column, got, wanted) of cells that differ; numbers within a tolerance are equal, rows on one side only show null."""
    columns = [c for c in wanted.columns if c not in on]
    a = got.select(*on, F.lit(True).alias("_a"), *(F.col(c).cast("string").alias(f"a_{c}") for c in columns))
    b = wanted.select(*on, F.lit(True).alias("_b"), *(F.col(c).cast("string").alias(f"b_{c}") for c in columns))
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("got"), F.col(f"b_{c}").alias("wanted"))
    long = a.join(b, list(on), "full").select(*on, (F.col("_a").isNull() | F.col("_b").isNull()).alias("_one"), F.explode(F.array(*map(cell, columns))).alias("x"))
    x, y = F.col("x.got").try_cast("double"), F.col("x.wanted").try_cast("double")
    close = F.coalesce(F.abs(x - y) <= F.lit(atol) + rtol * F.abs(y), F.lit(False))
    return long.filter(F.col("_one") | ~(close | F.col("x.got").eqNullSafe(F.col("x.wanted")))).select(*on, "x.column", "x.got", "x.wanted")


def check_requests(questions: int, rounds: int, models: int, expected: int | None = None) -> int:
    """questions x rounds x models; an error if any is not positive or the product is not what was expected."""
    if min(questions, rounds, models) < 1:
        raise ValueError("questions, rounds and models must be positive")
    n = questions * rounds * models
    if expected is not None and n != expected:
        raise ValueError(f"{n} requests, not {expected}")
    return n
