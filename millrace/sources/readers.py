"""Strict readers: explicit text schemas, one null policy right after the read, explicit row numbers."""

from __future__ import annotations

import csv
import gzip
import hashlib
import json
import os
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a table reader takes for missing by default.
TABLE_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CHAT = "messages array<struct<role:string,content:string>>"
CONDITION_TEXTS = ("metal_precursor", "organic_linker", "modulator", "solvent")
CONDITION_NUMBERS = ("metal_concentration_mM", "M_L_ratio", "temperature_C", "time_h")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, unique and none empty, else an error."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    names = next(csv.reader([first[0]["value"].lstrip("﻿").rstrip("\r")])) if first else []
    if not names or "" in names or len(set(names)) != len(names):
        raise ValueError(f"{path}: column names must be unique and none empty")
    return names


def read_csv_text(spark: SparkSession, path: str, nulls: Sequence[str] = TABLE_NULLS, strict: bool = False, keep_blank: bool = False) -> DataFrame:
    """All columns as text. nulls become null; with keep_blank blanks are empty texts instead. strict: ragged rows fail."""
    names = csv_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=False)
    if keep_blank:
        return df.select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))
    return df.select(*(F.when(~F.col(f"`{n}`").isin(*nulls), F.col(f"`{n}`")).alias(n) for n in names))


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Text columns cast by try_cast; texts that don't fit become null, as do NaN and infinities of doubles."""
    out = {}
    for name, kind in kinds.items():
        value = F.trim(F.col(name)).try_cast(kind)
        out[name] = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value) if kind == "double" else value
    return df.withColumns(out)


def with_row_id(df: DataFrame, name: str = "source_row_id") -> DataFrame:
    """Numbers rows in file order from 0. Meant right after a read of one file; the order there is that of the file."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType(), False)])
    return df.rdd.zipWithIndex().map(lambda p: (*p[0], p[1])).toDF(schema)


def read_lookup(spark: SparkSession, path: str, names: Sequence[str] = ("name", "value")) -> DataFrame:
    """A headerless table of a name and a number; names in lower case, rows without a finite number left out."""
    df = spark.read.csv(path, schema=f"{names[0]} string, {names[1]} string", header=False, multiLine=True, escape='"')
    df = typed(df, **{names[1]: "double"}).withColumn(names[0], F.lower(F.trim(names[0])))
    return df.filter(F.col(names[1]).isNotNull() & (F.col(names[0]) != "")).groupBy(names[0]).agg(F.min(names[1]).alias(names[1]))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat records with line numbers from 1, the conditions of the user message and the label; a bad record fails."""
    lines = with_row_id(spark.read.text(path).filter(F.trim("value") != ""), "line")
    fields = ", ".join([*(f"{n} string" for n in CONDITION_TEXTS), *(f"{n} double" for n in CONDITION_NUMBERS)])
    df = lines.select((F.col("line") + 1).alias("line"), F.from_json("value", CHAT, {"mode": "FAILFAST"}).alias("r"))
    role = lambda i: F.get(F.col("r.messages"), F.lit(i))
    shape = (F.size("r.messages") == 3) & (role(0)["role"] == "system") & (role(1)["role"] == "user") & (role(2)["role"] == "assistant") & role(2)["content"].isin("P", "N")
    ok = F.when(F.coalesce(shape, F.lit(False)), role(2)["content"]).otherwise(F.raise_error(F.concat(F.lit("not a chat record: line "), F.col("line"))))
    return df.select("line", F.col("r.messages").alias("messages"), F.from_json(role(1)["content"], fields).alias("conditions"), ok.alias("label"))


def inspect_lines(path: str) -> dict:
    """Rows, bytes and sha256 of a text file, gzipped or not; fails if the file changes while it is read."""
    before = os.stat(path)
    digest, rows = hashlib.sha256(), 0
    with open(path, "rb") as raw:
        for block in iter(lambda: raw.read(1 << 20), b""):
            digest.update(block)
    with gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb") as lines:
        rows = sum(1 for line in lines if line.strip())
    after = os.stat(path)
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        raise RuntimeError(f"{path} changed while it was read")
    return {"rows": rows, "bytes": after.st_size, "sha256": digest.hexdigest()}


def read_json_store(spark: SparkSession, folder: str, schema: str, record: str = r"synthesis_(\d+)\.json$") -> DataFrame:
    """(folder, record, data) of a folder of JSON files for each record."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").withColumn("_path", F.input_file_name())
    number = F.regexp_extract("_path", record, 1).try_cast("int")
    return files.select(F.element_at(F.split("_path", "/"), -2).alias("folder"), number.alias("record"), F.from_json("value", schema).alias("data"))


def first_available(preferred: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the preferred table, and of the other for keys that it lacks (a journal over its checkpoint)."""
    return preferred.unionByName(fallback.join(preferred.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def newest_run(spark: SparkSession, manifests: str) -> str:
    """Folder of the newest completed run by the manifests (JSON with status and created_utc)."""
    df = spark.read.json(manifests, multiLine=True).withColumn("_path", F.input_file_name()).filter("status = 'completed'")
    found = df.agg(F.max_by("_path", F.struct("created_utc", "_path")).alias("p")).first()["p"]
    if found is None:
        raise FileNotFoundError("no completed run")
    return found.rsplit("/", 1)[0]


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """(path, stem, extension, length) without contents; names that differ in case only are an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "length").filter(F.col("extension").isin(*extensions))
    clash = df.groupBy(F.lower("stem").alias("s"), "extension").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"files that differ in case only: {clash[0]['s']}.{clash[0]['extension']}")
    return df


def kind_of(content: Column) -> Column:
    """pdf, zip (docx), ole (doc) or text, by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("25504446"), "pdf").when(head == "504B0304", "zip").when(head == "D0CF11E0", "ole").otherwise("text")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, all cells as text, the first row as names."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter("{%s}t" % space["m"])) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", space)]
        sheets = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", space)]
        at = sheets.index(sheet) if sheet else 0
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{at + 1}.xml")).iter("{%s}row" % space["m"]):
            cells: dict[int, str | None] = {}
            for c in row.findall("m:c", space):
                place = 0
                for letter in re.match("[A-Z]+", c.get("r"))[0]:
                    place = place * 26 + ord(letter) - 64
                value = c.find("m:v", space)
                text = value.text if value is not None else "".join(t.text or "" for t in c.iter("{%s}t" % space["m"])) or None
                cells[place - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append(cells)
    names = [rows[0][i] for i in sorted(rows[0])] if rows else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(r.get(i) for i in range(len(names))) for r in rows[1:]], schema)


def questions(path: str, key: str = "reaction_id") -> list[dict]:
    """A panel of questions from one JSON file; ids must be unique."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    if len({r[key] for r in rows}) != len(rows):
        raise ValueError(f"{path}: repeated {key}")
    return rows
