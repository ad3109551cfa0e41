import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import journal


def test_csv_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿name,amount\n"a\nb",1.5\nNA,x\n,nan\n', encoding="utf-8")
    df = readers.read_csv_text(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("a\nb", "1.5"), (None, "x"), (None, None)]
    assert [r.amount for r in readers.typed(df, amount="double").collect()] == [1.5, None, None]
    assert [tuple(r) for r in readers.read_csv_text(spark, str(path), keep_blank=True).collect()][2] == ("", "nan")
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="unique"):
        readers.read_csv_text(spark, str(tmp_path / "b.csv"))


def test_chat_round_trip(spark, tmp_path):
    rows = [("Zn", 1.5, True), (None, None, False)]
    df = spark.createDataFrame([(m, None, None, None, c, None, None, None, y, i) for i, (m, c, y) in enumerate(rows)], ", ".join([*(f"{n} string" for n in readers.CONDITION_TEXTS), *(f"{n} double" for n in readers.CONDITION_NUMBERS), "y boolean", "i int"]))
    writers.write_chat(df, str(tmp_path / "c"), "say P or N", [*readers.CONDITION_TEXTS, *readers.CONDITION_NUMBERS], F.col("y"), order="i")
    back = readers.read_chat(spark, str(tmp_path / "c")).orderBy("line").collect()
    assert [(r.conditions.metal_precursor, r.conditions.metal_concentration_mM, r.label) for r in back] == [("Zn", 1.5, "P"), (None, None, "N")]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "x"}]}) + "\n")
    with pytest.raises(Exception, match="not a chat record"):
        readers.read_chat(spark, str(tmp_path / "bad.jsonl")).collect()


def test_strict_append_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny"), ("", "z")], "k string, v string")
    assert writers.append_strict(df, str(tmp_path / "o"), ["k", "v"]) == 1
    with pytest.raises(ValueError, match="differ"):
        writers.append_strict(df, str(tmp_path / "o"), ["k"])
    writers.write_json({"a": 1}, str(tmp_path / "m.json"))
    assert writers.manifest([tmp_path / "m.json"], {}, {})["inputs"]
    assert readers.inspect_lines(str(tmp_path / "m.json"))["rows"] == 3
    assert writers.new_run_folder(str(tmp_path / "runs")).name == "run_001" and writers.new_run_folder(str(tmp_path / "runs")).name == "run_002"


def test_answers_and_resume(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b")], "k int, q string")

    def client():
        seen = {}

        def call(row):
            seen[row["k"]] = seen.get(row["k"], 0) + 1
            if row["k"] == 2 or seen[row["k"]] < 2:
                raise RuntimeError("busy")
            return row["q"].upper()

        return call

    got = {r.k: (r.response, r.error) for r in journal.answer(tasks, client, "id", 2, lambda s: None).collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: busy")}
    done = spark.createDataFrame([(1, "id")], "k int, identity string")
    assert [r.k for r in journal.pending(tasks, done, ["k"], "id").collect()] == [2]
    with pytest.raises(ValueError, match="other settings"):
        journal.pending(tasks, done, ["k"], "new")


def test_journal_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = journal.event_stream(spark, str(tmp_path / "in"), "k int, v string")
        journal.journal_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k"]).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_failure_budget(spark):
    rows = [("a", i, ok) for i, ok in enumerate([False, False, True, False, True, True, True, False])]
    left, want = 3, []
    for _, _, ok in rows:
        left = min(3, left + 2) if ok else left - 1
        want.append(left)
    df = spark.createDataFrame(rows, "k string, i int, ok boolean")
    assert [r.left for r in journal.failure_budget(df, "k", "i", 3, 2).orderBy("i").collect()] == want
