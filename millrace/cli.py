"""Command line: python -m millrace.cli COMMAND ... reads and writes tables; each command is one operator or stage list.

Tables are folders of Parquet, or CSV files with a header (all text) where the path ends in .csv.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import curate, dedup, evaluate, joins, profile, reshape, split, stats
from millrace.session import local_session


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"') if path.endswith(".csv") else spark.read.parquet(path)


def write(df: DataFrame, path: str) -> int:
    if path.endswith(".csv"):
        df.na.fill("").coalesce(1).write.csv(path, header=True, escape='"', mode="errorifexists")
    else:
        df.write.parquet(path, mode="errorifexists")
    return df.sparkSession.read.parquet(path).count() if not path.endswith(".csv") else df.count()


def curation(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Metals, linkers, solvents and temperatures, all or one of them; validate names the missing columns."""
    df = read(spark, a.input)
    if a.action == "validate":
        missing = sorted({"metal_1", "linker_1", "solvent_main"} - set(df.columns))
        return {"valid": not missing, "missing": missing, "rows": df.count()}
    stages = [("temperatures", lambda d: curate.clean_temperatures(d, a.mode == "positive")), ("metals", curate.clean_metals), ("linkers", lambda d: curate.clean_linkers(d, read(spark, a.weights))), ("solvents", curate.clean_solvents)]
    if a.action == "report":
        return {"rows": df.count(), "top": [r.asDict() for r in profile.value_counts(df, "metal_1", 10).collect()]}
    out, counts = curate.run_stages(df, [s for s in stages if a.stage in ("all", s[0])])
    return {"rows": write(out, a.output), "stages": counts}


def corrections(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Exact replacements of values by a table (key, value, replacement)."""
    df = read(spark, a.input)
    return {"rows": write(joins.correct_values(df, read(spark, a.rules), a.key, a.columns.split(",")), a.output)}


def process_details(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Classes of vessels, capacities and agitation beside the raw texts."""
    return {"rows": write(curate.process_columns(read(spark, a.input)), a.output)}


def prepare(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Conflict filter, keep-first and a cluster-disjoint holdout of labelled records (id, condition_key, cluster_key, is_success)."""
    df = read(spark, a.input).withColumn("is_success", F.col("is_success").cast("boolean"))
    if a.action == "validate":
        return {"valid": {"id", "condition_key", "cluster_key", "is_success"} <= set(df.columns), "rows": df.count()}
    clean = dedup.keep_first(dedup.drop_conflicting(df, ["condition_key"], "is_success", ~F.col("is_success")), ["condition_key", "is_success"], ["id"])
    stats_ = split.cluster_stats(clean, "cluster_key", F.col("is_success"), F.lit(False))
    both = split.assign_split(clean, split.choose_holdout(stats_, "cluster_key", seed=a.seed), "cluster_key")
    return {"rows": write(both, a.output)}


def ablations(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Each negative's nearest positive by changed fields, and the negatives without those of distance 1."""
    fields = a.fields.split(",")
    df = read(spark, a.input).withColumn("is_success", F.col("is_success").cast("boolean"))
    near = evaluate.nearest_positives(df.filter("NOT is_success"), df.filter("is_success"), a.key, fields)
    kept = df.join(near.filter("distance = 1").select(a.key), a.key, "left_anti")
    return {"rows": write(kept, a.output)}


def grid(spark: SparkSession, a: argparse.Namespace) -> dict:
    """All combinations of option lists in a JSON file, up to a limit, in order."""
    with open(a.input, encoding="utf-8") as f:
        options = json.load(f)
    out = reshape.grid(spark, **options)
    return {"rows": write(out.filter(F.col("row_id") < a.limit) if a.limit else out, a.output)}


def shards(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Contiguous shards of even size, a folder for each."""
    out = split.shards(read(spark, a.input), a.key, a.splits)
    out.write.partitionBy("shard").parquet(a.output, mode="errorifexists")
    return {"rows": out.count(), "splits": a.splits}


def match(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Documents and their files by stem; pdf before docx before doc."""
    out = joins.match_by_priority(read(spark, a.input), read(spark, a.files), a.key, "ext", ["pdf", "docx", "doc"])
    return {"rows": write(out, a.output)}


def score(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Scores of saved predictions (index, model, gold, predicted)."""
    return evaluate.score_predictions(read(spark, a.input), "index", "model", "gold", "predicted")


def calibration(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Guards the input of calibration (y, and a probability for each model) and counts it."""
    df = read(spark, a.input)
    probabilities = [c for c in df.columns if c != "y"]
    df = df.select(F.col("y").cast("int").alias("y"), *(F.col(f"`{c}`").cast("double").alias(c) for c in probabilities))
    return {"rows": evaluate.check_calibration(df, "y", probabilities).count(), "models": probabilities}


def agreement(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Wilson interval of a share (label, answer)."""
    df = read(spark, a.input)
    n = df.agg(F.count("*").alias("n"), F.count_if(F.lower("label") == F.lower("answer")).alias("k")).first()
    low, high = spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(stats.wilson(F.lit(n["k"]), F.lit(n["n"]))))).first() if n["n"] else (0.0, 0.0)
    return {"n": n["n"], "right": n["k"], "low": low, "high": high}


def distributions(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Counts of a column's values, most frequent first."""
    df = read(spark, a.input)
    out = df.groupBy(text.clean_text(F.col(a.key)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return {"rows": write(out, a.output)}


#: name: (function, arguments besides input); those with = have a default.
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], dict], tuple[str, ...]]] = {
    "curation": (curation, ("action", "output=", "weights=", "mode=positive", "stage=all")),
    "corrections": (corrections, ("rules", "key", "columns", "output")),
    "process-details": (process_details, ("output",)),
    "prepare": (prepare, ("action", "output=", "seed=42")),
    "ablations": (ablations, ("key", "fields", "output")),
    "grid": (grid, ("output", "limit=0")),
    "shards": (shards, ("key", "output", "splits=5")),
    "match": (match, ("files", "key", "output")),
    "score": (score, ()),
    "calibration": (calibration, ()),
    "agreement": (agreement, ()),
    "distributions": (distributions, ("key", "output")),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (function, arguments) in COMMANDS.items():
        sub = commands.add_parser(name, help=function.__doc__)
        sub.add_argument("input")
        for a in arguments:
            key, has, value = a.partition("=")
            if key == "action":
                sub.add_argument("--action", choices=("validate", "run", "report"), default="run")
            else:
                sub.add_argument(f"--{key}", required=not has, default=int(value) if value.isdigit() else value, type=int if value.isdigit() else str)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        print(json.dumps(COMMANDS[a.command][0](spark or local_session(name="millrace-cli"), a), ensure_ascii=False, default=str))
    except (OSError, ValueError, KeyError) as error:
        print(f"{a.command}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
