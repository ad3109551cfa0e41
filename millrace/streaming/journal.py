"""Append-only journals, resumed runs and running metrics on Structured Streaming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_identity(settings: dict) -> str:
    """What a resumed run must share with the run it goes on with."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def pending(tasks: DataFrame, journal: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """Tasks without a record of this run; records of another identity are an error."""
    other = journal.filter(F.col("identity") != identity).limit(1).collect()
    if other:
        raise ValueError("the journal belongs to a run with other settings")
    return tasks.join(journal.select(*keys).distinct(), list(keys), "left_anti")


def answer(tasks: DataFrame, client: Callable[[], Callable[[dict], str]], identity: str, retries: int = 4, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The tasks with response, error and identity. Each task of Spark makes its own client.

    A failed call is repeated after 1, 2, 4, ... seconds (60 at most); then its error is recorded.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for rows in batches:
            said: list[tuple[str | None, str | None]] = []
            for row in rows.to_dict("records"):
                error = None
                for attempt in range(retries + 1):
                    try:
                        said.append((call(row), None))
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a client is recorded
                        error = f"{type(e).__name__}: {e}"
                        if attempt < retries:
                            wait(min(60.0, 2.0**attempt))
                else:
                    said.append((None, error))
            yield rows.assign(response=[s[0] for s in said], error=[s[1] for s in said], identity=identity)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return tasks.mapInPandas(ask, f"{kinds}, response string, error string, identity string")


def canary(tasks: DataFrame, client: Callable[[], Callable[[dict], str]], order: str) -> str:
    """The first task's response, asked on the driver: a refusal stops a run before the rest is sent."""
    first = tasks.orderBy(order).limit(1).collect()
    return client()(first[0].asDict()) if first else ""


def journal_stream(source: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Appends each micro-batch once: a batch that runs again finds its keys there."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(list(keys)).withColumn("batch", F.lit(number))
        spark = batch.sparkSession
        try:
            done = spark.read.schema(rows.schema).parquet(path).filter(F.col("batch") == number).select(*keys)
            rows = rows.join(done, list(keys), "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(source: DataFrame, by: Sequence[str], flags: dict[str, str]) -> DataFrame:
    """Rows and flagged rows so far; write in complete mode."""
    return source.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.expr(e)).alias(n) for n, e in flags.items()))


def repeated_keys(journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    return journal.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def failure_budget(journal: DataFrame, key: str, order: str, budget: int, boost: int) -> DataFrame:
    """What is left of each key's budget: a failure takes one, a success gives `boost`, never above the budget.

    The lowest running sum since the last time at the cap, over prefix sums: a window for each key, no loop.
    """
    from pyspark.sql import Window

    step = F.when(F.col("ok"), boost).otherwise(-1)
    w = Window.partitionBy(key).orderBy(order)
    total = F.sum("_step").over(w)
    rows = journal.withColumn("_step", step).withColumn("_total", total)
    over = F.greatest(F.max("_total").over(w), F.lit(0))
    return rows.withColumn("left", (F.lit(budget) + F.col("_total") - over).cast("int")).drop("_step", "_total")


def tumbling(events: DataFrame, time_column: str, width: str, by: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums in windows of event time; with `late`, a watermark for streams."""
    rows = events.withWatermark(time_column, late) if late else events
    return rows.groupBy(F.window(time_column, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time_column: str, gap: str, by: Sequence[str]) -> DataFrame:
    """(by, start, end, n) of runs of events closer than the gap."""
    return events.groupBy(F.session_window(time_column, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
