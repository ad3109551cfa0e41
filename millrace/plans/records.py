"""Nested records, chat lines, formulas and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import formulas
from millrace.operators import profile, reshape
from millrace.session import table
from millrace.streaming import journal

_FORMULAS = [("Zn(NO3)2·6H2O", 297.4748), ("ZrCl4", 233.036), ("Cu(OAc)2·H2O", 199.6538), ("Al2(SO4)3", 342.155), ("Fe3O(OAc)6", 537.796), ("not a formula!", None), (None, None)]


_MASS_SQL = """SELECT * FROM (VALUES ('Zn(NO3)2·6H2O', round(65.38 + 2 * (14.0067 + 3 * 15.999) + 6 * (2 * 1.0079 + 15.999), 4)), ('ZrCl4', round(91.224 + 4 * 35.453, 4)),
 ('Cu(OAc)2·H2O', round(63.546 + 2 * (2 * 12.011 + 3 * 1.0079 + 2 * 15.999) + 2 * 1.0079 + 15.999, 4)), ('Al2(SO4)3', round(2 * 26.982 + 3 * (32.065 + 4 * 15.999), 4)),
 ('Fe3O(OAc)6', round(3 * 55.845 + 15.999 + 6 * (2 * 12.011 + 3 * 1.0079 + 2 * 15.999), 4)), ('not a formula!', NULL), (NULL, NULL)) AS t(formula, molar_mass)"""


@register("molar_mass_parse", _MASS_SQL)
def molar_mass_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formulas.with_molar_mass(spark.createDataFrame([(f,) for f, _ in _FORMULAS], "formula string"), "formula")
    return out.withColumn("molar_mass", F.round("molar_mass", 4))


@register("synthesis_features", "SELECT * FROM (VALUES (0, 50.0, 0.5), (1, 100.0, NULL), (2, NULL, 1.0), (3, NULL, NULL), (4, 25.0, 0.17), (5, NULL, 1.0)) AS t(i, metel_concnertation, M_L_ratio)")
def synthesis_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "0.5", "mmol", "a", "1.0", "mmol", None, "10"), (1, "1", "mmol", "a", "2", "mg", None, "10"), (2, "1", "g", "ratio 1 : 1", "2", "mmol", None, "5"), (3, "x", "mmol", None, "2", "mmol", "mg", "5"), (4, "1/2", "mmol", None, "3", "mmol", "nan", "20"), (5, "1", "g", "1：1", "1", "g", None, "5")]
    df = spark.createDataFrame(rows, "i int, metal_1_amount_value string, metal_1_amount_unit string, metal_1_amount_text string, linker_1_amount_value string, linker_1_amount_unit string, linker_2_amount_unit string, solvent_main_ml string")
    return formulas.synthesis_features(df).select("i", "metel_concnertation", "M_L_ratio")


@register("flatten_records", """SELECT o_orderkey, count(l_orderkey) AS n_lines, max(CASE WHEN nth = 1 THEN l_partkey END) AS line_1_part, max(CASE WHEN nth = 2 THEN l_partkey END) AS line_2_part, min(CASE WHEN l_returnflag = 'R' THEN nth END) AS first_returned
 FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1""")
def flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lines of an order to numbered slots, and the first of a role."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("part"), "l_suppkey", "l_quantity", F.col("l_returnflag").alias("role"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))  # an order has a few lines
    df = table(spark, sf_dir, "orders").select("o_orderkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    returned = F.nullif(F.array_position(F.transform("items", lambda s: s["role"]), "R"), F.lit(0).cast("bigint"))
    return df.select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_lines"), *(c.alias(n) for n, c in reshape.slots(F.col("items"), ["line_1", "line_2"], ["part"]).items()), returned.alias("first_returned"))


@register("chat_jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def chat_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("line"))
    return rows.select("conv_id", "turn", F.from_json("line", "role string, text string").alias("m")).select("conv_id", "turn", "m.role", "m.text")


@register("tumbling_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = journal.tumbling(events, "ts", "1 hour", ["event_type"], "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("session_events", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = journal.sessions(events, "ts", "1 day", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@register("resume_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_linenumber > 4").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("a").alias("identity"))
    return journal.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"], "a")


@register("repeated_journal_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_journal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.repeated_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@register("log_bins", "SELECT CAST(floor(log10(l_extendedprice) * 4) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def log_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(profile.log_bin(F.col("l_extendedprice")).alias("bin")).filter("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.count("*").alias("n"))
