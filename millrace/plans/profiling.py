"""Profiles and scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import text
from millrace.operators import joins, matching, profile, stats
from millrace.session import table


@register("value_counts_topk", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def value_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@register("bottom_counts", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n, o_custkey LIMIT 10")
def bottom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_custkey", 10, ascending=True)


@register("rank_labels", "SELECT * FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 5")
def rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ranked_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", 5)


@register("distinct_entity_counts", "SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1")
def distinct_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rows_and_entities(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


@register("per_entity_median_distribution", "SELECT count(*) AS n, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max, round(avg(v), 6) AS mean, round(sum(v), 4) AS total FROM (SELECT l_orderkey, median(l_quantity) AS v FROM lineitem GROUP BY 1)")
def per_entity_median_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.summary(profile.entity_medians(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity"), "value")
    return out.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@register("group_mode_lowest", "SELECT o_custkey, y FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, year(o_orderdate)) AS nth FROM orders GROUP BY o_custkey, year(o_orderdate)) WHERE nth = 1")
def group_mode_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_mode(table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y")), "o_custkey", "y")


@register("domain_shares", "SELECT v AS value, count(e.event_type) AS n, round(count(e.event_type) * 100.0 / (SELECT count(*) FROM events), 6) AS percent FROM (VALUES ('view'), ('click'), ('refund'), ('Not reported')) AS d(v) LEFT JOIN events e ON e.event_type = v GROUP BY v")
def domain_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.domain_shares(table(spark, sf_dir, "events"), "event_type", ["view", "click", "refund"]).withColumn("percent", F.round("percent", 6))


@register("labelled_cut_bins", "SELECT bin, count(n_chars) AS n FROM (VALUES ('short', 0, 500), ('middle', 500, 5000), ('long', 5000, 10000000)) AS b(bin, lo, hi) LEFT JOIN documents ON n_chars > lo AND n_chars <= hi OR n_chars = lo AND lo = 0 GROUP BY bin")
def labelled_cut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cut_bins(table(spark, sf_dir, "documents"), "n_chars", [0, 500, 5000, 10_000_000], ["short", "middle", "long"])


@register("equal_width_histogram", "SELECT CAST(b AS INTEGER) AS bin, count(l_quantity) AS n FROM range(20) t(b) LEFT JOIN lineitem ON b = least(floor((l_quantity - 1) / 2.45), 19) GROUP BY b")
def equal_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 20, 1.0, 50.0)


@register("coordinate_multiplicity", "SELECT l_quantity, l_discount, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_discount > 0 GROUP BY 1, 2")
def coordinate_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.multiplicity(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", positive=True)


@register("pivot_period_counts", "SELECT o_orderpriority, count(*) FILTER (year(o_orderdate) = 1995) AS n_1995, count(*) FILTER (year(o_orderdate) = 1996) AS n_1996, count(*) AS total, round(count(*) * 100.0 / (SELECT count(*) FROM orders WHERE year(o_orderdate) IN (1995, 1996)), 6) AS percent FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1")
def pivot_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"))
    return profile.pivot_counts(rows, "o_orderpriority", "y", [1995, 1996]).withColumn("percent", F.round("percent", 6))


@register("grouping_sets_overall", "SELECT c_mktsegment, CAST(grouping(c_mktsegment) AS INTEGER) AS is_overall, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY ROLLUP (c_mktsegment)")
def grouping_sets_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_overall(table(spark, sf_dir, "customer"), "c_mktsegment", [F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")])


@register("audit_raw_mapping", "SELECT event_type, upper(substr(event_type, 1, 1)) AS value, count(*) FILTER (user_id % 2 = 0) AS n_even, count(*) FILTER (user_id % 2 = 1) AS n_odd, count(*) AS total, count(*) <= 5 AS is_rare FROM events GROUP BY 1, 2")
def audit_raw_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.upper(F.substring("event_type", 1, 1)).alias("value"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("g"))
    return profile.audit_mapping(rows, "event_type", "value", "g", ["even", "odd"])


@register("sorted_sets", "SELECT l_suppkey, string_agg(f, ';' ORDER BY f) AS members, count(*) AS n_members FROM (SELECT DISTINCT l_suppkey, l_returnflag AS f FROM lineitem) GROUP BY 1")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sorted_sets(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@register("text_coverage", "SELECT lang, count(*) AS n, round(avg(w), 6) AS mean_words, CAST(sum(w) AS BIGINT) AS total_words FROM (SELECT lang, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_\\p{Pc}]+')) AS w FROM documents) GROUP BY lang")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.text_coverage(table(spark, sf_dir, "documents"), text.word_count(F.col("text")), ["lang"])
    return out.withColumn("mean_words", F.round("mean_words", 6))


@register("latency_projection", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_s, round(stddev_samp(value), 6) AS sd_s, median(value) AS median_s, round(sum(value) / 22 * 1000000, 2) AS projected_s FROM events GROUP BY 1")
def latency_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.latency(table(spark, sf_dir, "events"), ["event_type"], "value", 22, 1_000_000)
    return out.withColumns({"mean_s": F.round("mean_s", 6), "sd_s": F.round("sd_s", 6), "projected_s": F.round("projected_s", 2)})


@register("flag_share", "SELECT count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS n_yes, count(DISTINCT o_custkey) AS n_all, round(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) * 100.0 / count(DISTINCT o_custkey), 6) AS percent FROM orders")
def flag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.flag_share(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F").withColumn("percent", F.round("percent", 6))


@register("log1p_scale", "SELECT round(stddev_samp(ln(1 + greatest(l_extendedprice, 0))), 8) AS scale FROM lineitem")
def log1p_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.spread(table(spark, sf_dir, "lineitem"), "l_extendedprice", skewed=True).select(F.round("scale", 8).alias("scale"))


@register("iqr_scale", "SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS scale FROM lineitem")
def iqr_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quartile_scale(table(spark, sf_dir, "lineitem"), "l_quantity")


@register("tv_distance", "WITH c AS (SELECT l_linenumber AS v, count(*) FILTER (l_returnflag = 'A') * 1.0 / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS x, count(*) FILTER (l_returnflag = 'R') * 1.0 / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS y FROM lineitem GROUP BY 1) SELECT round(sum(abs(x - y)) / 2, 8) AS distance FROM c")
def tv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return profile.total_variation(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), "l_linenumber").select(F.round("distance", 8).alias("distance"))


@register("status_audit", "SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_repeated FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.status_audit(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("doc_id") % 3 > 0).alias("guess"), (F.col("doc_id") % 4 > 1).alias("other"), "quality", (F.col("doc_id") % 101 / 100.0).alias("p"))


@register("confusion_metrics", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND doc_id % 3 > 0) AS tp, count(*) FILTER (quality = 0 AND doc_id % 3 > 0) AS fp, count(*) FILTER (quality = 1 AND doc_id % 3 = 0) AS fn, count(*) FILTER (quality = 0 AND doc_id % 3 = 0) AS tn FROM labels)
 SELECT tp, fp, fn, tn, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 8) AS accuracy, round(tp * 1.0 / (tp + fp), 8) AS precision, round(tp * 1.0 / (tp + fn), 8) AS recall, round(tn * 1.0 / (tn + fp), 8) AS specificity, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1,
 round((tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2, 8) AS balanced_accuracy, round(tn * 1.0 / (tn + fn), 8) AS npv, round((tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS mcc FROM c""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.metrics(stats.confusion(_guesses(spark, sf_dir), F.col("truth"), F.col("guess")))
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in out.columns[4:]))


@register("wilson_interval", """WITH c AS (SELECT toxic, CAST(sum(quality) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY toxic), w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c)
 SELECT toxic, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 8) AS low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 8) AS high FROM w""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("toxic", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@register("ece_brier", """WITH s AS (SELECT quality AS y, doc_id % 101 / 100.0 AS p FROM labels), b AS (SELECT least(floor(p * 10), 9) AS b, abs(sum(y - p)) AS g FROM s GROUP BY 1)
 SELECT (SELECT count(*) FROM s) AS n, (SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) FROM s) AS accuracy, (SELECT round(sum(g) / (SELECT count(*) FROM s), 8) FROM b) AS ece, (SELECT round(avg((p - y) * (p - y)), 8) FROM s) AS brier""")
def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.calibration(_guesses(spark, sf_dir), "quality", "p")
    return out.select("n", *(F.round(c, 8).alias(c) for c in ("accuracy", "ece", "brier")))


@register("mcnemar_cells", "SELECT CAST(CASE WHEN quality = 1 THEN 4 ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 4 > 1 THEN 1 ELSE 0 END AS INTEGER) AS cell, count(*) AS n FROM labels GROUP BY 1")
def mcnemar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_cells(_guesses(spark, sf_dir), F.col("truth"), F.col("guess"), F.col("other"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _guesses(spark, sf_dir).select(F.col("doc_id").alias("item"), F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), F.col(c).cast("int").alias("vote")) for r, c in (("a", "truth"), ("b", "guess"), ("c", "other"))))).alias("v"))
    return rows.select("item", "v.rater", "v.vote")


_VOTES = "WITH v AS (SELECT doc_id AS item, 'a' AS r, CAST(quality = 1 AS INTEGER) AS x FROM labels UNION ALL SELECT doc_id, 'b', CAST(doc_id % 3 > 0 AS INTEGER) FROM labels UNION ALL SELECT doc_id, 'c', CAST(doc_id % 4 > 1 AS INTEGER) FROM labels)"


@register("kappa_pairs", f"""{_VOTES}, s AS (SELECT p.r AS a, q.r AS b, count(*) AS n, sum(CAST(p.x = q.x AS INTEGER)) AS same, sum(p.x) AS xs, sum(q.x) AS ys FROM v p JOIN v q ON p.item = q.item AND p.r < q.r GROUP BY 1, 2),
 k AS (SELECT *, same * 1.0 / n AS o, (xs * 1.0 * ys + (n - xs) * 1.0 * (n - ys)) / (n * n) AS e FROM s) SELECT a, b, n, round((o - e) / (1 - e), 8) AS kappa FROM k""")
def kappa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pair_kappa(_votes(spark, sf_dir), "item", "rater", "vote").withColumn("kappa", F.round("kappa", 8))


@register("fleiss_patterns", f"""{_VOTES}, i AS (SELECT item, CAST(sum(x) AS DOUBLE) AS y, CAST(3 - sum(x) AS DOUBLE) AS o FROM v GROUP BY 1),
 s AS (SELECT count(*) AS items, sum(y) AS yes, count(*) * 3.0 AS votes, avg((y * (y - 1) + o * (o - 1)) / 6) AS ob, sum(y * o) AS split, avg(CASE WHEN y = 0 OR o = 0 THEN 1.0 ELSE 0.0 END) AS una, avg(y / 3) AS q FROM i),
 t AS (SELECT *, yes / votes AS p FROM s)
 SELECT items, round(ob, 8) AS agreement, round((ob - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 8) AS fleiss_kappa, round(1 - split / (2 * yes * (votes - yes) / (votes - 1)), 8) AS alpha, round((ob - 2 * q * (1 - q)) / (1 - 2 * q * (1 - q)), 8) AS gwet_ac1, round(una, 8) AS unanimous FROM t""")
def fleiss_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_item = _votes(spark, sf_dir).groupBy("item").agg(F.sum("vote").alias("yes"), F.sum(1 - F.col("vote")).alias("no"))
    out = stats.agreement(per_item.groupBy("yes", "no").agg(F.count("*").alias("n")))
    return out.select("items", *(F.round(c, 8).alias(c) for c in out.columns[1:]))


@register("cluster_sufficient_stats", "SELECT source, count(*) AS n, CAST(sum(quality) AS DOUBLE) AS good, CAST(sum(toxic) AS DOUBLE) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY source")
def cluster_sufficient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.unit_statistics(rows, "source", {"good": F.col("quality"), "bad": F.col("toxic")})


@register("cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = stats.unit_bootstrap(cluster_sufficient_stats(spark, sf_dir), "good", "n")
    return spark.createDataFrame([(low, high)], "low double, high double")


@register("mean_interval_by_group", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS high FROM events GROUP BY 1")
def mean_interval_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.mean_interval(table(spark, sf_dir, "events"), "value", ["event_type"], z=1.96)
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@register("micro_macro_fields", """WITH c AS (SELECT l_returnflag AS scope, l_linenumber AS g, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS tp, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS fp, count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS fn FROM lineitem GROUP BY 1, 2)
 SELECT scope, count(*) AS groups, round(sum(tp) * 1.0 / sum(tp + fp), 8) AS micro_precision, round(sum(tp) * 1.0 / sum(tp + fn), 8) AS micro_recall, round(avg(tp * 1.0 / (tp + fp)), 8) AS macro_precision, round(avg(tp * 1.0 / (tp + fn)), 8) AS macro_recall FROM c GROUP BY scope""")
def micro_macro_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scope"), F.col("l_linenumber").alias("g"), (F.col("l_discount") > 0.05).alias("t"), (F.col("l_quantity") > 25).alias("y"))
    out = stats.micro_macro(stats.confusion(rows, F.col("t"), F.col("y"), ["scope", "g"]), "g", "scope")
    return out.select("scope", "groups", *(F.round(c, 8).alias(c) for c in out.columns[2:]))


@register("paired_runs", "SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM (SELECT event_type, user_id, max(value) AS v FROM events GROUP BY 1, 2) a JOIN (SELECT event_type, user_id, max(value) AS v FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("v"))
    return joins.paired(runs, "event_type", "user_id", "v").groupBy("a", "b").agg(F.count("*").alias("n"))


@register("scheduled_coverage", "SELECT c_custkey, y, count(o_orderkey) AS n FROM customer CROSS JOIN (VALUES (1995), (1996)) AS r(y) LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = y GROUP BY 1, 2")
def scheduled_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), "o_orderkey")
    every = joins.scheduled(table(spark, sf_dir, "customer").select("c_custkey"), made, spark.createDataFrame([(1995,), (1996,)], "y int"), "c_custkey")
    return every.groupBy("c_custkey", "y").agg(F.count("o_orderkey").alias("n"))


@register("hungarian_per_group")
def hungarian_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    a = orders.filter("l_linenumber <= 3").select("l_orderkey", F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("q"))
    b = orders.filter("l_linenumber > 3").select("l_orderkey", F.col("l_linenumber").alias("y"), F.col("l_quantity").alias("r"))
    scores = a.join(b, "l_orderkey").withColumn("score", 50 - F.abs(F.col("q") - F.col("r")))
    return matching.match_pairs(scores, "l_orderkey", "x", "y", "score", 10.0)


@register("bipartite_matching")
def bipartite_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select("l_orderkey", F.col("l_linenumber").alias("x"), F.explode(F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 3)).alias("y"))
    return matching.match_largest(links, "l_orderkey", "x", "y")
