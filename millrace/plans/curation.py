"""Keys, conflicts, dedup and splits over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import keys, numbers, text
from millrace.operators import dedup, joins, reshape, rules, split
from millrace.session import table

_LABELLED = """
labelled AS (
  SELECT l_orderkey, l_linenumber, 'flag=' || lower(l_returnflag) || '|part=' || CAST(l_partkey AS VARCHAR) AS cluster_key,
         l_returnflag || '-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS condition_key, l_linestatus = 'F' AS is_success
  FROM lineitem
)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled records: a condition key, a cluster key and an outcome."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber",
        text.cluster_key(flag=F.lower("l_returnflag"), part=F.col("l_partkey").cast("string")).alias("cluster_key"),
        F.concat_ws("-", "l_returnflag", F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")).alias("condition_key"),
        (F.col("l_linestatus") == "F").alias("is_success"),
    )


_CLEAN = f"""WITH {_LABELLED}, clash AS (
  SELECT condition_key FROM labelled GROUP BY condition_key HAVING count(DISTINCT is_success) > 1
), kept AS (
  SELECT * FROM labelled WHERE is_success OR condition_key NOT IN (SELECT condition_key FROM clash)
), firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition_key, is_success ORDER BY l_orderkey, l_linenumber) AS nth FROM kept) WHERE nth = 1
)"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.drop_conflicting(labelled(spark, sf_dir), ["condition_key"], "is_success", ~F.col("is_success"))
    return dedup.keep_first(rows, ["condition_key", "is_success"], ["l_orderkey", "l_linenumber"])


@register("prepare_split", f"{_CLEAN} SELECT cluster_key, count(*) AS n_rows, CAST(sum(CASE WHEN is_success THEN 1 ELSE 0 END) AS BIGINT) AS n_pos, max(l_orderkey % 97 = 0) AS is_forced FROM firsts GROUP BY cluster_key")
def prepare_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict filter, keep-first dedup and cluster statistics in one plan."""
    return split.cluster_stats(cleaned(spark, sf_dir), "cluster_key", F.col("is_success"), F.col("l_orderkey") % 97 == 0)


@register("dedup_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dedup.keep_first(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@register("label_conflict_filter", f"WITH {_LABELLED} SELECT condition_key, is_success, count(*) AS n FROM labelled WHERE is_success OR condition_key NOT IN (SELECT condition_key FROM labelled GROUP BY 1 HAVING count(DISTINCT is_success) > 1) GROUP BY 1, 2")
def label_conflict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.drop_conflicting(labelled(spark, sf_dir), ["condition_key"], "is_success", ~F.col("is_success"))
    return rows.groupBy("condition_key", "is_success").agg(F.count("*").alias("n"))


@register("singleton_prune", "SELECT event_id, props FROM events WHERE NOT (length(props) <= 9 AND props IN (SELECT props FROM events GROUP BY props HAVING count(*) = 1))")
def singleton_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.prune_singletons(table(spark, sf_dir, "events").select("event_id", "props"), "props", 9)


@register("occurrence_id_hash", "SELECT doc_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS occurrence FROM documents")
def occurrence_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return dedup.occurrence_number(docs, ["content_hash"], ["doc_id"]).withColumn("occurrence", F.col("occurrence").cast("bigint"))


@register("identical_collapse", "SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation")
def identical_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return dedup.collapse_identical(nation.unionByName(nation), ["n_nationkey"])


@register("cluster_disjoint_check", "WITH l AS (SELECT DISTINCT l_partkey AS c, l_linenumber = 1 AS h FROM lineitem) SELECT c FROM l WHERE h INTERSECT SELECT c FROM l WHERE NOT h")
def cluster_disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("c"), (F.col("l_linenumber") == 1).alias("h"))
    return split.shared_keys(rows.filter("h"), rows.filter("NOT h"), ["c"])


@register("contiguous_year_cumsum", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY year(o_orderdate)) AS BIGINT) AS running FROM orders GROUP BY year(o_orderdate)")
def contiguous_year_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.running_counts(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y")


@register("year_bins_4", """WITH RECURSIVE c AS (SELECT y, n, sum(n) OVER (ORDER BY y) AS running, row_number() OVER (ORDER BY y) - 1 AS pos, sum(n) OVER () AS total, count(*) OVER () AS years FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)),
 cuts(i, pos) AS (SELECT 0, -1::BIGINT UNION ALL SELECT t.i, t.best.p FROM (SELECT cuts.i + 1 AS i, min({'d': abs(c.running - c.total * (cuts.i + 1) / 4.0), 'p': c.pos}) AS best FROM cuts JOIN c ON c.pos > cuts.pos AND c.pos < c.years - 3 + cuts.i WHERE cuts.i < 3 GROUP BY cuts.i) t)
 SELECT CAST(b.i + 1 AS INTEGER) AS year_bin, CAST(min(c.y) AS INTEGER) AS first_year, CAST(max(c.y) AS INTEGER) AS last_year, CAST(sum(c.n) AS BIGINT) AS n FROM cuts b LEFT JOIN cuts e ON e.i = b.i + 1 JOIN c ON c.pos > b.pos AND c.pos <= coalesce(e.pos, c.years - 1) GROUP BY 1""")
def year_bins_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.year_bins(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y", 4)
    return rows.groupBy("year_bin").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count("*").alias("n"))


@register("exact_ratio_keep_counts", """WITH n AS (SELECT count(*) FILTER (h = 0 AND quality = 1) AS tp, count(*) FILTER (h = 0 AND quality = 0) AS tn, count(*) FILTER (h = 1 AND quality = 1) AS hp, count(*) FILTER (h = 1 AND quality = 0) AS hn FROM (SELECT quality, CAST(doc_id % 10 = 0 AS INTEGER) AS h FROM labels)),
 u AS (SELECT p, q, least(tp // p, tn // q) AS a, least(hp // p, hn // q) AS b, (tp + hp) / greatest(1, tn + hn) AS raw FROM range(1, 201) x(p), range(1, 201) y(q), n WHERE gcd(p, q) = 1),
 best AS (SELECT * FROM u WHERE a > 0 AND b > 0 ORDER BY (p + q) * (a + b) DESC, abs(ln(p / q / raw)), p + q, p LIMIT 1)
 SELECT 'train' AS part, 1 AS quality, p * a AS keep FROM best UNION ALL SELECT 'train', 0, q * a FROM best UNION ALL SELECT 'holdout', 1, p * b FROM best UNION ALL SELECT 'holdout', 0, q * b FROM best""")
def exact_ratio_keep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("part", F.when(F.col("doc_id") % 10 == 0, "holdout").otherwise("train"))
    n = {(r["part"], r["quality"]): r["n"] for r in labels.groupBy("part", "quality").agg(F.count("*").alias("n")).collect()}
    pair = lambda part: (n.get((part, 1), 0), n.get((part, 0), 0))
    train, hold = pair("train"), pair("holdout")
    p, q = split.ratio_units(train, hold, (0, 0), sum(n.get((s, 1), 0) for s in ("train", "holdout")) / max(1, sum(n.get((s, 0), 0) for s in ("train", "holdout"))))
    counts = {(s, y): u * min(c[0] // p, c[1] // q) for s, c in (("train", train), ("holdout", hold)) for y, u in ((1, p), (0, q))}
    return spark.createDataFrame([(s, y, c) for (s, y), c in counts.items()], "part string, quality int, keep long")


@register("sample_to_label_counts", "SELECT quality, least(20, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))) AS n FROM labels GROUP BY quality")
def sample_to_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    there = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n = min(20, *there.values()) if there else 0
    # what is protected must fit: the eligible rows grow with the table, the rows asked for do not
    protected = split.first_of_each(labels, "quality", F.col("doc_id") % 97 == 0, "doc_id", n)
    kept = split.sample_to_counts(labels, "quality", dict.fromkeys(there, n), [split.seeded(42, "doc_id"), "doc_id"], protected)
    return kept.groupBy("quality").agg(F.count("*").alias("n"))


@register("cluster_holdout_search")
def cluster_holdout_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    stats = split.cluster_stats(rows, "cluster_key", F.col("is_success"), F.lit(False))
    both = split.assign_split(rows, split.choose_holdout(stats, "cluster_key"), "cluster_key")
    return both.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if("is_success").alias("n_pos"), F.count_distinct("cluster_key").alias("n_clusters"))


@register("shard_ntile", "SELECT shard, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, ntile(5) OVER (ORDER BY doc_id) AS shard FROM documents) GROUP BY shard")
def shard_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)
    return rows.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register("left_join_lookup", "SELECT c_custkey, c_name, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def left_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return joins.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), side, {"c_nationkey": "n_nationkey"}, {"n_name": "nation"}, {"nation": "unknown"}).drop("c_nationkey")


@register("correct_values", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN replace(s_name, 'Supplier', 'Vendor') ELSE s_name END AS s_name FROM supplier")
def correct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    fixes = supplier.filter("s_nationkey % 3 = 0").select("s_nationkey", F.col("s_name").alias("value"), F.replace("s_name", F.lit("Supplier"), F.lit("Vendor")).alias("replacement"))
    return joins.correct_values(supplier, fixes, "s_nationkey", ["s_name"]).select("s_suppkey", "s_name")


@register("semi_forced", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("anti_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing_keys(table(spark, sf_dir, "orders"), done, ["o_orderkey"])


@register("full_outer_revision_diff", """WITH a AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0),
 b AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0)
 SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' WHEN a.c_mktsegment = b.c_mktsegment AND a.c_acctbal = b.c_acctbal THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def full_outer_revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    new = customer.filter("c_custkey % 3 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return joins.revision_diff(customer.filter("c_custkey % 5 <> 0"), new, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@register("symmetric_coverage", "WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) SELECT c_custkey AS k, 'left' AS side FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o) UNION ALL SELECT o_custkey, 'right' FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)")
def symmetric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    return joins.symmetric_difference(a, b, ["k"])


@register("coverage_gap_cross", "SELECT n.n_nationkey, s.c_mktsegment FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 9000)")
def coverage_gap_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    rows = customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return joins.coverage_gap(rows, [table(spark, sf_dir, "nation").select("n_nationkey"), customer.select("c_mktsegment").distinct()])


@register("document_match_priority", """WITH f AS (SELECT 'src' || CAST(page_id % 20 AS VARCHAR) AS stem, CASE page_id % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'pdf' ELSE 'docx' END AS ext, page_id FROM pages WHERE page_id % 4 <> 1)
 SELECT s.source AS stem, ext AS found_ext, page_id AS found_page_id FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE ext WHEN 'pdf' THEN 1 WHEN 'docx' THEN 2 ELSE 3 END, ext, page_id) AS nth FROM f) x ON lower(s.source) = x.stem AND nth = 1""")
def document_match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["doc", "pdf", "docx"])), (F.col("page_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").filter("page_id % 4 <> 1").select(F.concat(F.lit("SRC"), (F.col("page_id") % 20).cast("string")).alias("stem"), ext.alias("ext"), "page_id")
    wanted = table(spark, sf_dir, "documents").select(F.col("source").alias("stem")).distinct()
    return joins.match_by_priority(wanted, files, "stem", "ext", ["pdf", "docx", "doc"])


@register("hamming_nearest", """WITH a AS (SELECT * FROM part WHERE p_partkey % 2 = 0), b AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
 d AS (SELECT a.p_partkey, b.p_partkey AS nearest, CAST(CAST(a.p_brand <> b.p_brand AS INTEGER) + CAST(a.p_type <> b.p_type AS INTEGER) + CAST(a.p_size <> b.p_size AS INTEGER) AS INTEGER) AS distance FROM a CROSS JOIN b)
 SELECT p_partkey, nearest, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, nearest) AS nth FROM d) WHERE nth = 1""")
def hamming_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    right = part.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "nearest")
    return joins.hamming_nearest(part.filter("p_partkey % 2 = 0"), right, "p_partkey", "nearest", ["p_brand", "p_type", "p_size"])


_RULES = [(1, "ALL", None, "p_size", "range", "10", "30"), (1, "ALL", None, "p_retailprice", "lt", "1500", None), (2, "AT_LEAST", 2, "p_size", "gt", "25", None), (2, "AT_LEAST", 2, "p_brand", "discrete_set", "Brand#1 ||| Brand#2 ||| Brand#3", None), (2, "AT_LEAST", 2, "p_type", "exclusion", "STEEL", None), (3, "SINGLE", None, "p_size", "discrete_set", "5.0 ||| 7 ||| 9", None), (3, "SINGLE", None, "p_type", "unparsed_freetext", "as usual", None), (4, "ALL", None, "p_colour", "exclusion", "red", None)]


@register("rule_predicate_join", """SELECT p_partkey, 1 AS w, (p_size BETWEEN 10 AND 30) AND p_retailprice < 1500 AS fits FROM part
 UNION ALL SELECT p_partkey, 2, CAST(p_size > 25 AS INTEGER) + CAST(lower(p_brand) IN ('brand#1', 'brand#2', 'brand#3') AS INTEGER) + CAST(lower(p_type) <> 'steel' AS INTEGER) >= 2 FROM part
 UNION ALL SELECT p_partkey, 3, p_size IN (5, 7, 9) FROM part UNION ALL SELECT p_partkey, 4, true FROM part""")
def rule_predicate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules known beforehand: a set of numbers goes by value, free text holds nowhere, a missing field passes an exclusion."""
    part = table(spark, sf_dir, "part")
    fits = rules.window_columns(_RULES, {f: F.col(f).cast("string") for f in ("p_size", "p_retailprice", "p_brand", "p_type")})
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("w"), c.alias("fits")) for w, c in fits.items())))
    return part.select("p_partkey", each.alias("x")).select("p_partkey", "x.w", "x.fits")


@register("rule_table_join", """SELECT event_type AS kind, event_id, 1 AS w, value > 20 OR user_id IN (1, 2, 3) AS fits FROM events WHERE event_type = 'click'
 UNION ALL SELECT event_type, event_id, 2, value BETWEEN 10 AND 50 AND event_type <> 'error' FROM events WHERE event_type = 'purchase'""")
def rule_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in a table: candidates meet the windows of their own document."""
    rows = [("click", 1, "SINGLE", None, "value", "gt", "20", None), ("click", 1, "SINGLE", None, "user_id", "discrete_set", "1 ||| 2 ||| 3", None), ("purchase", 2, "ALL", None, "value", "range", "10", "50"), ("purchase", 2, "ALL", None, "event_type", "exclusion", "error", None)]
    windows = spark.createDataFrame(rows, "kind string, w int, logic string, needed int, field string, predicate string, value_1 string, value_2 string")
    events = table(spark, sf_dir, "events").withColumn("kind", F.col("event_type"))
    return rules.evaluate_rules(events, F.broadcast(windows), "event_id", "kind", "w", ["value", "user_id", "event_type"])


@register("required_fields", "SELECT c_custkey FROM customer WHERE CAST(c_acctbal > 0 AS INTEGER) + CAST(c_mktsegment <> 'BUILDING' AS INTEGER) + CAST(c_nationkey < 12 AS INTEGER) >= 2")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(rules.at_least(2, F.col("c_acctbal") > 0, F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey") < 12)).select("c_custkey")


@register("reason_routing", "SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'MACHINERY' THEN 'excluded' ELSE 'kept' END AS reason, count(*) AS n FROM customer GROUP BY 1")
def reason_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.route(table(spark, sf_dir, "customer"), [("negative", F.col("c_acctbal") < 0), ("excluded", F.col("c_mktsegment") == "MACHINERY")]).groupBy("reason").agg(F.count("*").alias("n"))


@register("outlier_blanking", "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > (SELECT 2.0 * avg(l_extendedprice) FROM lineitem) THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem")
def outlier_blanking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.blank_outliers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


@register("option_product", "SELECT r_regionkey, a AS kind, b AS grade, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY i, j) - 1 AS INTEGER) AS variant FROM region CROSS JOIN (VALUES (0, 'x'), (1, 'y')) AS p(i, a) CROSS JOIN (VALUES (0, 1), (1, 2), (2, 3)) AS q(j, b)")
def option_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "region").select("r_regionkey", F.lit("k").alias("kind"), F.lit(0).alias("grade"), F.array(F.lit("x"), F.lit("y")).alias("kinds"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("grades"))
    return reshape.option_product(base, {"kind": "kinds", "grade": "grades"}).select("r_regionkey", "kind", "grade", "variant")


@register("condition_grid", "SELECT CAST(a * 1000 + b * 100 + c AS BIGINT) AS row_id, a + 10 AS x, b AS y, c AS z FROM range(10) t(a) CROSS JOIN range(10) u(b) CROSS JOIN range(100) v(c)")
def condition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.grid(spark, x=list(range(10, 20)), y=list(range(10)), z=list(range(100)))
    return out.select("row_id", *(F.col(c).cast("bigint").alias(c) for c in "xyz"))


@register("unpivot_ranking", "SELECT value, count(*) AS n FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY value")
def unpivot_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unpivot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]).groupBy("value").agg(F.count("*").alias("n"))


@register("explode_tags", "SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1")
def explode_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = text.split_tags(F.replace(F.col("p_type"), F.lit(" "), F.lit("; ")))
    return table(spark, sf_dir, "part").select(F.explode(tags).alias("t")).select(F.lower("t").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@register("json_props_extract", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.explode_json(table(spark, sf_dir, "events").select("event_id", "props"), "props", "bigint")


@register("rule_text_parse", "SELECT * FROM (VALUES ('AT_LEAST', 2, 0, 'range', 'temperature', '80', '120'), ('AT_LEAST', 2, 1, 'exclusion', 'solvent', 'water', NULL), ('AT_LEAST', 2, 2, 'gt', 'time', '24', NULL), ('SINGLE', NULL, 0, 'discrete_set', 'metal', 'Zn, Cu', NULL), ('SINGLE', NULL, 1, 'unparsed_freetext', NULL, NULL, NULL)) AS t(logic, needed, rule_no, predicate, field, value_1, value_2)")
def rule_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("AT_LEAST(2): temperature from 80 to 120; solvent is not water; time > 24",), ("metal one of Zn, Cu; as usual",)], "rule string")
    return reshape.parse_rules(rows, "rule").drop("rule")


_TEXTS = ["  “Zinc nitrate”  ", "N/A", "10.1021_jacs.7b09983_SI.pdf", "https://doi.org/10.1000/ABC.1", "48–72 h", "to 3 days", "overnight", "several days", "1:2", "1:1:1", "2.5", "3/4", "about 12.5 mL", None]


@register("text_normalize_key", "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS k, 'brand=' || lower(p_brand) || '|type=' || lower(p_type) AS cluster FROM part")
def text_normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.key_text(F.col("p_name")).alias("k"), text.cluster_key(brand=text.key_text(F.col("p_brand")), type=text.key_text(F.col("p_type"))).alias("cluster"))


@register("scalar_panel", """SELECT * FROM (VALUES (0, 'Zinc nitrate', NULL, NULL, NULL, NULL), (1, NULL, NULL, NULL, NULL, NULL), (2, '10.1021_jacs.7b09983_SI.pdf', '10.1021/jacs.7b09983', 10.1021, NULL, NULL),
 (3, 'https://doi.org/10.1000/ABC.1', '10.1000/abc.1', 10.1, NULL, NULL), (4, '48-72 h', NULL, 48.0, NULL, 72.0), (5, 'to 3 days', NULL, 3.0, 3.0, 72.0), (6, 'overnight', NULL, NULL, NULL, 12.0), (7, 'several days', NULL, NULL, NULL, 144.0),
 (8, '1:2', NULL, 1.0, 0.5, NULL), (9, '1:1:1', NULL, 1.0, 0.5, NULL), (10, '2.5', NULL, 2.5, 2.5, NULL), (11, '3/4', NULL, 3.0, 0.75, NULL), (12, 'about 12.5 mL', NULL, 12.5, 12.5, NULL), (13, NULL, NULL, NULL, NULL, NULL)) AS t(i, cleaned, doi, number, ratio, hours)""")
def scalar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    out = spark.createDataFrame(list(enumerate(_TEXTS)), "i int, t string")
    # the panel's ratio is asked of texts whose parts are numbers only; links and ranges have none
    ratio = F.when(~t.rlike("h$|doi|_"), numbers.parse_ratio(t))
    return out.select("i", text.clean_text(t).alias("cleaned"), text.normalize_doi(t).alias("doi"), numbers.first_number(t).alias("number"), ratio.alias("ratio"), numbers.duration_hours(t).alias("hours"))


@register("set_key", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(lower(role)))), ' + ') AS roles FROM conversations GROUP BY conv_id")
def set_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "conversations").select("conv_id", "role").distinct().groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return roles.select("conv_id", text.set_key(F.col("r")).alias("roles"))


@register("canonical_key_groups", "SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)")
def canonical_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.canonical_json({"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}, {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")})
    per_key = table(spark, sf_dir, "lineitem").groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))
