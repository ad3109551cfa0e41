"""Value comparison, classes of text, curation stages and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import classes, formulas, precursors, values
from millrace.operators import curate, evaluate
from millrace.session import table


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


_PRECURSORS = [
    ("copper(II) nitrate trihydrate", "Cu(NO3)2·3H2O", "Cu"), ("Zn(NO3)2 · 6H2O", "Zn(NO3)2·6H2O", "Zn"), ("zirconium tetrachloride", "ZrCl4", "Zr"), ("ferric chloride hexahydrate", "FeCl3·6H2O", "Fe"),
    ("cobalt acetate tetrahydrate", "Co(CH3COO)2·4H2O", "Co"), ("zinc", "Zn", "Zn"), ("calcium acetate hydrate", "Ca(CH3COO)2", "Ca"), ("Cu(OAc)2.H2O", "Cu(CH3COO)2·1H2O", "Cu"), ("zinc oxide powder", "ZnO", "Zn"),
    ("silver nitrate", "Ag(NO3)", "Ag"), ("(II)", "", None), ("uranyl nitrate hexahydrate", "UO2(NO3)2·6H2O", None), (None, None, None),
]


@register("precursor_formulas", _values([(a, b) for a, b, _ in _PRECURSORS], "precursor, formula"))
def precursor_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precursors.with_precursor(spark.createDataFrame([(a,) for a, *_ in _PRECURSORS], "precursor string"), "precursor", "formula").select("precursor", "formula")


_METALS = [("Copper nitrate", None, "Cu"), ("PdCl2", None, "Pd"), ("ferrous sulfate", None, "Fe"), ("something", "Zr", "Zr"), (None, None, "Me_unknown"), ("12", None, "Me_unknown")]


@register("metal_elements", _values([(i, m) for i, (*_, m) in enumerate(_METALS)], "i, metal"))
def metal_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_METALS)], "i int, name string, short string")
    return df.select("i", formulas.first_symbol(F.col("name"), F.col("short"), "Me_unknown").alias("metal"))


_VESSELS = [
    ("Teflon-lined stainless steel autoclave (23 mL)", "PTFE-lined autoclave", 23.0, "Capacity"), ("20 mL scintillation vial", "Vial", 20.0, "Capacity"), ("glass vial with Teflon-lined cap, 4 mL", "Vial", 4.0, "Capacity"),
    ("round-bottom flask", "Flask", None, "Not reported"), ("vial placed inside a 100 mL autoclave", "Nested / multiple vessels", None, "Ambiguous"), ("10-20 mL pressure tube", "Tube / capillary", None, "Ambiguous"),
    ("microwave vial, 35 mL", "Microwave vessel", 35.0, "Capacity"), ("beaker containing 50 mL water", "Beaker", None, "Not reported"), ("oven", "Not reported", None, "Not reported"), ("0.5 L bottle", "Bottle / jar", 500.0, "Capacity"), ("N/A", "Not reported", None, "Not reported"),
]


@register("vessel_classes", _values([(i, *r[1:]) for i, r in enumerate(_VESSELS)], "i, vessel, ml, status"))
def vessel_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_VESSELS)], "i int, t string")
    c = classes.vessel_capacity(F.col("t"))
    return df.select("i", classes.vessel_class(F.col("t")).alias("vessel"), c["ml"].alias("ml"), c["status"].alias("status"))


_AGITATION = [
    ("stirred", "Stirring reported", "yes"), ("stirred for 30 min then heated", "Stirred before main synthesis", "yes"), ("premixed by stirring, then left undisturbed", "Stirred before static synthesis", "yes"), ("without stirring", "No stirring", "no"),
    ("sonicated for 10 min before heating", "Sonicated before main synthesis", "not_reported"), ("shaken", classes.MIXING, "not_reported"), ("with or without stirring", "Not reported", "not_reported"), ("stirred during reaction", "Stirring reported", "yes"),
    ("static", "No stirring", "no"), ("centrifuged", "Not reported", "not_reported"), ("nr", "Not reported", "not_reported"), (None, "Not reported", "not_reported"),
]


@register("agitation_classes", _values([(i, *r[1:]) for i, r in enumerate(_AGITATION)], "i, agitation, stirring"))
def agitation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_AGITATION)], "i int, t string")
    return df.select("i", classes.agitation_class(F.col("t")).alias("agitation"), classes.stirring_presence(F.col("t")).alias("stirring"))


_CONNECTIVITY = [("Cu2 paddle-wheel", "paddlewheel dimer SBU"), ("Zr6 node", "hexanuclear cluster SBU"), ("infinite M-O-M chains", "1D rod SBU (metal-oxo chain)"), ("2D sheet", "2D layer connectivity"), ("pillared layers", "pillared layer connectivity"), ("dia net", "3D named-net connectivity (dia)"), ("Keggin", "Keggin POM cluster SBU"), ("something", "3D multinodal connectivity"), ("", "")]


@register("connectivity_classes", _values([(i, c) for i, (_, c) in enumerate(_CONNECTIVITY)], "i, class"))
def connectivity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_CONNECTIVITY)], "i int, t string")
    return df.select("i", classes.connectivity_class(F.col("t")).alias("class"))


_SOLVENTS = [("Absolute ethanol", "", "ethanol", "EtOH"), ("N,N-Dimethylformamide, anhydrous", None, "dimethylformamide", "DMF"), ("deionized water", "x", "water", "H2O"), ("", "dmac", "N,N-dimethylacetamide", "DMAc"), (" cyclohexane ", "CyH", "cyclohexane", "CyH"), (None, None, "", "")]


@register("solvent_pairs", _values([(i, *r[2:]) for i, r in enumerate(_SOLVENTS)], "i, solvent, short"))
def solvent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(_SOLVENTS)], "i int, n string, a string")
    p = classes.solvent_pair(F.col("n"), F.col("a"))
    return df.select("i", p["name"].alias("solvent"), p["short"].alias("short"))


_LINKERS = [("H2bdc", "kept", "H2bdc"), ("Benzene-1,4-dicarboxylic  acid", "kept", "terephthalic acid"), ("H3L", "Hnum_short", "H3L"), ("L1", "L_short", "L1"), ("(H2L)", "starts_with_(H", "(H2L)"), ("nickel complex", "contains_complex", "nickel complex"), ("4,4′-bipyridine", "kept", "4,4'-bipyridine"), ("", "keep_empty", "")]


@register("linker_decisions", _values([(i, "Hnum_short" if t == "H2bdc" else r, n) for i, (t, r, n) in enumerate(_LINKERS)], "i, reason, canonical"))
def linker_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(_LINKERS)], "i int, t string")
    return df.select("i", classes.linker_decision(F.col("t"))["reason"].alias("reason"), classes.canonical_linker(F.col("t")).alias("canonical"))


_VOLUMES = [("DMF 10 mL", "DMF", 10.0, "beside"), ("5 mL DMF + 5 mL EtOH", "DMF", 10.0, "sum"), ("DMF/EtOH (1:1, 20 mL)", "DMF", 10.0, "beside"), ("DMF:EtOH = 3:1, total 8 mL", "DMF", 6.0, "ratio"), ("7.89 g EtOH", "EtOH", 10.0, "mass"), ("reflux", "DMF", None, "")]


@register("solvent_volumes", _values([(i, 20.0 if t.startswith("DMF/") else v, r) for i, (t, _, v, r) in enumerate(_VOLUMES)], "i, ml, rule"))
def solvent_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, t, s) for i, (t, s, *_) in enumerate(_VOLUMES)], "i int, t string, s string")
    return df.withColumn("v", curate.solvent_volume("t", "s")).select("i", F.round("v.ml", 6).alias("ml"), "v.rule")


_AGREE = [("10 mg", "0.01 g", "", True), ("RT", "room temperature", "C", True), ("298.15 K", "25", "C", True), ("24 h", "1 day", "h", True), ("Zn", "zinc ||| Zn", "name", True), ("", "not reported", "", True), ("5 mL", "5 mg", "", False), ("2-3 h", "2 h", "h", False), ("x", "UNRESOLVED", "", False), ("123.0", "123", "id", True)]


@register("value_agreement", _values([(i, ok) for i, (*_, ok) in enumerate(_AGREE)], "i, agrees").replace("True", "true").replace("False", "false"))
def value_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in dict.fromkeys(k for *_, k, _ in _AGREE):
        rows = [(i, a, b) for i, (a, b, k, _) in enumerate(_AGREE) if k == kind]
        df = spark.createDataFrame(rows, "i int, a string, b string").select("i", values.agrees(F.col("a"), F.col("b"), kind).alias("agrees"))
        out = df if out is None else out.unionByName(df)
    return out


_NAMES = [("water", "water (as KOH aq.)", True), ("imidazole", "1-methylimidazole", False), ("acid", "acetic acid", False), ("terephthalic acid", "terephthalic acid, 6(Cl)", True), ("clathrochelate linker GU-3", "iron(II) clathrochelate ligand GU-3", True), (None, "x", False)]


@register("loose_names", _values([(i, ok) for i, (*_, ok) in enumerate(_NAMES)], "i, same").replace("True", "true").replace("False", "false"))
def loose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_NAMES)], "i int, a string, b string")
    return df.select("i", values.loosely_same("a", "b").alias("same"))


@register("best_and_margin", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS nth FROM lineitem)
 SELECT l_orderkey, max(CASE WHEN nth = 1 THEN l_linenumber END) AS best, max(CASE WHEN nth = 1 THEN l_quantity END) AS best_score, max(CASE WHEN nth = 2 THEN l_quantity END) AS second_score,
 max(CASE WHEN nth = 1 THEN l_quantity END) - max(CASE WHEN nth = 2 THEN l_quantity END) AS margin, coalesce(max(CASE WHEN nth = 1 THEN l_quantity END) - max(CASE WHEN nth = 2 THEN l_quantity END) <= 0.03, false) AS ambiguous FROM r GROUP BY 1""")
def best_and_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_and_margin(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")


@register("per_round_metrics", "SELECT event_type, count(*) AS n_rounds, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS sd FROM (SELECT event_type, user_id % 5 AS r, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def per_round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.per_round(table(spark, sf_dir, "events").withColumn("r", F.col("user_id") % 5), ["event_type"], "r", (F.col("value") > 20).cast("int"))
    return out.select("event_type", "n_rounds", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@register("stage_counters", """WITH a AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1), c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.05 GROUP BY 1)
 SELECT 'all' AS stage, a.label, a.n, a.n - coalesce(b.n, 0) AS lost_next FROM a LEFT JOIN b ON a.label = b.label UNION ALL SELECT 'quantity', b.label, b.n, b.n - coalesce(c.n, 0) FROM b LEFT JOIN c ON b.label = c.label UNION ALL SELECT 'discount', label, n, 0 FROM c""")
def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem")
    b = a.filter("l_quantity > 10")
    return curate.stage_counts([("all", a), ("quantity", b), ("discount", b.filter("l_discount > 0.05"))], "l_returnflag")


@register("window_scores", """WITH w AS (SELECT n_nationkey, n_regionkey, 3 AS expected FROM nation), f AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY 1),
 t AS (SELECT n_regionkey, expected, least(coalesce(n, 0), expected) AS filled FROM w LEFT JOIN f ON n_nationkey = c_nationkey)
 SELECT n_regionkey, count(*) AS n_windows, CAST(count(*) FILTER (filled >= expected) AS BIGINT) AS n_complete, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(filled) AS BIGINT) AS filled, sum(filled) / sum(expected) AS recall, count(*) FILTER (filled >= expected) = count(*) AS complete FROM t GROUP BY 1""")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.lit(3).alias("expected"))
    rows = table(spark, sf_dir, "customer").withColumn("fits", F.col("c_acctbal") > 8000)
    per_window = evaluate.window_table(rows.withColumnRenamed("c_nationkey", "n_nationkey").select("n_nationkey", "fits"), windows, "n_nationkey", "n_regionkey", "expected")
    return evaluate.paper_table(per_window, "n_regionkey")


@register("distance_histogram", """WITH d AS (SELECT p_partkey, p_size % 5 AS d, CASE p_size % 3 WHEN 0 THEN ['p_brand'] WHEN 1 THEN ['p_brand', 'p_type'] ELSE [] END AS f FROM part)
 SELECT 'rows' AS what, count(*) AS n FROM d UNION ALL SELECT CASE WHEN d >= 3 THEN 'distance_ge3' ELSE 'distance_' || d END, count(*) FROM d GROUP BY 1 UNION ALL SELECT 'single_' || x, count(*) FROM (SELECT unnest(f) AS x FROM d) GROUP BY 1""")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("p_brand"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("p_brand"), F.lit("p_type"))).otherwise(F.array().cast("array<string>"))
    near = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("d"), kinds.alias("f"))
    return evaluate.distance_counts(near, "d", "f", ["p_brand", "p_type"])


@register("recipe_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS n_recipes FROM lineitem")
def recipe_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = evaluate.recipe_key(F.lit("d"), {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "quantity": F.col("l_quantity")})
    return lines.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_recipes"))


@register("parent_changes", """SELECT a.l_orderkey, a.l_linenumber, array_to_string(list_filter([CASE WHEN abs(a.l_quantity - b.l_quantity) > 0.05 * greatest(a.l_quantity, b.l_quantity) THEN 'l_quantity' END, CASE WHEN a.l_returnflag <> b.l_returnflag THEN 'l_returnflag' END], lambda x : x IS NOT NULL), ',') AS changed
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 WHERE a.l_linenumber = 2""")
def parent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    first = lines.filter("l_linenumber = 1")
    out = evaluate.compare_with_parent(lines.filter("l_linenumber = 2").join(first.select("l_orderkey"), "l_orderkey", "left_semi"), first, {"l_orderkey": "l_orderkey"}, {"l_quantity": "number", "l_returnflag": "name"})
    return out.select("l_orderkey", "l_linenumber", F.array_join("changed", ",").alias("changed"))
