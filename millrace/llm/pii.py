"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of what gives them away.

Emails, addresses of machines, card and phone numbers are found by pattern and check. Their values are the
protected entities. A term is a run of letters outside the entities. Over the corpus, P(e|t) is the share of the
documents with term t that also hold entity e, and P(e) the share of all documents with e. The disclosure of e by t
is their pointwise mutual information over the information of e: 1 + log P(e|t) / -log P(e), which is 1 if the term
always comes with the entity and 0 if they are independent. Terms with at least `SUPPORT` documents with the entity
and a disclosure of at least `DISCLOSURE` of some entity are spans of kind term wherever they stand, in documents
without the entity too, and are generalised in the text.

Only what cannot reach the bounds is left out early: entities and terms of fewer than `SUPPORT` documents, and pairs
whose term has more documents than a disclosure of `DISCLOSURE` allows, even if it came with the entity in all of
the entity's.

SQL functions only. Counts cover all documents: a document's distinct words are added up by term before they are
dealt out. Positions are code points, ends exclusive. Null texts count as empty and have no spans; an empty table gives
an empty result; very long texts are read whole. Spans that start alike are ordered by kind. Rows that repeat both id
and text are one document and get one result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, small, table

SUPPORT = 2
DISCLOSURE = 0.9
KINDS = ("email", "ip", "card", "phone", "term")
# Possessive runs and starts only where a run begins, or where the last match ended: the same matches as the plain
# patterns give, without their quadratic search and without deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_TERM = r"(?<![\p{L}\p{N}])\p{L}++(?![\p{N}])"
_SPAN = "array<struct<start:int,end:int,value:string>>"
_PLACES = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, pattern: str) -> Column:
    """Spans of all matches: the lengths of what splitting leaves and of the matches themselves add up to places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.aggregate(pairs, start, add, lambda s: s["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the checksum; others than digits must be gone."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(value, F.length(value) - k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, twice(d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str) -> Column:
    """Function of a span: whether its value passes the kind's check."""
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)
        return lambda s: F.forall(F.split(s["value"], r"\."), small)
    if kind == "card":
        return lambda s: F.when(F.length(digits(s["value"])).between(14, 19), luhn(digits(s["value"]))).otherwise(False)
    if kind == "phone":
        return lambda s: F.length(digits(s["value"])).between(10, 15)
    return lambda s: F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (its place among KINDS), end, value>>, sorted."""
    def tagged(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    parts = []
    for k, kind in enumerate(KINDS[:4]):
        spans = F.when(text.rlike(WORTH[kind]), F.filter(found(text, PATTERNS[kind]), _holds(kind))).otherwise(F.array().cast(_SPAN))
        parts.append(tagged(spans, k))
    return F.array_sort(F.concat(*parts))


def entity(span: Column) -> Column:
    """What makes two spans one entity: kind, and the value in lower case or as digits."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] >= 2, digits(span["value"])).otherwise(F.lower(span["value"])))


def masked(text: Column, base: Column) -> Column:
    """The text with 0 for the letters of its base spans: what is left of terms there is no term."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        own = F.substring(text, F.greatest(state["at"], span["start"]) + 1, span["end"] - F.greatest(state["at"], span["start"]))
        hidden = F.concat(state["out"], F.array(gap, F.regexp_replace(own, r"\p{L}", "0")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(span["end"] > state["at"], hidden).otherwise(state["out"]).alias("out"))

    return F.aggregate(base, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def terms_of(text: Column) -> Column:
    """Distinct terms in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def places(text: Column, wanted: Column) -> Column:
    """array<struct<start, kind, end>> of the terms that are wanted; only these are put into the array."""
    gaps, hits = F.split(text, _TERM, -1), F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        one = F.struct(begin.alias("start"), F.lit(4).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.array_contains(wanted, F.lower(pair["hit"])), F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.aggregate(pairs, start, add, lambda s: s["out"])


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, base, spans): base and all spans as sorted arrays of (start, kind, end), for every row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    with_base = rows.withColumn("base", base_spans(F.col("text")))
    slim = with_base.select(
        "doc_id", "h", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"),
        F.array_distinct(F.transform("base", entity)).alias("entities"), F.when(F.size("base") > 0, masked(F.col("text"), F.col("base"))).alias("rest"),
    )
    slim = materialise(slim, "personal")
    with_one = slim.filter("rest IS NOT NULL").dropDuplicates(["doc_id", "h"])
    n = slim.select("doc_id", "h").distinct().count()
    held = with_one.select("doc_id", "h", F.explode("entities").alias("entity"))
    n_e = materialise(held.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n)), "entities")
    # n_t <= n_te / P(e)^(1 - DISCLOSURE), and n_te <= n_e
    least = F.pow(F.col("n_e") / F.lit(float(max(n, 1))), F.lit(1 - DISCLOSURE))
    bounded = held.join(small(n_e), "entity").withColumn("most", F.col("n_e") / least * (1 + 1e-9))
    bounded = materialise(bounded, "held")
    ids = bounded.groupBy("doc_id", "h").agg(F.max("most").alias("most"))
    said = with_one.select(F.col("doc_id").alias("id"), F.col("h").alias("h2"), "rest").join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2")))
    said = materialise(said.select("id", "h2", "most", F.explode(terms_of(F.col("rest"))).alias("term")), "said")
    wanted = said.groupBy("term").agg(F.count("*").alias("k")).filter(F.col("k") >= SUPPORT).select("term")
    terms = rows.dropDuplicates(["doc_id", "h"]) if slim.count() > n else rows
    terms = terms.select("doc_id", "h", F.explode(terms_of(F.col("text"))).alias("term"))
    n_t = materialise(terms.join(small(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    rare = said.join(n_t, "term").filter(F.col("n_t") <= F.col("most")).select("id", "h2", "term", "n_t")
    both = bounded.join(rare, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2")) & (F.col("n_t") <= F.col("most")))
    together = both.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e")).filter(F.col("n_te") >= SUPPORT)
    information = -F.log(F.col("n_e") / F.lit(float(max(n, 1))))
    disclosure = 1 + F.log(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))) / information
    telling = materialise(together.filter(disclosure >= DISCLOSURE).select("term").distinct(), "telling")
    holding = terms.join(small(telling), "term", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("term").alias("wanted"))
    holding = materialise(holding.withColumnsRenamed({"doc_id": "id", "h": "h2"}), "holding")
    texts = rows.dropDuplicates(["doc_id", "h"]) if slim.count() > n else rows
    added = texts.join(small(holding), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2"))).select("id", "h2", places(F.col("text"), F.col("wanted")).alias("added"))
    joined = slim.select("doc_id", "h", "base").join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2")), "left")
    apart = F.filter("added", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    out = joined.select("doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce(apart, F.array().cast(_PLACES)))).alias("spans"))
    out = materialise(out, "spans")
    discard(slim, n_e, bounded, said, n_t, telling, holding)
    return out


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): identifiers and telling terms stand as [email], [ip], [card], [phone] and [term]."""
    spans = find_personal(docs, doc_id, text).dropDuplicates(["doc_id", "h"]).withColumnsRenamed({"doc_id": "id", "h": "h2"})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("h2")), "left")
    named = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        more = F.array(gap, F.get(named, span["kind"]))
        # a span that begins within the last one adds nothing but its end
        late = span["start"] < state["at"]
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(late, state["out"]).otherwise(F.concat(state["out"], more)).alias("out"))

    clean = F.aggregate("spans", start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return joined.select("doc_id", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
