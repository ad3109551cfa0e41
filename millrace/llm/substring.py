"""Substring dedup by sliding spans of sentences.

A text is cut into sentences that tile it. Sentences with letters or digits are compared in lower case with
everything else as one space. Every run of `RUN` such sentences with at least `MIN_WORDS` words is hashed (two
independent 64-bit hashes); a run that occurs more than once in all documents keeps its first place, by doc_id
(null first), text and position, and all sentences of its other places go.

Sentences end at . ! ? and their full-width forms and at line breaks; one without an end for `CLAUSE` + 80 characters is
cut at the next clause mark or blank after `CLAUSE`, so a long sentence that comes again is a run of its parts.

Only hashes are dealt out; the count of a hash that many rows share is added up before it is dealt, and the join
back is one that Spark splits where it is uneven. Null texts stay null. Rows that repeat both id and text are one
document and get one result. Texts with fewer sentences than a run, and empty ones, stay; very long texts are cut
whole; an empty table gives an empty result. Places cannot tie. Columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, table

RUN = 2
#: A run needs this many words, or this many characters in scripts that do not part words.
MIN_WORDS, MIN_CHARS = 12, 72
#: Tiles any text: what stands before a sentence end, the end itself and the white space after it. What has more than
#: CLAUSE + 80 characters without an end is cut at the next clause mark or blank after CLAUSE, so that long sentences
#: are runs too.
CLAUSE = 160
#: Full-width ends are read as plain ones: Java matches classes of other than ASCII characters many times slower.
WIDE, PLAIN = "。！？", "..."
_ENDS = r".!?\n"
SENTENCE = rf"[^{_ENDS}]{{0,{CLAUSE + 80}}}[{_ENDS}]+[ \t\r\n]*|[^{_ENDS}]{{{CLAUSE}}}[^{_ENDS},;:，；： ]{{0,80}}[,;:，；： ]+|[^{_ENDS}]{{1,{CLAUSE + 80}}}"
NOT_WORD = r"[^\p{L}\p{N}]+"


def sentences(text: Column) -> Column:
    """array<struct<at, norm>>: the sentences that hold letters or digits, with their places among all tiles."""
    norm = lambda s, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " ")).alias("norm"))
    return F.filter(F.transform(F.regexp_extract_all(F.translate(text, WIDE, PLAIN), F.lit(SENTENCE), F.lit(0)), norm), lambda s: s["norm"] != "")


_TILES, _WIDE = re.compile(SENTENCE), str.maketrans(WIDE, PLAIN)


def tiles_of(text: str) -> list[str]:
    """The tiles of a text as they stand there."""
    return [text[m.start() : m.end()] for m in _TILES.finditer(text.translate(_WIDE))]


def spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, at, tiles, h1, h2): every run that is long enough."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), sentences(F.col("text")).alias("s")).filter(F.size("s") >= run)

    def span(i: Column) -> Column:
        part = F.slice("s", i + 1, run)
        norms = part["norm"]
        return F.struct(
            i.alias("at"),
            part["at"].alias("tiles"),
            F.xxhash64(norms).alias("h1"),
            F.xxhash64(F.lit(7), norms).alias("h2"),
            F.aggregate(norms, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"),
            F.aggregate(norms, F.lit(0), lambda n, x: n + F.length(x)).alias("chars"),
        )

    made = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - run), span), lambda x: (x["words"] >= min_words) | (x["chars"] >= MIN_CHARS))
    return rows.select("id", "h", F.explode(made).alias("x")).select("id", "h", "x.at", "x.tiles", "x.h1", "x.h2")


def repeated(all_spans: DataFrame) -> DataFrame:
    """(id, h, tiles): the tiles of each document that a non-first repeated run covers."""
    place = F.struct("id", "h", "at")
    firsts = all_spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("h1", "h2", "first")
    later = all_spans.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.select("id", "h", F.explode("tiles").alias("tile")).groupBy("id", "h").agg(F.collect_set("tile").alias("tiles"))


def remove_repeated(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_removed): each row of docs without the sentences that repeat."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = materialise(spans(slim, run, min_words), "spans")
    covered = materialise(repeated(found), "covered")
    discard(found)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("tiles").to_pylist(), strict=True):
                out = set(gone or ())
                texts.append("".join(x for i, x in enumerate(tiles_of(t)) if i not in out) if out else t)
                counts.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_removed"])

    keyed = slim.withColumn("h", F.xxhash64("text"))
    joined = keyed.join(covered, keyed["doc_id"].eqNullSafe(covered["id"]) & (keyed["h"] == covered["h"]), "left").select("doc_id", "text", "tiles")
    return joined.mapInArrow(cut, f"doc_id {dict(slim.dtypes)['doc_id']}, text string, n_removed bigint")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH tiles AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, '{WIDE}', '{PLAIN}'), '{SENTENCE}') AS t FROM documents
), norms AS (
  SELECT doc_id, text, list_filter([{{'at': i, 'norm': trim(regexp_replace(lower(t[i]), '{NOT_WORD}', ' ', 'g'))}} FOR i IN range(1, len(t) + 1)], lambda s : s.norm <> '') AS s FROM tiles
), runs AS (
  SELECT doc_id, i, [s[i].at, s[i + 1].at] AS covered, s[i].norm || chr(10) || s[i + 1].norm AS run,
         len(string_split(s[i].norm, ' ')) + len(string_split(s[i + 1].norm, ' ')) AS words, length(s[i].norm) + length(s[i + 1].norm) AS chars
  FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM norms)
), later AS (
  SELECT doc_id, covered FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM runs WHERE words >= {MIN_WORDS} OR chars >= {MIN_CHARS}) WHERE nth > 1
), gone AS (
  SELECT doc_id, list(DISTINCT x) AS x FROM (SELECT doc_id, unnest(covered) AS x FROM later) GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN x IS NULL THEN t.text ELSE coalesce(list_aggregate([substr(t.text, CAST(1 + coalesce(list_sum([length(y) FOR y IN t.t[1:i - 1]]), 0) AS BIGINT), length(t.t[i])) FOR i IN range(1, len(t.t) + 1) IF NOT list_contains(x, i)], 'string_agg', ''), '') END AS text,
       CAST(coalesce(len(x), 0) AS BIGINT) AS n_removed
FROM tiles t LEFT JOIN gone g ON t.doc_id = g.doc_id
"""
