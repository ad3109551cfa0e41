"""Benchmark decontamination: BM25 over test items, with training passages as queries.

Items are cut into parts of at most `PART` words and indexed. Every text is read in passages of `2 * PART` words,
each starting `PART` words after the last, so that any part lies whole in some passage. A passage's score for a
part is BM25 over its distinct words, as a share of the part's score for itself; all parts at or above `SHARE`
are retrieved by an inverted index with the bounds of block-max WAND. A part's commonest words, which together stay below
the threshold, have no postings for it; the cursors of the others (its essential words) go over postings in the order of
parts, and blocks of postings are skipped where the largest weights there cannot reach the threshold. All bounds are
exact: nothing is lost. (Pivots over the cursors of all words, as plain WAND has them, cost three times as much here.)

A retrieved item is verified around the passage: of the five-word shingles of its question and of its answer
at least `OVERLAP` each must be there. The answer is the item's last sentence, the question what comes before;
an item of one sentence is its own question and answer. Words are runs of \\w in lower case.

The index goes out in shards of at most `SHARD` items; texts are read once for each shard. Null, empty or
wordless texts and items match nothing, and empty tables give no rows. Very long texts are read whole, passage by
passage. Equal scores need no order, as all parts above the threshold count. Repeated rows of documents are matched
alike; repeated items are one. Ids may be of any type. Other columns are not read, but for decontaminate, which
hands them on.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_type, discard, materialise, table

PART = 64
SHARE = 0.6
OVERLAP = 0.8
SHINGLE = 5
SHARD = 4096
BLOCK = 32
K1, B = 1.2, 0.75
_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    parts = [w for s in _SENTENCES.findall(text or "") if (w := words_of(s))]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[str], region: list[str]) -> float:
    """Share of the part's shingles in the region; a part of fewer words than a shingle is one shingle."""
    size = min(SHINGLE, len(part))
    wanted = shingles(part, size) if size else set()
    return len(wanted & shingles(region, size)) / len(wanted) if wanted else 0.0


class Index:
    """Inverted index over the parts of one shard of items."""

    def __init__(self, items: list[tuple[int, str, dict[str, int]]], parts_in_all: int, mean_words: float) -> None:
        self.items = [(key, *question_answer(text)) for key, text, _ in items]
        self.lengths = [len(words_of(text)) for _, text, _ in items]
        parts: list[tuple[int, list[str]]] = []
        for at, (_, text, _) in enumerate(items):
            words = words_of(text)
            parts += [(at, words[i : i + PART]) for i in range(0, len(words), PART)]
        frequency = {w: n for _, _, f in items for w, n in f.items()}
        self.vocabulary = {w: i for i, w in enumerate(sorted(frequency))}
        self.item_of = [at for at, _ in parts]
        self.weights: list[dict[int, float]] = []
        essential: dict[int, set[int]] = defaultdict(set)
        for p, (_, words) in enumerate(parts):
            raw = {}
            for w, tf in Counter(words).items():
                n = frequency[w]
                idf = math.log(1 + (parts_in_all - n + 0.5) / (n + 0.5))
                raw[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            whole = sum(raw.values())
            self.weights.append({self.vocabulary[w]: x / whole for w, x in raw.items()})
            left = SHARE
            for w in sorted(raw, key=lambda w: (-frequency[w], len(w), w)):
                left -= raw[w] / whole
                if left <= 1e-9:
                    essential[self.vocabulary[w]].add(p)
        largest: list[dict[int, float]] = [{} for _ in range(-(-len(parts) // BLOCK))]
        for p, weights in enumerate(self.weights):
            block = largest[p // BLOCK]
            for w, x in weights.items():
                block[w] = max(x, block.get(w, 0.0))
        #: By block: the largest weight there of each word.
        self.largest = largest
        #: By word: the parts that it is essential for, in order.
        self.essential = {w: sorted(found) for w, found in essential.items()}
        self.starts = np.zeros(len(self.vocabulary) + 1, bool)
        self.starts[list(self.essential)] = True

    def retrieve(self, words: set[int]) -> list[tuple[int, float]]:
        """(part, score) of all parts that score at least SHARE for a passage's words.

        The cursors of its essential words go over their postings in the order of parts. The next part is the pivot: if
        the largest weights of the passage's words in its block stay below the threshold, all cursors go on to the next
        block, else the part is scored.
        """
        least, out = SHARE - 1e-9, []
        postings = sorted({p for w in words if w in self.essential for p in self.essential[w]})
        at, block = 0, -1
        while at < len(postings):
            part = postings[at]
            if part // BLOCK != block:
                block = part // BLOCK
                inner = self.largest[block]
                if sum(inner[w] for w in words & inner.keys()) < least:
                    at = bisect_left(postings, (block + 1) * BLOCK, at + 1)
                    continue
            weights = self.weights[part]
            score = sum(weights[w] for w in words & weights.keys())
            if score >= least:
                out.append((part, score))
            at += 1
        return out

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(part, score, first word, last word) of every part that a passage retrieves."""
        hits = np.flatnonzero(self.starts[ids])
        if not len(hits):
            return
        last = max(0, -(-(len(ids) - 2 * PART) // PART))
        passages = np.unique(np.concatenate([np.minimum(hits // PART, last), np.maximum(np.minimum(hits // PART, last) - 1, 0), np.maximum(hits // PART - 1, 0)]))
        for k in passages.tolist():
            lo, hi = k * PART, min(len(ids), (k + 2) * PART)
            words = set(ids[lo:hi].tolist())
            for p, score in self.retrieve(words):
                yield p, score, lo, hi

    def matches(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of the items verified, by item."""
        words = words_of(text)
        if not words:
            return []
        none = len(self.vocabulary)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        for p, score, lo, hi in self.search(ids):
            at = self.item_of[p]
            _, question, answer = self.items[at]
            region = words[max(0, lo - self.lengths[at]) : hi + self.lengths[at]]
            q, a = overlap(question, region), overlap(answer, region)
            if q >= OVERLAP and a >= OVERLAP:
                best[at] = max(best.get(at, (0.0, 0.0, 0.0)), (score, q, a))
        return [(self.items[at][0], *found) for at, found in sorted(best.items())]


def shards(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """One index after another, each over at most `SHARD` items; weights are those of one index over all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            parts = [[sorted(set(w[i : i + PART])) for i in range(0, len(w), PART)] for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.list_(pa.string()))), pa.array(list(map(len, words)), pa.int64())], names=["item_id", "text", "parts", "words"])

    kind = dict(items.dtypes)[item_id]
    slim = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).dropDuplicates()
    made = slim.mapInArrow(cut, f"item_id {kind}, text string, parts array<array<string>>, words bigint").filter("words > 0")
    sums = made.agg(F.count("*").alias("items"), F.sum(F.size("parts")).alias("parts"), F.sum("words").alias("words")).first()
    if not sums["items"]:
        return
    exploded = made.select("item_id", "text", F.explode("parts").alias("part")).select("item_id", "text", F.explode("part").alias("word"))
    frequency = exploded.groupBy("word").agg(F.count("*").alias("n"))
    full = exploded.distinct().join(frequency, "word").groupBy("item_id", "text").agg(F.collect_list(F.struct("word", "n")).alias("f"))
    n = -(-sums["items"] // SHARD)
    count = 2 * n if n > 1 else 1
    dealt = full.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    if count > 1:
        dealt = materialise(dealt, "test_items")  # all frequencies are counted once
    for k in range(count):
        rows = dealt.filter(F.col("shard") == k).collect()
        if rows:
            yield Index([(r["item_id"], r["text"], {x["word"]: x["n"] for x in r["f"]}) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))], sums["parts"], sums["words"] / sums["parts"])
    if count > 1:
        discard(dealt)


def find_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each item that a row of docs holds."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(key.as_py(), *m) for key, t in zip(batch.column(0), batch.column(1), strict=True) for m in shared.value.matches(t.as_py())]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(list(zip(names, types, strict=True))))

        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        types = [arrow_type(docs, doc_id), arrow_type(items, "item_id"), *[pa.float64()] * 3]
        out = out.union(slim.mapInArrow(match, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for index in shards(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(t.as_py()) for t in batch.column(text)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
