"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each word is padded, and every letter is predicted from the `ORDER - 1` letters before it. Counts of the highest
order are kept by class (toxic, ordinary); all lower orders are continuation counts that both classes share, so
a rare expression falls back on the same estimate in either class. A letter's log-likelihood ratio then depends
on its highest-order gram where that was seen, else on the two backoff weights of its context only: both are
worked out in Spark and collected as sorted 64-bit hashes with their values, 12 bytes for every gram counted. They
grow with the number of different grams; none is left out. Counts cover every labelled training row.

A document's evidence is its length-normalised ratio, over the whole text and in its most toxic window of
`WINDOW` words; a logistic curve over both gives the score. It is fitted on at most `SAMPLE` labelled rows of the
folds `FITTED`, with a model that counts the other training folds only; the model that scores counts them all.

Null or empty texts, and texts without words, have no evidence and get the curve's value at none. Repeated rows
are scored alike. Labels: per doc_id the largest label, null labels and ids are left out. Columns other than
those named are not read. Without labels of both classes every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, table

ORDER = 5
DISCOUNT = 0.75
WINDOW = 16
SAMPLE = 20_000
#: Labels up to this many rows (some 20 MB) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
FOLDS, COUNTED, FITTED = 5, (1, 2, 3), (4,)
_WORDS = re.compile(r"\w+")
_PAD, _END = "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null ids give null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, c0, c1) from (text, toxic): each task adds up its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            grams: dict[str, list[int]] = {}
            for y, words in enumerate(held):
                for word, n in words.items():
                    padded = _PAD * (ORDER - 1) + word + _END
                    for i in range(len(padded) - ORDER + 1):
                        grams.setdefault(padded[i : i + ORDER], [0, 0])[y] += n
                words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), *(pa.array([c[y] for c in grams.values()], pa.int64()) for y in (0, 1))], names=["gram", "c0", "c1"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                held[y.as_py()].update(words_of(text.as_py()))
                if sum(map(len, held)) > 400_000:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(count, "gram string, c0 bigint, c1 bigint").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def ratios(top: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Log-likelihood ratios (gram, n, llr) of the grams seen, (gram, n, llr) of contexts for unseen grams, and the tables behind them."""
    held, ctx = F.col, lambda k: F.substring("gram", 1, k)
    contexts = top.groupBy(ctx(ORDER - 1).alias("ctx")).agg(
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.count_if(held("c0") > 0).alias("t0"), F.count_if(held("c1") > 0).alias("t1")
    )
    shared = None
    levels = []
    below = top
    for k in range(ORDER - 1, 0, -1):
        below = below.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").cast("double").alias("k"))
        levels.append((k, below))
    for k, level in reversed(levels):
        if k == 1:
            whole = level.agg(F.sum("k").alias("all"))
            shared = level.crossJoin(F.broadcast(whole)).select("gram", (held("k") / held("all")).alias("p"))  # one row
            continue
        seen = level.groupBy(ctx(k - 1).alias("ctx")).agg(F.sum("k").alias("all"), F.count("*").alias("t"))
        lower = shared.select(held("gram").alias("tail"), held("p").alias("low"))
        shared = (
            level.withColumns({"ctx": ctx(k - 1), "tail": F.substring("gram", 2, k - 1)})
            .join(seen, "ctx")
            .join(lower, "tail")
            .select("gram", ((F.greatest(held("k") - discount, F.lit(0.0)) + discount * held("t") * held("low")) / held("all")).alias("p"))
        )
    weight = lambda n, t: F.when(held(n) > 0, discount * held(t) / held(n)).otherwise(1.0)
    contexts = materialise(contexts.withColumns({"w0": weight("n0", "t0"), "w1": weight("n1", "t1")}), "contexts")
    shared = materialise(shared, "shared")
    part = lambda c, n: F.when(held(n) > 0, F.greatest(held(c) - discount, F.lit(0.0)) / held(n)).otherwise(0.0)
    lower = shared.select(held("gram").alias("tail"), held("p").alias("low"))
    seen = (
        top.withColumns({"ctx": ctx(ORDER - 1), "tail": F.substring("gram", 2, ORDER - 1)})
        .join(contexts, "ctx")
        .join(lower, "tail")
        .select("gram", (held("c0") + held("c1")).alias("n"), F.log((part("c1", "n1") + held("w1") * held("low")) / (part("c0", "n0") + held("w0") * held("low"))).alias("llr"))
    )
    return seen, contexts.select(held("ctx").alias("gram"), (held("n0") + held("n1")).alias("n"), F.log(held("w1") / held("w0")).alias("llr")), [contexts, shared]


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each run of `order` letters, by where it starts."""
    out = np.zeros(max(0, len(codes) - order + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(order):
            out = (out + codes[j : j + len(out)].astype(np.uint64) + np.uint64(1)) * _BASE
            out ^= out >> np.uint64(29)
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Table:
    """Sorted hashes of all grams, and their values."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    @classmethod
    def collect(cls, grams: DataFrame, order: int) -> Table:
        """Every gram's hash and value reach the driver, 12 bytes each."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = gram_hashes(codes_of("".join(batch.column(0).to_pylist())), order)[::order]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(1)], names=["h", "llr"])

        rows = grams.select("gram", F.col("llr").cast("float").alias("llr")).mapInArrow(hashed, "h bigint, llr float").toArrow()
        return cls(rows["h"].to_numpy().view(np.uint64), rows["llr"].to_numpy())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.values[at]


class Scorer:
    """Ratios of words by the two tables; words are kept, up to a bound, as most come again."""

    KEPT = 150_000

    def __init__(self, seen: Table, unseen: Table) -> None:
        self.seen, self.unseen = seen, unseen
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums, self.sizes = np.zeros(0, np.float32), np.zeros(0, np.float32)

    def learn(self, words: set[str]) -> None:
        new = list(words - self.at.keys())
        if len(self.at) + len(new) > self.KEPT:
            self.clear()
            new = list(words)
        if not new:
            return
        codes = codes_of("".join(f"{_PAD * (ORDER - 1)}{w}{_END}" for w in new))
        sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
        starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        is_in, value = self.seen.find(gram_hashes(codes, ORDER))
        known, back = self.unseen.find(gram_hashes(codes, ORDER - 1)[: len(value)])
        value = np.where(is_in, value, np.where(known, back, 0)).astype(np.float64)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, (sums[starts + sizes] - sums[starts]).astype(np.float32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.float32)])

    def evidence(self, texts: list[str | None]) -> list[tuple[float, float]]:
        out = []
        split = [words_of(t) for t in texts]
        self.learn(set().union(*split))
        for words in split:
            if not words:
                out.append((0.0, 0.0))
                continue
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            s, n = np.cumsum(self.sums[at], dtype=np.float64), np.cumsum(self.sizes[at], dtype=np.float64)
            mean = best = s[-1] / n[-1]
            if len(words) > WINDOW:
                s, n = np.concatenate([[0.0], s]), np.concatenate([[0.0], n])
                best = float(((s[WINDOW:] - s[:-WINDOW]) / (n[WINDOW:] - n[:-WINDOW])).max())
            out.append((float(mean), float(best)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (the last one constant) by damped Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1e-2
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def with_evidence(rows: DataFrame, tables, text: str, drop: bool) -> DataFrame:
    """The rows with _tox_mean and _tox_window of a column of texts, which goes if `drop`."""
    names = [c for c in rows.columns if not (drop and c == text)]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*tables.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = scorer.evidence(part.column(text).to_pylist())
                new = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, "_tox_mean", "_tox_window"])

    return rows.mapInArrow(add, ", ".join([*kinds, "_tox_mean double", "_tox_window double"]))


def model(top: DataFrame) -> Broadcast:
    """The tables of ratios of seen grams and of contexts."""
    seen, unseen, behind = ratios(top)
    out = top.sparkSession.sparkContext.broadcast((Table.collect(seen, ORDER), Table.collect(unseen, ORDER - 1)))
    discard(*behind)
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple:
    """The broadcast tables of ratios, and the weights of the curve."""
    known = (
        labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("toxic"))
        .filter("label_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("label_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold(F.col("label_id")))
        .filter(F.col("fold").isin(*COUNTED, *FITTED))
    )
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    train = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(known, "label_id")
    of = lambda folds: materialise(gram_counts(train.filter(F.col("fold").isin(*folds))), "grams")
    counted, others = of(COUNTED), of(FITTED)
    tables = model(counted)
    fitted = train.filter(F.col("fold").isin(*FITTED)).select("toxic", F.xxhash64("label_id", "text").alias("at"), "text")
    drawn = with_evidence(fitted, tables, "text", True).orderBy("at", "toxic").limit(SAMPLE).toPandas()
    tables.destroy()
    top = materialise(counted.union(others).groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "grams")
    tables = model(top)
    discard(counted, others, top)
    y = drawn["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        return tables, logistic(drawn[["_tox_mean", "_tox_window"]].to_numpy(), y)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    return tables, np.array([0.0, 0.0, np.log(share / (1 - share))])


def _score(w: np.ndarray) -> Column:
    line = F.col("_tox_mean") * float(w[0]) + F.col("_tox_window") * float(w[1]) + float(w[2])
    return 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(50.0)), F.lit(-50.0))))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    tables, w = fit(docs, labels, doc_id, text, label)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = with_evidence(slim, tables, "text", True).select("doc_id", _score(w).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns."""
    tables, w = fit(docs, labels, doc_id, text, label)
    return with_evidence(docs, tables, text, False).filter(_score(w) < 0.5).select(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
