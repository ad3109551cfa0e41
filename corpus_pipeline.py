"""Documents to packed training sequences, in five stages.

Every stage gets what the one before kept, and all but the last return the columns of documents.

Null texts and ids stay as they are. Empty texts stay, but a document that line dedup has left without a word goes with
its lines. Very long texts are read whole in every stage. Repeated rows of one id and text are one document for the
deduplicating stages, which keep one. Ties go to the smallest id. Empty tables give empty results. Columns beside
doc_id, text and n_chars are handed on unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, lines, minhash, packing, toxicity
from millrace.llm.common import discard, materialise, table

#: Jaccard similarity of near copies, in hundredths; op5 has its own.
NEAR_COPIES = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that are like an earlier one go; n_chars follows the text. Documents of which no word is left go too."""
    kept = lines.dedup_lines(docs, size="n_chars")
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return kept.filter(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; copies share 80 % of their word shingles."""
    return minhash.keep_one(docs, threshold=NEAR_COPIES)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token pieces with their places in sequences."""
    return packing.pack_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir), name)
        discard(docs)  # a stage's table goes once the next one is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and tokenizers are not expressed in SQL; tests hold each stage against plain code.
ORACLE_SQL = None
