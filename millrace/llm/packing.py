"""Best-fit packing by a plan over the histogram of lengths.

Documents become token pieces of at most `capacity` ids. Only the counts by length reach the driver (at most
`capacity` numbers, whatever the size of the corpus). Best-fit decreasing runs over these counts and gives
segments: the pieces of one length and a range of ranks fill a range of sequences. Each piece then finds its
rank within its length and takes its slot from the broadcast segments.

Null text counts as empty; an empty document is its end token alone. Repeated rows are packed each by itself.
Rows keep their doc_id even if it is null. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_type, materialise, table

CAPACITY = 1024
END_ID = 2
#: Texts of these characters only go through the faster of two encoders of one vocabulary; both give equal ids there.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*+")
#: Rows of one (bucket, length) window at most, about.
BUCKET_ROWS = 200_000


class Encoder:
    """Texts to ids by a tokenizers file, and by its vocabulary as ranks where the two agree."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, path: str, ranks_path: str) -> Encoder:
        """One encoder for a Python worker."""
        if (path, ranks_path) not in cls._made:
            cls._made[path, ranks_path] = cls(path, ranks_path)
        return cls._made[path, ranks_path]

    def ids(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(
    docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers.

    A document of at most `capacity` ids is one piece. A longer one is cut into pieces of `capacity`, of which
    only the first may be shorter.
    """
    paths = paths or default_paths()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(*paths)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[tuple] = []
                for key, value in zip(part.column(0), part.column(1), strict=True):
                    ids = np.array([*encoder.ids(value.as_py() or ""), end_id], dtype="<u4")
                    n, at, piece = len(ids), 0, 0
                    while at < n:
                        take = n if n <= capacity else ((n - at) % capacity or capacity)
                        out.append((key.as_py(), piece, at, take, ids[at : at + take].tobytes()))
                        at, piece = at + take, piece + 1
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    key_type = dict(docs.dtypes)[doc_id]
    names = ["doc_id", "piece", "start", "length", "ids"]
    types = [arrow_type(docs, doc_id), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return docs.select(doc_id, text).mapInArrow(cut, f"doc_id {key_type}, piece int, start bigint, length bigint, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts.

    Rows (length, first rank, pieces, pieces in a sequence, first sequence, offset), by length and rank: ranks
    [first, first + pieces) of the length fill sequences from the first one on, so many in each, from the offset.
    Each step uses up either a length or a range of open sequences, so there are far fewer rows than sequences.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of (first sequence, sequences)
    rooms: list[int] = []
    rows: list[tuple[int, ...]] = []
    made = 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, first, n = capacity, made, max(1, -(-left // (capacity // length)))
                made += n
            each = min(room // length, left)
            used = min(n, left // each)
            rows.append((length, rank, used * each, each, first, capacity - room))
            keep(room, first + used, n - used)
            keep(room - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are read more than once: materialise them first."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, capacity)
    total = sum(counts.values())
    buckets = max(1, total // BUCKET_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "piece", "start", *sorted(set(pieces.columns) - {"doc_id", "piece", "start", "length"})]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = (
        dealt.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "length").orderBy(*order)) - 1)
        .join(before, ["bucket", "length"])
        .withColumn("rank", F.col("before") + F.col("own"))
        .select(*pieces.columns, "rank")
    )
    shared = spark.sparkContext.broadcast(slots)
    names = [*pieces.columns, "sequence_id", "offset"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows[:, 0] << 50) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(keys, (length << 50) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(take, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole operator: pieces with their ids and places."""
    return place(materialise(token_pieces(docs, paths, capacity, end_id), "pieces"), capacity)


def pack_digest(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum for their ids: the ids are not carried any further than the row that makes them."""
    made = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(materialise(made, "pieces"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"))
