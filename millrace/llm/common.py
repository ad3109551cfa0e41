"""Storage and column helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.session import table  # noqa: F401

#: Tables of at most so many bytes are broadcast.
BROADCAST_BYTES = 24 << 20
#: Heaps of at least so many bytes are not collected between tables.
TIDY_HEAP = 4 << 30
_OWN: dict[str, str] = {}
#: Where materialised tables are, by the DataFrame that reads them.
_PATHS: dict[int, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master may go without it (tests); a cluster without it is an error, as its machines share no
    temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="millrace-"))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = weakref.ref(out), path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        ref, path = _PATHS.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets go of broadcasts and shuffle files of plans that ended: Spark's cleaner acts on what the collectors find.

    Drivers of a large heap are left to collect by themselves.
    """
    jvm = spark.sparkContext._jvm
    if jvm.Runtime.getRuntime().maxMemory() < TIDY_HEAP:
        gc.collect()
        jvm.System.gc()


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The Arrow type of a column, for what mapInArrow gives back."""
    return to_arrow_type(df.schema[name].dataType)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if its rows, counted with the lengths of what they hold, take at most `limit` bytes.

    The bound is on bytes, not rows: arrays and texts count by what is in them. Larger tables are joined by a shuffle.
    """
    held: list[Column] = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("array", "map"):
            held.append(F.coalesce(F.size(F.col(f.name)), F.lit(0)) * 24)
        elif kind in ("string", "binary"):
            held.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 8)
        else:
            held.append(F.lit(8))
    size = df.agg(F.sum(sum(held, F.lit(32)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart: rows that repeat both id and text are one document."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
