"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts can be long, and a worker holds one batch at a time.
BATCH_ROWS = 512
#: Words that a worker remembers, of about 150 bytes each, before it forgets them all.
MEMO_WORDS = 400_000


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow`` that gives freed memory back at its end: a worker process goes on to other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


#: Folder by application, where the session sets none; what ``stored`` has written, by application.
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of this machine will do if all runs on it; else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        folder = _OWN[application]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``table``, once nothing reads it any more."""
    spark, path = table.sparkSession, table._stored_at
    _WRITTEN[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once the results that read them are written."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored; the tables that were stored on the way to it are deleted."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = set(written)
    out = stored(make(), name)
    for path in [p for p in written if p not in before and p != out._stored_at]:
        written.remove(path)
        _delete(spark, path)
    return out


def text_id(text: Column) -> Column:
    """128 bits of the text's SHA-256, empty for null: by it rows are found again without a stored copy of them."""
    digest = F.unhex(F.left(F.sha2(text.cast("string").cast("binary"), 256), F.lit(32)))
    return F.coalesce(digest, F.lit(b""))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` and _row, a number of the row: written once, so that it stays the row's."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows up to which a side is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def hashed_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hashes of ``columns``, the same whatever the partitions.

    A bound on the hash leaves about one and a half times as many for the sort, so that tasks don't each
    send ``rows`` rows.
    """
    total = df.count()
    scale = 1 << 30
    most = scale if total <= rows else int(scale * 1.5 * rows / total) + 1
    marked = df.withColumn("_hash", F.pmod(F.xxhash64(*columns), F.lit(scale))).where(F.col("_hash") < most)
    return marked.orderBy("_hash", *columns).limit(rows).drop("_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
