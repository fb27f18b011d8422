"""Incremental commits: results that stream in are merged into the manifest batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import manifest as M

RESULT = "url string, title string, raw_name string, refine_name string, stt long, `order` long"
#: Versions that stay: a batch can be replayed, which needs the one before it.
KEPT = 3


def versions(folder: str) -> str:
    return f"{folder}/version"


def current(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """The manifest after ``batch``, if there is one."""
    try:
        return spark.read.parquet(f"{versions(folder)}={batch}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _prune(spark: SparkSession, folder: str, number: int) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{versions(folder)}={number}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def commit_stream(results: DataFrame, start: DataFrame, folder: str, checkpoint: str, now) -> StreamingQuery:
    """Merge each micro-batch of ``results`` into the manifest, as a new version of it under ``folder``.

    Results are rows of RESULT; those with a ``reason`` (a further column, if there is one) failed, and only mark the status of their link.
    A batch's version follows from the version before and the batch alone, and overwrites itself when the batch is
    replayed: rows are never merged twice. Without the version before it is an error; only the last KEPT ones stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, folder, number - 1) if number else start
        if before is None:
            raise FileNotFoundError(f"{versions(folder)}={number - 1} is missing, so batch {number} can't be merged")
        done, failed = (batch.where("reason is null"), batch.where("reason is not null")) if "reason" in batch.columns else (batch, None)
        merged = M.upsert(before, done, now)
        if failed is not None:
            merged = M.mark_failures(merged, failed)
        merged.write.mode("overwrite").parquet(f"{versions(folder)}={number}")
        if number >= KEPT:
            _prune(spark, folder, number - KEPT)

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(links: DataFrame, *, key: str = "url_key", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: links that are pasted again don't go through again."""
    return links.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def error_rates(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Errors and all events a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "errors", "n")
