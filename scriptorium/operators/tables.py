"""Tables and small files in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``written`` has left, by application.
_LEFT: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; without it there is no folder that every executor sees, which is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; ``discard_all`` deletes what is there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: its lineage ends here, and values that hang on the order of rows stay as they are."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_all(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them are written."""
    for path in _LEFT.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` inside are deleted at its end."""
    left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
    before = set(left)
    try:
        yield
    finally:
        for path in [p for p in left if p not in before]:
            left.remove(path)
            delete(spark, path)


#: Rows up to which a side is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A ``written`` table, broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    found = _files(spark, folder)
    return sorted(x.getPath().getName() for x in found.listStatus(_path(spark, folder))) if found.exists(_path(spark, folder)) else []


def read_text(spark: SparkSession, path: str) -> str:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all; a file that is there already is an error, so of two writers one wins."""
    jvm, draft = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}.draft"
    stream = _files(spark, draft).create(_path(spark, draft), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(_path(spark, draft), _path(spark, path), options)
    except Exception:
        delete(spark, draft)
        raise
