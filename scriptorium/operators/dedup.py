"""Order-keeping deduplication, numbering and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bits below the partition's number in Spark's monotonically increasing ids.
_RANGE_BITS = 33


def first_wins(df: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """The first row of each key by ``order``, all columns. Rows with a null key are one key.

    ``min_by`` combines before the shuffle, so a key with very many rows costs one row a task.
    """
    by = [order] if isinstance(order, str) else order
    packed = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*by)).alias("_row"))
    return packed.select("_row.*")


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Ordinals from 1 over all rows by ``order``, an integral column of distinct values.

    Rows fall into cells of 65,536 consecutive values, cells into cells of 65,536 cells, and so on: four levels hold all
    values of 64 bits. Each cell is numbered apart and shifted by the rows before it at every level, so
    no task sorts more than 65,536 rows or counts, however the values are spread.
    """
    celled = df.withColumn("_cell", F.shiftright(F.col(order).cast("long"), 16))
    before = lambda *by: F.sum("_n").over((Window.partitionBy(*by[:-1]) if by[1:] else Window).orderBy(by[-1])) - F.col("_n")
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_wide", F.shiftright("_cell", 16)).withColumn("_whole", F.shiftright("_cell", 32))
    wide = sizes.groupBy("_whole", "_wide").agg(F.sum("_n").alias("_n"))
    whole = wide.groupBy("_whole").agg(F.sum("_n").alias("_n")).select("_whole", before("_whole").alias("_b3"))
    above = wide.select("_whole", "_wide", before("_whole", "_wide").alias("_b2")).join(whole, "_whole").select("_wide", (F.col("_b2") + F.col("_b3")).alias("_above"))
    shift = sizes.select("_cell", "_wide", before("_wide", "_cell").alias("_b1")).join(above, "_wide").select("_cell", (F.col("_b1") + F.col("_above")).alias("_before"))
    own = celled.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(order)))
    return own.join(shift, "_cell").withColumn(name, F.col("_rank") + F.col("_before")).drop("_cell", "_rank", "_before")


def ranked(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Ordinals from 1 over all rows by columns of any kind, nulls first; rows alike in them in any order.

    Rows are sorted by ranges and stored with a number that grows within a range; a range's rows before come from a count a range.
    """
    own = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_at", _RANGE_BITS))
    counts = own.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inner = F.col("_at").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    return own.join(F.broadcast(before), "_range").withColumn(name, inner + F.col("_before") + 1).drop("_at", "_range", "_before")


def page(df: DataFrame, n: str, number: int, size: int = 20) -> DataFrame:
    """Rows of page ``number`` (from 0), clamped to the pages that exist. ``n`` has ordinals from 1."""
    last = F.greatest(F.lit(0), F.ceil(F.max(n) / size) - 1)
    bounds = df.agg(F.least(F.greatest(F.lit(number), F.lit(0)), F.coalesce(last, F.lit(0))).alias("_page"))
    return df.join(F.broadcast(bounds), (F.col(n) > F.col("_page") * size) & (F.col(n) <= (F.col("_page") + 1) * size)).drop("_page")


def best_format(formats: DataFrame, key: str, rank: str, order: str) -> DataFrame:
    """Of each key the format of the smallest rank, ties by ``order``; formats without a rank don't count."""
    return first_wins(formats.where(F.col(rank).isNotNull()), key, [rank, order])
