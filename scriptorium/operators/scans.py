"""What earlier rows of an ordered log leave for later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors as E

#: Bits of the order that rows of one cell differ in.
CELL = 16


def carried(df: DataFrame, value: Column, by: str, order: str, name: str, *, cell: int = CELL) -> DataFrame:
    """``df`` with ``name``: the last value that isn't null in the rows before, of the same ``by``, by ``order`` (integral, distinct within ``by``).

    Rows are cut into cells of 2^``cell`` consecutive orders. The last value of each cell is carried over the cells, which are one row each, and
    within a cell from row to row: a ``by`` that holds a third of the rows is no single task.
    """
    own = df.withColumn("_cell", F.shiftright(F.col(order).cast("long"), cell)).withColumn("_value", value)
    ends = own.groupBy(by, "_cell").agg(F.max_by(F.when(F.col("_value").isNotNull(), F.col("_value")), F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(F.col(by).alias("_by"), F.col("_cell").alias("_at"), F.last("_end", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy(by, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = own.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
    met = near.join(start, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_at")))
    return met.withColumn(name, F.coalesce("_near", "_start")).drop("_cell", "_value", "_near", "_by", "_at", "_start")


def pinned_clients(items: DataFrame, *, run: str = "run", order: str = "seq", url: str = "url", worked: str = "client", cookies: bool = False) -> DataFrame:
    """``items`` with pinned, the client that worked for an earlier item of the run, and clients, those to try for this item in order.

    ``worked`` is the client that an item was fetched by, null if none was. A client that an item's link doesn't allow stays pinned for later ones.
    """
    own = carried(items, F.col(worked), run, order, "pinned")
    return own.withColumn("clients", E.clients(F.col(url), F.col("pinned"), cookies))
