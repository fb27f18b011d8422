"""Links of the manifest against files: renames, broken links, orphans, existing outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import representative_title, stem
from .manifest import links_of


def rename_plan(manifest: DataFrame, files: DataFrame, *, name: str = "stem") -> DataFrame:
    """stt, kind, old, new, action for links whose name should change.

    ``rename``: the old file is there; ``relink``: the new one already is; ``skip``: neither is. The plan is data; carrying it out isn't.
    """
    wanted = links_of(manifest).withColumn("new", F.concat(stem(F.col("stt"), representative_title(F.col("url"), F.col("title"))), F.lit("_"), F.col("kind"))).withColumnRenamed("target", "old").where("old <> new")
    there = files.select(F.col(name).alias("_stem")).distinct()
    met = wanted.join(there.select(F.col("_stem").alias("old"), F.lit(True).alias("_old")), "old", "left").join(there.select(F.col("_stem").alias("new"), F.lit(True).alias("_new")), "new", "left")
    return met.select("stt", "kind", "old", "new", F.when(F.col("_new"), "relink").when(F.col("_old"), "rename").otherwise("skip").alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def broken_links(manifest: DataFrame, files: DataFrame, *, name: str = "stem") -> DataFrame:
    return links_of(manifest).select("stt", "kind", "target").join(files.select(F.col(name).alias("target")), "target", "left_anti")


def orphans(manifest: DataFrame, files: DataFrame, *, name: str = "stem") -> DataFrame:
    return files.select(name).join(links_of(manifest).select(F.col("target").alias(name)), name, "left_anti")


def misnumbered(manifest: DataFrame) -> DataFrame:
    """Links whose name doesn't start with their row's number."""
    return links_of(manifest).where(~F.startswith(F.col("target"), F.concat(F.format_string("%03d", "stt"), F.lit("_")))).select("stt", "kind", "target")


def pending(items: DataFrame, files: DataFrame, *, stem_column: str = "stem", name: str = "name", overwrite: bool = False) -> DataFrame:
    """Items without a raw or refined output; all of them if outputs are to be overwritten."""
    if overwrite:
        return items
    done = files.select(F.regexp_extract(name, r"^(.*)_(?:raw|refine)(?:\.md)?$", 1).alias(stem_column)).where(F.col(stem_column) != "").distinct()
    return items.join(done, stem_column, "left_anti")
