"""Known keys in a bucketed table beside the manifest, so that new links meet them without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from . import manifest as M


def create(manifest: DataFrame, table: str, *, buckets: int = 64) -> None:
    """Table ``table`` of the manifest's distinct keys (url_key), in so many buckets."""
    keys = M.known_keys(manifest).where("url_key is not null").select("url_key")
    keys.repartition(buckets, "url_key").write.bucketBy(buckets, "url_key").sortBy("url_key").saveAsTable(table)


def add(links: DataFrame, table: str, *, url: str = "url", buckets: int = 64) -> None:
    """Append the keys of ``links`` that ``table`` doesn't have; what is written are these keys, into the table's buckets. ``buckets`` is the table's number."""
    new = new_links(links, table, url=url).where("url_key is not null").select("url_key").distinct()
    new.repartition(buckets, "url_key").write.mode("append").bucketBy(buckets, "url_key").sortBy("url_key").saveAsTable(table)


def new_links(links: DataFrame, table: str, *, url: str = "url") -> DataFrame:
    """``links`` with url_key, without those that ``table`` has. Only the links are shuffled, or the few of a batch broadcast: the table's side is read bucket by bucket.

    Null links have no key and stay.
    """
    own = links.withColumn("url_key", canonical_url(F.col(url)))
    return own.join(own.sparkSession.table(table).hint("merge"), "url_key", "left_anti")
