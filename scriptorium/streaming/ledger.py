"""The manifest of very many rows: a base in buckets of keys, and what batches have changed since.

``<folder>/base/at=<id>/bucket=<n>`` holds rows, ``<folder>/delta/at=<id>/bucket=<n>`` the rows that a batch changed or added, whole. A
snapshot (``<folder>/snapshots/<n>.json``) lists what counts. It is published by a rename that fails if the name is taken, so readers see a batch whole or not at
all, and what a failed batch has left behind is in no list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import manifest as M
from ..operators import tables
from ..operators.dedup import ranked

ROW = "pos long, stt long, url string, title string, ts string, raw_link string, refine_link string, status string"
STORED = f"{ROW}, url_key string, version long, at string, bucket int"
BUCKETS = 64
#: Changes of a bucket after which it is written anew; snapshots that stay for readers that have begun.
LEAST, KEPT = 8, 3


class Ledger:
    """A manifest under ``folder``. What a commit writes follows from its batch; what it reads are the buckets that its keys fall into."""

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def create(self, start: DataFrame) -> None:
        """The first base, of a manifest (pos distinct). One that is there already is an error."""
        at, held = self._write("base", start, 0)
        top, most = self._read("base", [(at, held)]).agg(F.coalesce(F.min("pos"), F.lit(0)), F.coalesce(F.max("stt"), F.lit(0))).first()
        self._publish(0, {"batch": -1, "buckets": self.buckets, "top": top, "most": most, "base": {str(b): [at, 0] for b in held}, "deltas": []})

    def snapshot(self) -> tuple[int, dict]:
        """Number and list of the newest snapshot."""
        listed = [n for n in tables.names(self.spark, f"{self.folder}/snapshots") if n.endswith(".json")]
        if not listed:
            raise FileNotFoundError(f"{self.folder} has no manifest yet")
        found = json.loads(tables.read_text(self.spark, f"{self.folder}/snapshots/{listed[-1]}"))
        self.buckets = found["buckets"]
        return int(listed[-1][:-5]), found

    def read(self) -> DataFrame:
        """The manifest's rows as they are now."""
        return self._merged(self.snapshot()[1]).select(*M.COLUMNS)

    def commit(self, batch: DataFrame, number: int, now) -> bool:
        """Merge results (and failures, rows with a ``reason``) as ``upsert`` and ``mark_failures`` do; false if batch ``number`` is in already.

        Of each key of the batch the first row is read, from the buckets of these keys alone; the rows that come out are the delta.
        """
        version, listed = self.snapshot()
        if number <= listed["batch"]:
            return False
        with tables.passing(self.spark):
            at, held = self._write("delta", self._changed(batch, listed, now), version + 1)
        top, most = self._read("delta", [(at, held)]).agg(F.min("pos"), F.max("stt")).first()
        least, highest = (min(listed["top"], top), max(listed["most"], most)) if held else (listed["top"], listed["most"])
        self._publish(version + 1, listed | {"batch": number, "top": least, "most": highest, "deltas": [*listed["deltas"], *([[at, version + 1, held]] if held else [])]})
        return True

    def _changed(self, batch: DataFrame, listed: dict, now) -> DataFrame:
        """Keys are computed once, and each step is written: what the driver plans stays small, however many commits it has seen."""
        batch = tables.written(M.keyed(batch).withColumn("bucket", self._bucket()), "ledger-batch")
        done, failed = (batch.where("reason is null"), batch.where("reason is not null")) if "reason" in batch.columns else (batch, None)
        keys = tables.written(batch.where("url_key is not null").select("url_key", "bucket").distinct(), "ledger-keys")
        touched = {r["bucket"] for r in keys.select("bucket").distinct().collect()}
        near = self._merged(listed, touched).join(keys.select("url_key"), "url_key", "left_semi")
        first = tables.written(near.groupBy("url_key").agg(F.min_by(F.struct(*M.COLUMNS), "pos").alias("r")).select("url_key", "r.*"), "ledger-first")

        latest = tables.written(M.latest_results(done).select("url_key", "r.*"), "ledger-latest")
        fresh = tables.written(latest.join(first.select("url_key"), "url_key", "left_anti").select("order", "stt"), "ledger-fresh")
        given = fresh.agg(F.max("stt")).first()[0]
        numbers = ranked(fresh.where("stt is null").select(F.col("order").alias("_order")), "_order", name="_n")
        number = F.coalesce("stt", F.lit(max(listed["most"], given or 0)).cast("long") + F.col("_n"))
        results = latest.join(numbers, F.col("order") == F.col("_order"), "left").withColumn("stt", number).drop("_order", "_n")
        rows = tables.written(M.upsert(first, tables.written(results, "ledger-results"), now, top=listed["top"]), "ledger-rows")
        return rows if failed is None else M.mark_failures(M.keyed(rows), failed, has_key=True)

    def compact(self, least: int = LEAST) -> list[int]:
        """Write the buckets that at least so many deltas touch anew, and no others; returns them."""
        version, listed = self.snapshot()
        times = {}
        for at, since, held in self._open_deltas(listed):
            for b in held:
                times[b] = times.get(b, 0) + 1
        due = sorted(b for b, n in times.items() if n >= least)
        if not due:
            return []
        at, held = self._write("base", self._merged(listed, set(due)).select(*M.COLUMNS), version + 1)
        base = listed["base"] | {str(b): [at, version + 1] for b in held}
        deltas = [d for d in listed["deltas"] if any(base.get(str(b), [None, -1])[1] < d[1] for b in d[2])]
        self._publish(version + 1, listed | {"base": base, "deltas": deltas})
        return due

    def vacuum(self, kept: int = KEPT) -> None:
        """Delete what the last ``kept`` snapshots don't list, failed batches' leavings included. No commit may run meanwhile."""
        listed = [n for n in tables.names(self.spark, f"{self.folder}/snapshots") if n.endswith(".json")]
        used = set()
        for name in listed[-kept:]:
            found = json.loads(tables.read_text(self.spark, f"{self.folder}/snapshots/{name}"))
            used |= {at for at, _ in found["base"].values()} | {d[0] for d in found["deltas"]}
        for name in listed[:-kept]:
            tables.delete(self.spark, f"{self.folder}/snapshots/{name}")
        for kind in ("base", "delta"):
            for name in tables.names(self.spark, f"{self.folder}/{kind}"):
                if name.removeprefix("at=") not in used:
                    tables.delete(self.spark, f"{self.folder}/{kind}/{name}")

    def _bucket(self):
        return F.pmod(F.xxhash64("url_key"), F.lit(self.buckets)).cast("int")

    def _write(self, kind: str, rows: DataFrame, version: int) -> tuple[str, list[int]]:
        """Rows as one set of bucket folders: its id, and the buckets that it has."""
        at = uuid.uuid4().hex
        marked = M.keyed(rows.select(*M.COLUMNS)).withColumn("version", F.lit(version).cast("long")).withColumn("bucket", self._bucket())
        marked.repartition("bucket", F.pmod(F.xxhash64("pos"), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.folder}/{kind}/at={at}")
        held = [int(n.removeprefix("bucket=")) for n in tables.names(self.spark, f"{self.folder}/{kind}/at={at}") if n.startswith("bucket=")]
        return at, sorted(held)

    def _read(self, kind: str, sets: Iterable[tuple[str, Iterable[int]]]) -> DataFrame:
        """Rows of (id, buckets): only these folders are listed and read."""
        paths = [f"{self.folder}/{kind}/at={at}/bucket={b}" for at, held in sets for b in held]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _open_deltas(self, listed: dict, only: set[int] | None = None) -> list[tuple[str, int, list[int]]]:
        """Deltas with the buckets whose base is older."""
        since = {int(b): version for b, (_, version) in listed["base"].items()}
        return [(at, version, [b for b in held if since.get(b, -1) < version and (only is None or b in only)]) for at, version, held in listed["deltas"]]

    def _merged(self, listed: dict, only: set[int] | None = None) -> DataFrame:
        """Base rows that no delta has, and of each place that deltas have the newest row."""
        by_set = {}
        for b, (at, _) in listed["base"].items():
            if only is None or int(b) in only:
                by_set.setdefault(at, []).append(int(b))
        base = self._read("base", by_set.items())
        deltas = self._read("delta", [(at, held) for at, _, held in self._open_deltas(listed, only) if held])
        newest = deltas.groupBy("bucket", "pos").agg(F.max_by(F.struct(*deltas.columns), "version").alias("r")).select("r.*")
        return base.join(newest.select("bucket", "pos"), ["bucket", "pos"], "left_anti").select(*deltas.columns).unionByName(newest)

    def _publish(self, number: int, listed: dict) -> None:
        tables.publish_text(self.spark, f"{self.folder}/snapshots/{number:012d}.json", json.dumps(listed))


def commit_stream(results: DataFrame, ledger: Ledger, checkpoint: str, now, *, least: int = LEAST) -> StreamingQuery:
    """Each micro-batch of ``results`` as a commit; buckets that have changed often enough are written anew between batches.

    A batch that is replayed after its commit changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = Ledger(batch.sparkSession, ledger.folder, buckets=ledger.buckets)
        own.commit(batch, number, now)
        own.compact(least)

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
