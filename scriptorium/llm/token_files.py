"""Token-ID / binary output: shards of raw ids with a minimal perfect hash index.

A shard is one file: the ids of its documents one after the other (little-endian, two or four
bytes each), an index block, and a fixed footer. The index block holds a minimal perfect
hash over the shard's keys; slot by slot it stores a 32-bit fingerprint of the key, the
ordinal of the key's first document and how many there are; an offset table gives where each
document's ids lie. Access by key therefore takes one hash, one comparison and one read.

Shards are cut by ranges of the key, in ascending order (null keys first), so a key's shard
follows from the shards' first and last keys; ``manifest`` has these, one row a shard. A key
with very many rows may lie in several shards and is found in each.

Defined cases: null text has only the end id; a null key is stored before all others and
found by a null; repeated keys keep all their rows (ordered by a hash of the text); no rows
give no shards and an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mph import MinimalPerfectHash, fingerprint
from .scratch import new_path, small_batches, tidy
from .tokens import default_tokenizer, encoder

MAGIC = b"TOKSHRD1"
#: Magic, bytes an id, documents, ids, bytes of the index block.
FOOTER = "<8sIQQQ"
FOOTER_BYTES = struct.calcsize(FOOTER)
#: Documents a shard has, about; it bounds the index that a task holds.
ROWS_PER_SHARD = 8192
#: Shards at most: beyond, they get longer. It bounds what the driver and each task know of the shards.
MAX_SHARDS = 65_536
LOWEST = -(1 << 63)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _index_block(keys: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    """``keys`` ascending, nulls (whose key is LOWEST) first."""
    own = keys[~null]
    distinct, first, count = np.unique(own, return_index=True, return_counts=True)
    mph = MinimalPerfectHash.build(distinct)
    slot = mph.number(distinct)
    table = np.zeros(len(distinct), [("fp", "<u4"), ("first", "<u4"), ("count", "<u4")])
    table["fp"][slot], table["first"][slot], table["count"][slot] = fingerprint(distinct), first + null.sum(), count
    out = io.BytesIO()
    np.savez(out, mph=np.frombuffer(mph.to_bytes(), np.uint8), table=table, nulls=np.int64(null.sum()), offsets=np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"))
    return out.getvalue()


class Shard:
    """A shard file, opened for access by key."""

    def __init__(self, path: str):
        filesystem, at = _filesystem(path)
        self._file = filesystem.open_input_file(at)
        size = self._file.size()
        magic, self.width, self.n_docs, self.n_ids, n_index = struct.unpack(FOOTER, self._file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        with np.load(io.BytesIO(self._file.read_at(n_index, size - FOOTER_BYTES - n_index))) as x:
            self._mph = MinimalPerfectHash.from_bytes(x["mph"].tobytes())
            self._table, self._nulls, self.offsets = x["table"], int(x["nulls"]), x["offsets"].astype(np.int64)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ordinal and number of documents of each key; 0 documents if it is absent."""
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self._mph.number(keys) if len(self._table) else np.full(len(keys), -1)
        there = slot >= 0
        row = self._table[slot[there]] if len(self._table) else self._table
        same = row["fp"] == fingerprint(keys[there])
        first[there], count[there] = row["first"] * same, row["count"] * same
        first[null], count[null] = 0, self._nulls
        return first, count

    def ids(self, ordinal: int) -> bytes:
        a, b = self.offsets[ordinal], self.offsets[ordinal + 1]
        return self._file.read_at(int(b - a) * self.width, int(a) * self.width)


def write(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, rows_per_shard: int = ROWS_PER_SHARD) -> tuple[str, DataFrame]:
    """Encode ``docs`` into shard files under ``path``; returns the path and the manifest.

    ``key`` must be integral. The path must be in a folder that all executors share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path, tokenizer = path or new_path(spark, "token-shards"), tokenizer or default_tokenizer()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    shards = min(MAX_SHARDS, max(1, -(-rows.count() // rows_per_shard)))
    # The text's hash beside the key keeps one very frequent key from filling one shard.
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc()]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, enc = TaskContext.get().partitionId(), encoder(tokenizer, end_id)
        name = f"shard-{number:08d}.tok"
        filesystem, folder = _filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        keys, nulls, lengths, n = [], [], [], 0
        with filesystem.open_output_stream(draft) as out:
            for batch in batches:
                ids = enc.encode(batch.column(1).to_pylist())
                out.write(b"".join(ids))
                keys.append(batch.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                lengths.append(np.array([len(x) for x in ids], np.int64) // enc.dtype.itemsize)
            if keys:
                k, null, length = map(np.concatenate, (keys, nulls, lengths))
                n = int(length.sum())
                out.write(block := _index_block(k, null, length))
                out.write(struct.pack(FOOTER, MAGIC, enc.dtype.itemsize, len(k), n, len(block)))
        if not keys:
            filesystem.delete_file(draft)
            return
        filesystem.move(draft, f"{folder}/{name}")  # a repeated task writes the same file again
        yield pa.RecordBatch.from_pylist([{"shard": number, "file": name, "first_key": int(k[0]), "last_key": int(k[-1]), "n_docs": len(k), "n_ids": n}], pa.schema([("shard", pa.int64()), ("file", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    made = ordered.mapInArrow(tidy(save), "shard long, file string, first_key long, last_key long, n_docs long, n_ids long")
    made.write.parquet(f"{path}/manifest")
    return path, manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard."""
    return spark.read.parquet(f"{path}/manifest")


def lookup(keys: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """The documents that the shards under ``path`` have for ``keys`` (first column, or ``key``).

    Returns key, shard, ordinal, start (ids of all documents before it), n_ids and ids
    (binary, little-endian unsigned 32-bit). Repeated keys are looked up once; absent keys
    give no row. The driver and every task hold three numbers a shard, of which there are at most MAX_SHARDS.
    """
    spark = keys.sparkSession
    key = key or keys.columns[0]
    rows = manifest(spark, path).orderBy("shard").collect()
    first, last = (np.array([r[c] for r in rows], np.int64) for c in ("first_key", "last_key"))
    starts = np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows])]).astype(np.int64)
    files = [r["file"] for r in rows]
    wanted = keys.select(F.col(key).cast("long").alias("k")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(last, k, "left"), np.searchsorted(first, k, "right")
            n = np.maximum(high - low, 0)
            at = np.repeat(np.arange(len(k)), n)
            within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(low[at] + within)], ["k", "at"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Shard] | None = None
        for batch in batches:
            at, k = batch.column(1).to_numpy(), batch.column(0)
            plain, null = k.fill_null(LOWEST).to_numpy(zero_copy_only=False), k.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held is None or held[0] != at[a]:
                    if held:
                        held[1]._file.close()
                    held = int(at[a]), Shard(f"{path}/{files[at[a]]}")
                shard, (begin, count) = held[1], held[1].find(plain[a:b], null[a:b])
                which = np.repeat(np.arange(a, b), count)
                ordinal = np.repeat(begin, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                for i in range(0, len(which), 256):
                    o = ordinal[i : i + 256]
                    ids = [np.frombuffer(shard.ids(x), f"<u{shard.width}").astype("<u4").tobytes() for x in o.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [k.take(pa.array(which[i : i + 256])), pa.array(np.full(len(o), held[0])), pa.array(o), pa.array(starts[held[0]] + shard.offsets[o]), pa.array(shard.offsets[o + 1] - shard.offsets[o]), pa.array(ids, pa.binary())],
                        ["k", "shard", "ordinal", "start", "n_ids", "ids"],
                    )
        if held:
            held[1]._file.close()

    routed = wanted.mapInArrow(route, "k long, at long").repartition(max(1, len(files)), F.col("at")).sortWithinPartitions("at", F.col("k").asc_nulls_first())
    return routed.mapInArrow(tidy(read), "k long, shard long, ordinal long, start long, n_ids long, ids binary").withColumnRenamed("k", key)


def token_table(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``op3``: write ``docs`` and read every document back by its key, with the digest of its ids."""
    path, _ = write(docs, path, **options)
    found = lookup(docs.select(options.get("key", "doc_id")), path)
    return found.select(options.get("key", "doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard", "ordinal")
