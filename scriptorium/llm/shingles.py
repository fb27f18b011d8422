"""Shingle sets: exact Jaccard similarity, and the prefixes by which similar sets must meet.

Two sets of similarity s or more share a shingle among the first n - ceil(s n) + 1 of each, in any order that is the
same for all sets. The order puts shingles that are frequent in a sample last: the sample decides how much
meets, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, text_id, tidy

HASH_SEED = 42
#: Jaccard similarity from which two texts are near-duplicates, as numerator and denominator.
LEAST = (4, 5)
#: Rows whose shingles are counted for the order, and shingles that the order knows as frequent.
SAMPLE_ROWS, FREQUENT = 5_000, 100_000
#: Parts into which hashes are cut for ``cells``: a power of two.
CELLS = 256


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted XXH64 hashes of the different shingles (A-Z lower-cased, split at ASCII white space)."""
    import xxhash

    listed = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not listed:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    said = {b" ".join(listed[i : i + words]) for i in range(max(1, len(listed) - words + 1))}
    return np.unique(np.fromiter((digest(s, seed=HASH_SEED) for s in said), np.uint64, len(said)).view(np.int64))


def frequent(table: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample (sorted) and how often they do: at most FREQUENT."""
    share = max(1, table.count() // SAMPLE_ROWS)
    rows = table.where(F.pmod(F.xxhash64("_row"), F.lit(share)) == 0).select(F.col(text).cast("string"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words))], ["s"])

    counts = rows.mapInArrow(tidy(listed), "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    known = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = (known.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(s)
    return s[order], n[order]


def prefix(s: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of ``s`` in the common order, as many as similar sets need to share one; ``known`` and ``often`` from ``frequent``."""
    up, down = LEAST
    count = np.zeros(len(s), np.int64)
    if len(known) and len(s):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        count = np.where(known[at] == s, often[at], 0)
    return s[np.lexsort((s, count))[: len(s) - -(-up * len(s) // down) + 1]]


def cells(s: np.ndarray) -> np.ndarray:
    """How many shingles of ``s`` lie in each of CELLS parts of all hashes, 255 at the most."""
    return np.minimum(np.bincount(s & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8)


def enough(shared, x, y):
    """Whether sets of sizes x and y that share so many shingles are similar; of numbers, arrays or columns."""
    up, down = LEAST
    return shared * (up + down) >= (x + y) * up


def with_sets(asked: DataFrame, table: DataFrame, *, text: str, words: int) -> DataFrame:
    """``asked`` (id, said: the ``text_id`` of one of its texts, more) and s, the whole shingle set; the texts are read again from ``table``, each once."""
    texts = table.select(text_id(F.col(text)).alias("said"), F.col(text).cast("string").alias("_t")).join(bounded(asked), "said")
    once = texts.groupBy(*asked.columns).agg(F.first("_t").alias("_t"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in asked.schema) + "s array<long>"

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(t, words) for t in batch.column("_t").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], [*batch.schema.names[:-1], "s"])

    return once.mapInArrow(tidy(seen), schema)
