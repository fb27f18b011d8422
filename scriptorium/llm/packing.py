"""Packing by column generation for the cutting-stock problem.

Every document's ids are cut at multiples of the capacity; what remains is one shorter piece.
Pieces fall into size classes (length in grains, rounded up). The driver sees only the
histogram of the classes, at most capacity / grain numbers whatever the corpus. A linear
program over patterns (how many pieces of which classes share a sequence) is solved by column
generation: a knapsack dynamic program prices the columns. Pattern counts are rounded down,
what is left over goes first-fit decreasing into single patterns, and each class's pieces, ranked in
scan order, take the patterns' slots.

Defined cases: null and empty texts are one piece that holds the end id; repeated rows and
repeated or null keys are separate documents; no rows give no sequences; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import MEMO_WORDS, bounded, small_batches, stored, tidy
from .tokens import crc32_u32, default_tokenizer, encoder

CAPACITY = 2048
GRAIN = 8
#: Relative distance to the linear program's bound at which column generation stops.
TOLERANCE = 1e-4
MAX_COLUMNS = 1500


class Pattern(NamedTuple):
    """``count`` sequences of ``items``: size class -> pieces of it in one sequence."""

    count: int
    items: dict[int, int]


def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best unbounded filling of ``room``: its value and how many of each."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if fits:
            worth = best[c - sizes[:fits]] + values[:fits]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], choice[c] = worth[k], k
    amounts, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            amounts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), amounts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchange: a few hundred rows need no threads of a linear algebra library on the driver."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(work[k:, k]).argmax())
        if top != k:
            work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        others = np.flatnonzero(work[:, k])
        others = others[others != k]
        work[others] -= work[others, k, None] * work[k]
    return work[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def _first_columns(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """A feasible basis: the largest class left, filled up as far as possible, until a class is used up."""
    left, columns = demand.copy(), np.zeros((len(sizes), len(sizes)))
    open_ = np.ones(len(sizes), bool)
    for j in range(len(sizes)):
        top = int(np.flatnonzero(open_)[-1])
        rest = np.flatnonzero(open_[:top])
        column = np.zeros(len(sizes))
        if j % 2 or not len(rest):
            column[top] = room // sizes[top]
        else:
            column[top] = 1
        if len(rest):
            free = int(room - column[top] * sizes[top])
            column[rest] = _knapsack(sizes[rest] * (1 + sizes[rest] / room / 1000), sizes[rest], free)[1]
        used = column > 0
        ratio = np.where(used, left / np.where(used, column, 1), np.inf)
        done = int(ratio.argmin())
        left = np.maximum(left - column * ratio[done], 0)
        columns[:, j] = column
        open_[done] = False
    return columns


def solve_patterns(histogram: dict[int, int], room: int) -> list[Pattern]:
    """Patterns that hold every piece of ``histogram`` (size class -> pieces) in few sequences."""
    sizes = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(c)] for c in sizes], float)
    basis = _first_columns(sizes, demand, room)
    inverse = _inverse(basis)
    amount = np.maximum(_times(inverse, demand), 0)
    volume = (demand * sizes).sum() / room
    centre, bound = sizes / room, volume
    for step in range(MAX_COLUMNS):
        if amount.sum() <= bound * (1 + TOLERANCE):
            break
        dual = inverse.sum(axis=0)
        # Prices half-way to those of the best bound so far swing less from column to column.
        price = np.maximum((dual + centre) / 2, 0)
        worth, column = _knapsack(price, sizes, room)
        if (price * demand).sum() / worth > bound:
            bound, centre = (price * demand).sum() / worth, price / worth
        if (dual * column).sum() <= 1 + 1e-9:
            worth, column = _knapsack(dual, sizes, room)
            if worth <= 1 + 1e-9:
                break
        change = _times(inverse, column)
        positive = change > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, amount / np.where(positive, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        if step % 64 == 63:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / change[out]
            inverse -= change[:, None] * row
            inverse[out] = row
        amount = np.maximum(_times(inverse, demand), 0)
    counts = np.floor(amount + 1e-7).astype(np.int64)
    left, found = demand.astype(np.int64), []
    for j in np.argsort(-counts):
        items = basis[:, j].round().astype(np.int64)
        used = items > 0
        n = min(int(counts[j]), int((left[used] // items[used]).min()))
        if n > 0:
            left[used] -= items[used] * n
            found.append(Pattern(n, {int(c): int(a) for c, a in zip(sizes[used], items[used])}))
    return found + _first_fit(sizes, left, room)


def _first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[Pattern]:
    """The pieces that rounding leaves over: their number doesn't depend on the corpus."""
    open_: list[list] = []  # [free, items]
    for c, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            place = next((p for p in open_ if p[0] >= c), None)
            if place is None:
                open_.append(place := [room, {}])
            place[0] -= c
            place[1][c] = place[1].get(c, 0) + 1
    return [Pattern(1, items) for _, items in open_]


def token_pieces(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Encode and cut: key, start, length, doc_tokens, ids_crc32, ids (little-endian unsigned 32-bit, if wanted), and
    size_class, part and part_rank, the piece's place among its class in its task.

    ``memo_words`` bounds the words that a worker remembers; under MEMO_WORDS it forgets them after each task, for workers that
    have other stages' work to do. It changes speed and memory, never a result.
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, end_id, memo_words), {}
        for batch in batches:
            row, start, length, total, crc, ids, size, rank = [], [], [], [], [], [], [], []
            for i, packed in enumerate(enc.encode(batch.column(1).to_pylist())):
                width = enc.dtype.itemsize
                n = len(packed) // width
                for a in range(0, n, capacity):
                    own = min(capacity, n - a)
                    c = -(-own // grain)
                    row.append(i)
                    start.append(a)
                    length.append(own)
                    total.append(n)
                    piece = packed[width * a : width * (a + own)]
                    crc.append(crc32_u32(piece, enc.dtype))
                    if with_ids:
                        ids.append(enc.wide(piece))
                    size.append(c)
                    rank.append(seen.get(c, 0))
                    seen[c] = rank[-1] + 1
            columns = [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc)), pa.array(size, pa.int32()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank, pa.int64())]
            names = ["k", "start", "length", "doc_tokens", "ids_crc32", "size_class", "part", "part_rank"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)
        if memo_words < MEMO_WORDS:
            enc.forget()

    made = rows.mapInArrow(tidy(cut), f"k {kind}, start long, length long, doc_tokens long, ids_crc32 long, size_class int, part int, part_rank long" + ", ids binary" * with_ids)
    # Written once: ranks refer to the tasks that made them.
    return stored(made.withColumnRenamed("k", key), "pieces")


def assign(pieces: DataFrame, *, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Give each piece of ``token_pieces`` its sequence_id and its offset there.

    Only the columns that ``pieces`` brings along are shuffled, once: leave the ids out where a digest
    or a later join by key and start will do.
    """
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("part", "size_class").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["size_class"]: r["n"] for r in counts.groupBy("size_class").agg(F.sum("n").alias("n")).collect()}
    slots, next_rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern in solve_patterns(histogram, capacity // grain):
        slot = 0
        for c, a in sorted(pattern.items.items(), reverse=True):
            slots.append((c, next_rank[c], next_rank[c] + a * pattern.count, sequence, a, slot))
            next_rank[c] += a * pattern.count
            slot += a
        sequence += pattern.count
    slots = spark.createDataFrame(slots, "size_class int, rank_from long, rank_to long, first_sequence long, per_sequence int, first_slot int")
    earlier = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "size_class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bounded(bases), ["part", "size_class"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    within = F.col("rank") - F.col("rank_from")
    # The slots are a few rows for each size class, whatever the corpus.
    placed = (
        ranked.join(F.broadcast(slots.withColumnRenamed("size_class", "c")), (F.col("size_class") == F.col("c")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(within / F.col("per_sequence")))
        .withColumn("slot", F.col("first_slot") + within % F.col("per_sequence"))
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    gone = {"base", "part_rank", "part", "rank", "c", "rank_from", "rank_to", "first_sequence", "per_sequence", "first_slot", "slot", "size_class"}
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop(*gone)


def sequences(assigned: DataFrame, *, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens, ids (binary, padded to the capacity unless the length is a power of two)."""
    packed = assigned.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    joined = F.aggregate("pieces", F.expr("cast('' as binary)"), lambda a, p: F.concat(a, p["ids"]))
    pad = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(capacity) - F.col("n_tokens")).cast("int")
    filler = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), pad))
    return packed.select("sequence_id", "n_tokens", F.concat(joined, filler).alias("ids"))


def packed_table(docs: DataFrame, **options) -> DataFrame:
    """``op4``: per piece its place, with the digest of its ids."""
    pieces = token_pieces(docs, with_ids=False, **options)
    return assign(pieces).select(options.get("key", "doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
