"""Approximate nearest neighbours by largest inner product: vantage-point trees in shards.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm:
then the nearest vector has the largest product. The upper levels of one tree, whose vantage points and medians come from a
bounded sample (SAMPLE_ROWS), deal all vectors to shards; each shard has a tree of its own over all its vectors: a
node's vectors are split at the median distance to its vantage point, and each half keeps the range of
these distances. A query's distance to a shard or leaf is at least its largest gap to a range on the way
(triangle inequality); it is skipped if that bound times ``factor`` exceeds the distance of the k-th neighbour
so far. Factor one is exact search; larger factors skip more. Where none is given, it is the largest at which the sample's
own search still finds RECALL of the neighbours.

Queries go to their own shard first, then to the next few, then to all that the bound leaves; from each only what is nearer
than the k-th so far comes back. A shard that copies of a vector make long is cut into parts, each with a tree.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part;
vectors of different lengths are searched apart; a row with the query's id is the query's own and no
candidate; every query row gets its own neighbours, so a repeated one gets them again; repeated rows under another id are
candidates, ties go to the smaller id; fewer candidates than k are all returned; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import hashed_sample, stored, tidy

SHARD_ROWS = 8_192
#: Shards at most: beyond, they get longer. It bounds the upper levels, which every task holds.
MAX_SHARDS = 4_096
QUERY_ROWS = 8_192
LEAF_ROWS = 64
#: Vectors of a length that the upper levels are made from, and share of them that the factor must find.
SAMPLE_ROWS, RECALL = 16_384, 0.97
FACTORS = (1.0, 1.15, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)
#: Vectors and queries of the sample on which factors are tried.
TRIAL_ROWS, TRIAL_QUERIES = 4_096, 200
#: Leaves a query reads before any may be skipped.
FIRST_LEAVES = 4
#: Vantage points tried at a node: the one whose distances spread most is taken.
CANDIDATES, SPREAD_ROWS = 4, 256
_SLACK = 1e-7


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """With the coordinate that makes all norms equal."""
    rest = np.sqrt(np.maximum(largest * largest - (vectors * vectors).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


def _distances(squares: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    d2 = squares[:, None] + (points * points).sum(axis=1)[None, :] - 2 * vectors @ points.T
    return np.sqrt(np.maximum(d2, 0))


def vantage_point(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few points the one to which a sample's distances spread most."""
    tried = points[rng.integers(len(points), size=CANDIDATES)]
    own = points if len(points) <= SPREAD_ROWS else points[rng.integers(len(points), size=SPREAD_ROWS)]
    return tried[_distances((own * own).sum(axis=1), own, tried).std(axis=0).argmax()]


class Router:
    """Upper levels of a tree: a complete binary one, its leaves the shards."""

    def __init__(self, sample: np.ndarray, largest: float, shards: int):
        self.levels, self.largest = max(0, int(np.ceil(np.log2(max(1, shards))))), largest
        self.shards = 1 << self.levels
        points, rng = lifted(sample, largest), np.random.default_rng(len(sample))
        self.points, self.medians = np.zeros((self.shards - 1, points.shape[1])), np.zeros(self.shards - 1)
        held = {0: points}
        for node in range(self.shards - 1):
            own = held.pop(node)
            if len(own):
                self.points[node] = vantage_point(own, rng)
                d = _distances((own * own).sum(axis=1), own, self.points[node : node + 1])[:, 0]
                self.medians[node] = np.median(d)
                held[2 * node + 1], held[2 * node + 2] = own[d <= self.medians[node]], own[d > self.medians[node]]
            else:
                held[2 * node + 1] = held[2 * node + 2] = own

    def shard_of(self, vectors: np.ndarray) -> np.ndarray:
        points, node = lifted(vectors, self.largest), np.zeros(len(vectors), np.int64)
        for _ in range(self.levels):
            d = np.sqrt(np.maximum(((points - self.points[node]) ** 2).sum(axis=1), 0))
            node = 2 * node + 1 + (d > self.medians[node])
        return node - (self.shards - 1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each shard."""
        out = np.zeros((len(queries), 1))
        d = _distances((queries * queries).sum(axis=1), np.hstack([queries, np.zeros((len(queries), 1))]), self.points)
        for level in range(self.levels):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            gap = d[:, nodes] - self.medians[nodes]
            out = np.stack([np.maximum(out, gap), np.maximum(out, -gap)], axis=2).reshape(len(queries), -1)
        return np.maximum(out, 0)


class Tree:
    """Arrays of one shard: rows in leaf order, vantage points, and for each leaf its way."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        points = lifted(vectors, largest)
        rng = np.random.default_rng(len(ids))
        order, self.leaves, vantage = np.arange(len(ids)), [], []
        self.ways: list[list[tuple[int, float, float]]] = []
        open_ = [(0, len(ids), [])]
        while open_:
            a, b, way = open_.pop()
            if b - a <= LEAF_ROWS:
                self.leaves.append((a, b))
                self.ways.append(way)
                continue
            own = order[a:b]
            point = vantage_point(points[own], rng)
            d = np.sqrt(((points[own] - point) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            order[a:b], d = own[by], d[by]
            middle, n = (b - a) // 2, len(vantage)
            vantage.append(point)
            open_.append((a + middle, b, [*way, (n, d[middle], d[-1])]))
            open_.append((a, a + middle, [*way, (n, d[0], d[middle - 1])]))
        self.ids, self.vectors = ids[order], vectors[order]
        self.vantage = np.array(vantage).reshape(len(vantage), points.shape[1])
        self.largest = largest
        #: Leaves that searches have read, and that there were.
        self.read = self.there = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not len(self.vantage):
            return out
        d = _distances((queries * queries).sum(axis=1), np.hstack([queries, np.zeros((len(queries), 1))]), self.vantage)
        for leaf, way in enumerate(self.ways):
            for n, low, high in way:
                np.maximum(out[:, leaf], np.maximum(low - d[:, n], d[:, n] - high), out=out[:, leaf])
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query number, id and product of the k best of each query, its own id left out; ``known``: products of the k-th best found elsewhere."""
        bounds = self.bounds(queries)
        square = (queries * queries).sum(axis=1) + self.largest**2
        worst = np.full(len(queries), -np.inf) if known is None else known.copy()  # product of the k-th best so far
        q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        held: list[tuple] = []

        def settle() -> None:
            nonlocal q, v, s
            q, v, s = (np.concatenate([x, *y]) for x, y in zip((q, v, s), zip(*held))) if held else (q, v, s)
            held.clear()
            by = np.lexsort((v, -s, q))
            q, v, s = q[by], v[by], s[by]
            first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, int)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            last = rank == k - 1
            worst[q[last]] = np.maximum(worst[q[last]], s[last])
            q, v, s = q[rank < k], v[rank < k], s[rank < k]

        def visit(leaf: int, who: np.ndarray) -> None:
            a, b = self.leaves[leaf]
            product = queries[who] @ self.vectors[a:b].T
            good = (product >= worst[who][:, None] - _SLACK) & (self.ids[None, a:b] != query_ids[who][:, None])
            i, j = np.nonzero(good)
            self.read += len(who)
            # Summed row by row: equal vectors get equal products wherever they lie.
            held.append((who[i], self.ids[a:b][j], (queries[who[i]] * self.vectors[a:b][j]).sum(axis=1)))

        n = len(self.leaves)
        self.there += n * len(queries)
        first = np.argpartition(bounds, min(FIRST_LEAVES, n) - 1, axis=1)[:, :FIRST_LEAVES]
        seen = np.zeros(bounds.shape, bool)
        np.put_along_axis(seen, first, True, axis=1)
        for leaf in range(n):
            if len(who := np.flatnonzero(seen[:, leaf])):
                visit(leaf, who)
        settle()
        for count, leaf in enumerate(np.argsort(bounds.min(axis=0))):
            reach = np.where(np.isfinite(worst), np.sqrt(np.maximum(square - 2 * worst, 0)), np.inf)
            who = np.flatnonzero(~seen[:, leaf] & (bounds[:, leaf] * factor <= reach + _SLACK))
            if len(who):
                visit(int(leaf), who)
            if count % 16 == 15 or sum(len(x[0]) for x in held) > 1_000_000:
                settle()
        settle()
        return q, v, s


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    numbers = F.coalesce(vector, F.array().cast("array<double>"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return ~bad & F.exists(numbers, lambda x: x != 0)


def calibrated(sample: np.ndarray, largest: float, k: int) -> float:
    """The largest of FACTORS at which a tree over a part of ``sample`` finds RECALL of the k nearest."""
    part = sample[:TRIAL_ROWS]
    ids, queries = np.arange(len(part)), part[:TRIAL_QUERIES]
    tree = Tree(ids, part, largest)
    pairs = lambda factor: {(a, b) for a, b, _ in zip(*(x.tolist() for x in tree.search(ids[: len(queries)], queries, k, factor)))}
    right, best = pairs(1.0), 1.0
    for factor in FACTORS:
        if len(right & pairs(factor)) >= RECALL * len(right):
            best = factor
        else:
            break
    return best


@contextmanager
def _arrow_rows(spark: SparkSession, rows: int):
    """Rows an Arrow batch while an action runs; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _flat(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """One row a group: the given columns as arrays, and vectors, all in one array."""
    packed = rows.groupBy(*by).agg(F.collect_list(F.struct(*columns, "vector")).alias("rows"))
    return packed.select(*by, *(F.col(f"rows.{c}").alias(f"{c}s") for c in columns), F.flatten("rows.vector").alias("vectors"))


def _matrix(batch: pa.RecordBatch, name: str, i: int, dim: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy().reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float | None = None) -> DataFrame:
    """query_id, rank, id, score: the k nearest of ``vectors`` that the search finds for each of ``queries``.

    The lengths that occur are a handful, and each has its own sample, factor and shards. A part of a shard holds SHARD_ROWS
    vectors, about, and is one task's memory.
    """

    def rows(df: DataFrame) -> DataFrame:
        good = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
        return good.withColumn("dim", F.size("vector"))

    spark, every = vectors.sparkSession, rows(vectors)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    routers, factors = {}, {}
    for r in every.groupBy("dim").agg(F.max(norm).alias("largest"), F.count(F.lit(1)).alias("n")).collect():
        table = hashed_sample(every.where(F.col("dim") == r["dim"]), SAMPLE_ROWS, "id", "vector").select("vector").toArrow()
        sample = np.array(table.column(0).combine_chunks().values.to_numpy()).reshape(-1, r["dim"])
        routers[r["dim"]] = Router(sample, r["largest"], min(MAX_SHARDS, -(-r["n"] // SHARD_ROWS)))
        factors[r["dim"]] = factor or calibrated(sample, r["largest"], k)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                shard = routers[dim].shard_of(own.column("vector").flatten().to_numpy().reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shard.astype(np.int32))], [*own.schema.names, "shard"])

    dealt = stored(every.mapInArrow(tidy(deal), "id long, vector array<double>, dim int, shard int").withColumn("row", F.monotonically_increasing_id()), "dealt-vectors")
    parts = dealt.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD_ROWS)).alias("parts"))
    cut = dealt.join(F.broadcast(parts), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    shards = stored(_flat(cut, ["dim", "shard", "part"], "id"), "shards")
    asked = stored(rows(queries).withColumn("q", F.monotonically_increasing_id()), "queries")
    asked = asked.where(F.col("dim").isin(*routers)) if routers else asked.limit(0)

    def route(first: int, last: int):
        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column("dim").to_numpy()
                for dim in np.unique(lengths).tolist():
                    own = batch.filter(pa.array(lengths == dim))
                    x = own.column("vector").flatten().to_numpy().reshape(-1, dim)
                    bounds, worst = routers[dim].bounds(x), own.column("worst").to_numpy()
                    reach = np.sqrt(np.maximum((x * x).sum(axis=1) + routers[dim].largest ** 2 - 2 * worst, 0))
                    order = np.argsort(bounds, axis=1, kind="stable")[:, first:last]
                    near = np.take_along_axis(bounds, order, axis=1) * factors[dim] <= reach[:, None] + _SLACK
                    i, j = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(i)).columns, pa.array(order[i, j].astype(np.int32))], [*own.schema.names, "shard"])

        return routed

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                which = dim, *_ = tuple(batch.column(c)[i].as_py() for c in ("dim", "shard", "part"))
                if held is None or held[0] != which:
                    held = which, Tree(batch.column("ids")[i].values.to_numpy(), _matrix(batch, "vectors", i, dim), routers[dim].largest)
                number, ids, worst = (batch.column(c)[i].values.to_numpy() for c in ("qs", "query_ids", "worsts"))
                q, v, s = held[1].search(ids, _matrix(batch, "query_vectors", i, dim), k, factors[dim], worst)
                yield pa.RecordBatch.from_arrays([pa.array(number[q]), pa.array(ids[q]), pa.array(v), pa.array(s)], ["q", "query_id", "id", "score"])

    by, best = ["dim", "shard"], Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = spark.createDataFrame([], "q long, query_id long, id long, score double")
    most = max((r.shards for r in routers.values()), default=1)
    cuts = sorted({0, 1, min(most, 1 + int(np.ceil(np.sqrt(most)))), most})
    for first, last in zip(cuts, cuts[1:]):
        kth = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("worst"))
        known = asked.join(kth, "q", "left").select("q", "id", "dim", "vector", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        sent = known.mapInArrow(tidy(route(first, last)), "q long, id long, dim int, vector array<double>, worst double, shard int")
        sent = stored(sent, "routed-queries")
        blocks = sent.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("blocks"))
        grouped = _flat(sent.join(F.broadcast(blocks), by).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks"))), [*by, "block"], "q", "id", "worst")
        meet = shards.join(grouped.select(*by, "qs", F.col("ids").alias("query_ids"), "worsts", F.col("vectors").alias("query_vectors")), by)
        # A shard's meetings are dealt to one task, which builds its tree once.
        with _arrow_rows(spark, 1):
            more = stored(meet.sortWithinPartitions("dim", "shard", "part").mapInArrow(tidy(find), "q long, query_id long, id long, score double"), "neighbours")
        found = stored(found.union(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "nearest")
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "id", "score")


def nearest_table(vectors: DataFrame, *, key: str = "vec_id", every: int = 20, **options) -> DataFrame:
    """``op8``: neighbours of the rows whose id is divisible by ``every``."""
    found = nearest(vectors, vectors.where(F.col(key) % every == 0), key=key, **options)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")
