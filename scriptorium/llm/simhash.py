"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits, each the majority over the hashes of all word shingles. Equal
fingerprints are one class from the start, so copies never meet pairwise. Which classes meet is decided by
exact block keys: with radius + k blocks, two fingerprints within the radius agree on k of them. Where
rows meet, each has a table row of Hamming distances to PIVOTS reference fingerprints; by the
triangle inequality a pair whose coordinates differ by more than the radius anywhere is
discarded, and only survivors are compared bit by bit. A group gives a spanning forest of its links, not
all its pairs. Groups over the limit are divided by further keys on the bits left, and what is still
too large meets in blocks, every block against every other: nothing is capped.

``similar_rows`` links texts by Jaccard similarity instead. At 0.8 fingerprints are some ten bits apart, too far for block
keys, so rows meet by the prefixes of their shingle sets (``shingles``), and the pivot tables discard at a wide
radius. So do cells, which count a set's shingles in parts of all hashes: they discard a pair only if they prove that
too few are shared. What is left connects rows to families; a family meets once with its whole sets, which are
compared only where tables and cells leave the pair. As similar sets may lie beyond any radius, what is still apart then meets once more,
and pairs that the pivot tables discard are compared where cells leave them: no similar pair is left out. All that meets gives a spanning forest, never its pairs: large groups are first dealt in
blocks, each row to one, and only rows outside a group's largest component then meet all others.

Defined cases: null and word-less texts have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows and null keys keep one
row each; a component without any non-null key has a null component_id; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import alone, bounded, discard, numbered, small_batches, stored, text_id, tidy
from .shingles import CELLS, HASH_SEED, cells, enough, frequent, prefix, shingles, with_sets

BITS = 64
PIVOTS = 24
#: Fingerprints that may meet in one group before it is divided.
GROUP_ROWS = 2048
#: Bits by which similar sets may differ before the pivot tables discard the pair. Sets of similarity 0.8 differ in 9.5 of 64 bits
#: on average, with a deviation of 2.9. What lies beyond meets again by cells, so this decides on time only.
WIDE = 26
#: Sets of fewer shingles, whose fingerprints vary more, are compared without it.
SMALL_SET = 32
#: Rows with cells up to which they are broadcast: they are some eight times as wide as others.
CELL_ROWS = 60_000
#: Shingles of whole sets that meet in one block of a family.
BLOCK_SHINGLES = 1 << 20


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: bit patterns of a fixed generator."""
    return np.random.default_rng(20240).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % np.uint64(2)


def majority(hashes: np.ndarray) -> int:
    """Bit i is one if it is set in over half the ``hashes``; zero of none."""
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        own = np.ascontiguousarray(hashes[a : a + (1 << 15)])
        total += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """Bit i is one if it is set in over half the shingles' XXH64 (A-Z lower-cased, split at ASCII white space)."""
    import xxhash

    listed = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not listed:
        return 0
    if len(listed) <= words:
        return xxhash.xxh64_intdigest(b" ".join(listed), seed=HASH_SEED)
    joined, digest = b" ".join(listed), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(BITS, np.int64), len(listed) - words + 1
    for a in range(0, n, 1 << 15):
        b = min(n, a + (1 << 15))
        hashes = np.array([digest(joined[x:y], seed=HASH_SEED) for x, y in zip(starts[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist())], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """key, fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["k", "fp"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(tidy(hashed), f"k {kind}, fp long").withColumnRenamed("k", key)


def forest(fps: np.ndarray, radius: int, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``fps`` (unsigned), as pairs of them."""
    if table is None:
        table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    left, found = np.arange(len(fps)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = left
            for p in range(0, table.shape[1], 4):  # discard by the largest coordinate difference
                near = near[np.abs(table[near, p : p + 4] - table[i, p : p + 4]).max(axis=1) <= radius]
                if not len(near):
                    break
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
            if len(near):
                found += [(int(fps[i]), int(fps[j])) for j in near.tolist()]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return found


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def _mask(bits: list[int]) -> int:
    m = reduce(lambda a, b: a | (1 << b), bits, 0)
    return m - (1 << 64) if m >> 63 else m


def _links_in_groups(groups: DataFrame, radius: int) -> DataFrame:
    """groups: fps array<long> -> a, b."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(np.concatenate([[0], ends]))
            table = np.bitwise_count(flat[:, None] ^ refs[None, :]).astype(np.int8)
            two = ends[sizes == 2]
            x, y = two - 2, two - 1
            x, y = (v[np.abs(table[x] - table[y]).max(axis=1) <= radius] for v in (x, y)) if len(two) else (x, y)
            if len(x):
                good = np.bitwise_count(flat[x] ^ flat[y]) <= radius
                x, y = x[good], y[good]
            a, b = flat[x].tolist(), flat[y].tolist()
            for e, n in zip(ends[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for p, q in forest(flat[e - n : e], radius, table[e - n : e]):
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], ["a", "b"])

    return groups.select("fps").mapInArrow(tidy(linked), "a long, b long")


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)


def links(distinct: DataFrame, *, radius: int = 4, blocks: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links a, b among ``distinct`` (column fp, no repeats): they connect what all pairs within the radius connect."""
    blocks = blocks or radius + 2
    parts = _blocks(list(range(BITS)), blocks)
    masks = [_mask(sum(chosen, [])) for chosen in combinations(parts, blocks - radius)]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("which", "key"))
    hot = stored(keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows), "hot-keys")
    if not hot.take(1):
        return _links_in_groups(_grouped(keyed, ["which", "key"]), radius)
    plain = _grouped(keyed.join(hot, ["which", "key"], "left_anti"), ["which", "key"])
    # The bits that a hot key leaves open are cut into radius + 1 blocks, one of which must agree.
    rest = [[b for b in range(BITS) if not (m >> b) & 1] for m in masks]
    finer = [[_mask(x) for x in _blocks(r, radius + 1)] for r in rest]
    chosen = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in finer)), F.col("which") + 1)
    divided = keyed.join(hot.drop("n"), ["which", "key"]).select("which", "key", "fp", F.posexplode(F.transform(chosen, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "finer"))
    keys = ["which", "key", "part", "finer"]
    still = stored(divided.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows), "hot-keys")
    middle = _grouped(divided.join(still, keys, "left_anti"), keys)
    found = _links_in_groups(plain.select("fps").union(middle.select("fps")), radius)
    if still.take(1):
        chunks = F.ceil(F.col("n") / (group_rows // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), chunks)
        met = divided.join(still, keys).withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        found = found.union(_links_in_groups(_grouped(met, [*keys, "low", "high"]), radius))
    return found


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """key, fp, component_id (the smallest key reachable over links, itself included), one row a document."""
    marked = stored(fingerprints(docs, key=key, text=text, words=words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-classes")
    linked = components(stored(links(classes.select("fp"), radius=radius, blocks=blocks), "links"))
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each component of linked fingerprints one row, with all its columns: the one with the least key (null keys last), of such rows the first."""
    rows = numbered(docs)
    found = near_duplicates(rows, key="_row", text=text, **options).select("_row", "component_id")
    keyed = stored(found.join(rows.select("_row", F.col(key).alias("k")), "_row"), "near-duplicates")
    best = keyed.groupBy("component_id").agg(F.min(F.struct(F.col("k").isNull(), "k", "_row"))["_row"].alias("best"))
    gone = stored(keyed.join(best, "component_id").where("_row <> best").select("_row"), "gone")
    return rows.join(bounded(gone), "_row", "left_anti").select(docs.columns)


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """rows: _row, k, said, t -> _row, k, said, same (digest of the different shingles), n (how many there are), fp (their fingerprint), cells, prefix; stored."""
    import xxhash

    known, often = frequent(rows, "t", words)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(3).to_pylist()]
            fps = np.array([majority(s.view(np.uint64)) for s in sets], np.uint64)
            columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps.view(np.int64))]
            columns += [pa.array([cells(s).tobytes() for s in sets], pa.binary()), pa.array([prefix(s, known, often) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["_row", "k", "said", "same", "n", "fp", "cells", "prefix"])

    kind = rows.schema["k"].dataType.simpleString()
    return stored(rows.select("_row", "k", "said", "t").mapInArrow(tidy(seen), f"_row long, k {kind}, said binary, same binary, n int, fp long, cells binary, prefix array<long>"), "shingle-prefixes")


def _close(i, left: np.ndarray, n: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Those of ``left`` that the pivot tables leave for row i and whose set sizes allow a link."""
    j = left[enough(np.minimum(n[left], n[i]), n[left], n[i])]
    if n[i] < SMALL_SET:
        return j
    near = np.abs(table[j] - table[i]).max(axis=1) <= WIDE
    near &= np.bitwise_count(fps[j] ^ fps[i]) <= WIDE
    return j[near | (n[j] < SMALL_SET)]


def _possible(i, left: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of ``left`` that cells don't prove unlike row i: sets differ in as many shingles at least as their cells do."""
    j = left[enough(np.minimum(n[left], n[i]), n[left], n[i])]
    apart = np.abs(counts[j] - counts[i]).sum(axis=1)
    return j[enough((n[j] + n[i] - apart) // 2, n[j], n[i])]


def similar_forest(n: np.ndarray, fps: np.ndarray, root: np.ndarray, shared=None, counts: np.ndarray | None = None, beyond: bool = False) -> list[tuple[int, int]]:
    """A spanning forest (places) of what links rows of different roots; rows of one root are connected from the start.

    ``shared(i, j)``: how many shingles set i has in common with each of the sets j. Without it all that the pivot tables leave is linked.
    ``counts``: cells of the sets (signed), by which pairs are discarded, too. ``beyond``: only pairs that the pivot tables discard are looked at.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    left, found = np.arange(len(n)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            own = root[left] == root[i]
            if own.any():
                queue += left[own].tolist()
                left = left[~own]
            j = _close(i, left, n, fps, table)
            if beyond:
                j = np.setdiff1d(left, j, assume_unique=True)
            if counts is not None and len(j):
                j = _possible(i, j, n, counts)
            if shared is not None and len(j):
                j = j[enough(shared(i, j), n[j], n[i])]
            if len(j):
                found += [(i, x) for x in j.tolist()]
                queue += j.tolist()
                left = np.setdiff1d(left, j, assume_unique=True)
    return found


def shared_counts(sets: list[np.ndarray]):
    """``shared`` of ``similar_forest`` for sets none of which is empty."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(codes), bool)

    def shared(i: int, j: np.ndarray) -> np.ndarray:
        own = codes[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        starts = np.cumsum(sizes[j]) - sizes[j]
        at = np.repeat(ends[j] - sizes[j] - starts, sizes[j]) + np.arange(sizes[j].sum())
        count = np.add.reduceat(mark[codes[at]], starts, dtype=np.int64)
        mark[own] = False
        return count

    return shared


def _close_links(rows: DataFrame, keys: list[str], beyond: bool) -> DataFrame:
    """rows: keys, id, fp, n, root, cells -> a, b: forests of the pairs that are left to compare in each group of equal keys."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, a, b = batch.column(0), [], []
            *plain, counts = lists.flatten().flatten()
            ids, fps, n, root = (c.to_numpy(zero_copy_only=False) for c in plain)
            fps, sizes = fps.view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)
            counts = np.frombuffer(b"".join(counts.to_pylist()), np.uint8).reshape(-1, CELLS)
            for e, k in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                at = slice(e - k, e)
                for i, j in similar_forest(n[at], fps[at], root[at], counts=counts[at].astype(np.int16), beyond=beyond):
                    a.append(ids[e - k + i])
                    b.append(ids[e - k + j])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b)], ["a", "b"])

    groups = rows.groupBy(*keys).agg(F.collect_list(F.struct("id", "fp", "n", "root", "cells")).alias("rows")).where(F.size("rows") > 1)
    return groups.select("rows").mapInArrow(tidy(linked), "a long, b long").distinct()


def _set_links(rows: DataFrame, keys: list[str], beyond: bool) -> DataFrame:
    """rows: keys, id, fp, n, root, s -> a, b: forests of the pairs whose whole sets are similar, in each group of equal keys."""

    def linked(group: pa.Table) -> pa.Table:
        ids, fps, n, root = (group.column(c).to_numpy() for c in ("id", "fp", "n", "root"))
        sets = np.split(group.column("s").combine_chunks().flatten().to_numpy(), np.cumsum(n.astype(np.int64))[:-1])
        counts = np.array([cells(s) for s in sets], np.int16)
        found = similar_forest(n, fps.view(np.uint64), root, shared_counts(sets), counts, beyond) if len(ids) > 1 else []
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": ids[a], "b": ids[b]})

    return rows.select(*keys, "id", "fp", "n", "root", "s").groupBy(*keys).applyInArrow(linked, "a long, b long")


def _rest(rows: DataFrame, limit: int) -> DataFrame:
    """rows: s, id, root, weight, more -> the rows in blocks (s, x, y) in which every two rows of different roots under one s meet.

    Rows of the s's largest root meet only those of other roots, so that few of these make few blocks.
    """
    weights = rows.groupBy("s", "root").agg(F.sum("weight").alias("w"))
    keys = stored(weights.groupBy("s").agg(F.sum("w").alias("all"), F.max("w").alias("most"), F.max_by("root", "w").alias("main")).where("all > most"), "rest-keys")
    parts = lambda w: F.ceil(w / max(1, limit // 2)).cast("int")
    met = rows.join(bounded(keys), "s").withColumn("xs", parts(F.col("all") - F.col("most"))).withColumn("ys", parts(F.col("all")))
    own = lambda n: F.pmod(F.xxhash64("id", "s"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    any_root = met.withColumn("x", every("xs")).withColumn("y", own("ys"))
    others = met.where("root <> main").withColumn("x", own("xs")).withColumn("y", every("ys"))
    return any_root.unionByName(others).drop("all", "most", "main", "xs", "ys")


def similar_rows(table: DataFrame, *, text: str = "text", words: int = 5, group_rows: int = GROUP_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """_row, root (the same for rows that similarity of ``LEAST`` or more links, directly or over others); ``table`` from ``numbered``."""
    return _similar(table, F.col("_row"), F.lit(0), text, words, group_rows, block_shingles).select("_row", "root")


def _families(postings: DataFrame, group_rows: int, beyond: bool = False) -> DataFrame:
    """postings: s, id, n, fp, cells, size (rows with s) -> node, root: rows that the pairs left to compare connect; stored."""
    block = F.pmod(F.xxhash64("id", "s"), F.ceil(F.col("size") / group_rows))
    found = stored(_close_links(postings.withColumn("block", block).withColumn("root", F.col("id")), ["s", "block"], beyond), "close-links")
    families = stored(components(found), "families")
    large = postings.where(F.col("size") > group_rows)
    if large.take(1):
        rooted = large.join(bounded(families.withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
        more = _close_links(_rest(rooted.withColumn("weight", F.lit(1)), group_rows), ["s", "x", "y"], beyond)
        families = stored(components(stored(found.union(more), "close-links")), "families")
    return families


def _links_in_families(members: DataFrame, postings: DataFrame, table: DataFrame, text: str, words: int, block_shingles: int, before: DataFrame | None = None) -> DataFrame:
    """members: id, family, said, n, fp, root -> a, b: links that connect what all links of similar sets connect; stored.

    Of pairs that the pivot tables leave, or with ``before`` (the links that gave the roots) of those that they discard.
    """
    beyond = before is not None
    weights = members.groupBy("family").agg(F.sum(F.col("n").cast("long")).alias("total"))
    blocks = F.ceil(F.col("total") / block_shingles)
    # A large family is dealt twice, so that blocks of one deal are connected by those of the other.
    deals = F.when(blocks > 1, F.array(F.pmod(F.xxhash64("id"), blocks), F.pmod(F.xxhash64("id", F.lit(1)), blocks) + blocks)).otherwise(F.array(F.lit(0).cast("long")))
    dealt = stored(members.join(bounded(weights), "family").withColumn("block", F.explode(deals)).withColumn("large", blocks > 1).drop("total"), "families-dealt")
    found = stored(_set_links(with_sets(dealt, table, text=text, words=words), ["family", "block"], beyond), "set-links")
    large = dealt.where("large").drop("root", "block", "family", "large").distinct()
    if not large.take(1):
        return found
    # Links have a prefix's shingle in common: what blocks leave apart in a large family meets by these, not all with all.
    linked = found.union(before) if beyond else found
    rooted = large.join(bounded(components(linked).withColumnRenamed("node", "id")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    met = stored(_rest(postings.select("s", "id").join(rooted.withColumn("weight", F.col("n").cast("long")), "id").select("s", "id", "root", "weight"), block_shingles), "rest-blocks").drop("weight", "root")
    asked = stored(rooted.join(bounded(met.select("id").distinct()), "id", "left_semi"), "rest-asked")
    sets = with_sets(asked, table, text=text, words=words)
    more = _set_links(met.withColumnRenamed("s", "key").join(sets, "id"), ["key", "x", "y"], beyond)
    return stored(found.union(more), "set-links")


def _links_left(links: DataFrame, classes: DataFrame, marks: DataFrame, postings: DataFrame, table: DataFrame, text: str, words: int, group_rows: int, block_shingles: int) -> DataFrame:
    """``links`` and those of similar sets that the pivot tables discard: rows of different roots under one shingle meet again."""
    rooted = stored(components(links).withColumnRenamed("node", "id"), "roots")
    root = F.coalesce("root", "id")
    several = lambda rows, key: rows.groupBy(key).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select(key)
    left = postings.join(bounded(rooted), "id", "left").withColumn("root", root)
    left = stored(left.join(bounded(stored(several(left, "s"), "shingles-left")), "s").drop("root"), "postings-left")
    if not left.take(1):
        return links
    families = _families(left.join(bounded(marks, CELL_ROWS), "id"), group_rows, beyond=True)
    members = classes.join(bounded(families.select(F.col("node").alias("id"), F.col("root").alias("family"))), "id")
    members = members.join(bounded(rooted), "id", "left").withColumn("root", root)
    members = stored(members.join(bounded(several(members, "family")), "family", "left_semi"), "members-left")
    if not members.take(1):
        return links
    return links.union(_links_in_families(members, left, table, text, words, block_shingles, links))


def _similar(table: DataFrame, row: Column, key: Column, text: str, words: int, group_rows: int, block_shingles: int) -> DataFrame:
    """_row, k (the key), said (``text_id``), root."""
    small_batches(table.sparkSession)
    marked = _marked(table.select(row.alias("_row"), key.alias("k"), text_id(F.col(text)).alias("said"), F.col(text).cast("string").alias("t")), words)
    classes = stored(marked.groupBy("same").agg(F.min(F.struct("_row", "said", "n", "fp")).alias("first")).select("same", F.col("first._row").alias("id"), "first.said", "first.n", "first.fp"), "shingle-classes")
    own = marked.withColumnRenamed("_row", "id").join(bounded(classes.select("id")), "id", "left_semi")
    postings = own.select("id", F.explode("prefix").alias("s"))
    met = stored(postings.groupBy("s").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shingle-meetings")
    every = stored(postings.join(bounded(met), "s"), "shingle-postings")
    # Of shingles that the same rows have, one will do.
    held = [F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    groups = stored(every.groupBy("s", "size").agg(*held).groupBy("size", "low", "high", "x", "y").agg(F.min("s").alias("s")).select("s"), "shingle-groups")
    postings = stored(every.join(bounded(groups), "s"), "shingle-postings")
    discard(every)
    sets = classes.drop("same")
    marks = stored(own.select("id", "n", "fp", "cells").join(bounded(postings.select("id").distinct()), "id", "left_semi"), "shingle-cells")
    cell_rows = max(2, group_rows // 4)  # rows with cells are wide
    families = _families(postings.join(bounded(marks, CELL_ROWS), "id"), cell_rows)
    members = sets.join(bounded(families.select(F.col("node").alias("id"), F.col("root").alias("family"))), "id").withColumn("root", F.col("id"))
    links = _links_in_families(members, postings, table, text, words, block_shingles)
    links = _links_left(links, sets, marks, postings, table, text, words, cell_rows, block_shingles)
    for made in (met, groups, postings):
        discard(made)
    named = classes.select("same", "id").join(components(links).withColumnRenamed("node", "id"), "id", "left").select("same", F.coalesce("root", "id").alias("root"))
    return marked.select("_row", "k", "said", "same").join(named, "same").select("_row", "k", "said", "root")


def keep_dissimilar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, group_rows: int = GROUP_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Of each component of similar texts one row, with all its columns, chosen as ``keep_one`` does; of rows that share key and text, any one.

    Rows go by their key and text, so no copy of ``docs`` is stored.
    """

    def judged() -> DataFrame:
        keyed = stored(_similar(docs, F.monotonically_increasing_id(), F.col(key), text, words, group_rows, block_shingles), "near-duplicates")
        best = keyed.groupBy("root").agg(F.min(F.struct(F.col("k").isNull(), "k", "_row", "said")).alias("best"))
        repeat = F.col("k").eqNullSafe(F.col("best.k")) & (F.col("said") == F.col("best.said"))
        return keyed.join(best, "root").where("_row <> best._row").select("k", "said", repeat.alias("repeat")).distinct()

    others = alone(docs.sparkSession, judged, "others")
    gone, repeats = others.where("not repeat"), others.where("repeat")
    own = text_id(docs[text])
    kept = docs.join(bounded(gone), (own == gone["said"]) & docs[key].eqNullSafe(gone["k"]), "left_anti")
    if not repeats.take(1):
        return kept
    same = (own == repeats["said"]) & docs[key].eqNullSafe(repeats["k"])
    mark = "said" + "_" * max(map(len, docs.columns))  # no column's name
    once = kept.join(bounded(repeats), same, "left_semi").withColumn(mark, text_id(F.col(text))).dropDuplicates([key, mark]).drop(mark)
    return kept.join(bounded(repeats), same, "left_anti").union(once)


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
