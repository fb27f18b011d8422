from collections import defaultdict

import numpy as np
import pytest
import xxhash

from scriptorium.llm import simhash
from scriptorium.llm.components import components


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            parent[find(int(j))] = find(i)
    groups = defaultdict(set)
    for i, f in enumerate(fps.tolist()):
        groups[find(i)].add(f)
    return sorted(map(sorted, groups.values()))


def near_copies(n, flips, seed=1):
    rng = np.random.default_rng(seed)
    base, out = int(rng.integers(0, 1 << 62)), set()
    while len(out) < n:
        x = base
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def test_fingerprints(documents):
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(documents).collect()}
    for r in documents.limit(60).collect():
        assert got[r["doc_id"]] == brute_fingerprint(r["text"], 4)


def test_components_of_documents(documents):
    rows = simhash.near_duplicates(documents).collect()
    fps = np.unique(np.array([r["fp"] for r in rows], np.int64).view(np.uint64))
    least = {}
    for group in brute_components(fps, 4):
        own = [r["doc_id"] for r in rows if r["fp"] & (2**64 - 1) in group]
        least |= dict.fromkeys(group, min(own))
    assert all(r["component_id"] == least[r["fp"] & (2**64 - 1)] for r in rows)


@pytest.mark.parametrize("radius, blocks, group_rows", [(4, 6, 2048), (4, 6, 64), (4, 5, 200), (6, 8, 64)])
def test_no_link_is_lost_in_large_groups(spark, radius, blocks, group_rows):
    fps = near_copies(900, 12)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.links(df, radius=radius, blocks=blocks, group_rows=group_rows)).collect()}
    groups = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        groups[root.get(x, x)].add(x & (2**64 - 1))
    assert sorted(map(sorted, groups.values())) == brute_components(fps, radius)


def test_pivots_discard_no_link():
    fps = near_copies(300, 10, seed=3)
    found = simhash.forest(fps, 4)
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert len(found) == len(fps) - len(brute_components(fps, 4))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["fp"] == 0} == {(2, 2), (3, 2), (4, 2), (None, 2)}
    same = [r["component_id"] for r in rows if r["doc_id"] == 1]
    assert same == [1, 1]
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-7, 1, 2, 5, 6]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    assert simhash.keep_one(awkward.limit(0)).count() == 0
