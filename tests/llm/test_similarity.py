import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from scriptorium.llm import shingles, simhash


def brute_kept(rows, least=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and sets[i]:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(find(i), []).append((k is None, k or 0, i))
    return sorted(min(g)[2] for g in groups.values())


def different_texts(n, seed=5):
    """Texts with edited copies of every similarity around the limit, and a passage that half of them share."""
    rng, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for k in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 160))] + passage * (k % 2)
        out.append(base)
        for edits in (1, 2, 3, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"e{rng.randrange(10**6)}"
            out.append(copy)
    return [" ".join(w) for w in out]


def test_different_texts_against_brute_force(spark, data):
    texts = different_texts(40) + [None, "", " \n", "one two", "One  two", "one three"]
    rows = [(None if i % 11 == 3 else i // 2, t) for i, t in enumerate(texts)]  # keys repeat, and some are null
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, place int").coalesce(1)
    kept = sorted(r["place"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect())
    assert kept == brute_kept(rows)
    assert 40 < len(kept) < 200


def test_similar_fingerprints_of_unlike_texts_stay(spark, data):
    short = ["a b c d e f", "a b c d e g", "a b c d h f"]
    docs = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, data).count() == 3


def test_frequent_shingles_change_no_result(spark, data, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(different_texts(12))), "doc_id long, text string")
    with_order = {r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()}
    monkeypatch.setattr(shingles, "SAMPLE_ROWS", 3)
    assert {r["doc_id"] for r in simhash.keep_dissimilar(docs).collect()} == with_order


def test_large_groups_meet_in_blocks(spark, data):
    texts = different_texts(12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = simhash.numbered(docs.coalesce(1))
    whole, cut = ({(r["_row"], r["root"]) for r in simhash.similar_rows(table, group_rows=n).collect()} for n in (2048, 2))
    assert whole == cut


def test_large_families_meet_in_blocks(spark, data):
    docs = spark.createDataFrame(list(enumerate(different_texts(12))), "doc_id long, text string")
    table = simhash.numbered(docs.coalesce(1))
    whole = {(r["_row"], r["root"]) for r in simhash.similar_rows(table).collect()}
    assert {(r["_row"], r["root"]) for r in simhash.similar_rows(table, group_rows=4, block_shingles=300).collect()} == whole


def test_a_family_of_near_copies_makes_no_pairs(spark, data, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(204)]
    rows = []
    for k in range(200):
        copy = list(base)
        for at in rng.sample(range(2, 202), rng.choice((2, 3, 4))):
            copy[at] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    made = {}

    def recorded(df, name, write=simhash.stored):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stored", recorded)
    monkeypatch.setattr(shingles, "stored", recorded, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in simhash.keep_dissimilar(docs).orderBy("doc_id").collect()] == brute_kept(rows)
    assert max(made.values()) <= 200 * 42  # a prefix a row: of 200 shingles 41; there are 19,900 pairs


def test_sets_are_compared_only_where_the_pivot_tables_leave_the_pair():
    n, root = np.full(3, 40), np.arange(3)
    fps = np.array([0, (1 << simhash.WIDE) - 1, (1 << 64) - 1], np.uint64)
    asked = []

    def shared(i, j):
        asked.extend((i, x) for x in j.tolist())
        return np.full(len(j), 40)

    assert simhash.similar_forest(n, fps, root, shared) == [(0, 1)]
    assert asked == [(0, 1)]
    assert simhash.similar_forest(n, fps, np.array([0, 1, 0]), shared) == [(0, 1)]  # rows of one root need no link


def test_pivots_leave_similar_sets():
    rng, lost = random.Random(3), 0
    for _ in range(300):
        n = rng.randrange(simhash.SMALL_SET, 400)
        base = [rng.getrandbits(64) for _ in range(n)]
        gone = int(n / 9)  # what stays on both sides is 0.8 of all
        x, y = (np.array(base[: n - gone] + [rng.getrandbits(64) for _ in range(gone)], np.uint64) for _ in "xy")
        a, b = (np.array([simhash.majority(v)], np.uint64) for v in (x, y))
        lost += int(np.bitwise_count(a ^ b)[0]) > simhash.WIDE
    assert lost == 0


def least_shingles_apart():
    """Two texts of similarity 900 / 1100; the second has none of the first's 20 least shingles."""
    one = [f"w{i}" for i in range(1004)]
    digest = lambda i: np.uint64(xxhash.xxh64_intdigest(" ".join(one[i : i + 5]), seed=shingles.HASH_SEED)).view(np.int64)
    two = list(one)
    for i in sorted(range(1000), key=digest)[:20]:
        two[i + 2] = f"e{i}"
    return " ".join(one), " ".join(two)


def fingerprints_apart():
    """Two texts of similarity 36 / 44, built word by word so that most bits have no clear majority and the last four words decide them."""
    vocabulary, sides = [f"w{i}" for i in range(300)], np.where(np.arange(64) % 2, 1, -1)

    def grown(words, total, n, aim):
        words, total = list(words), total.copy()
        for _ in range(n):
            bits = {w: np.unpackbits(np.array([xxhash.xxh64_intdigest(" ".join([*words[-4:], w]), seed=shingles.HASH_SEED)], "<u8").view(np.uint8), bitorder="little") * 2.0 - 1 for w in vocabulary}
            best = min(vocabulary, key=lambda w: aim(total + bits[w]))
            words.append(best)
            total += bits[best]
        return words, total

    base, total = grown([f"s{i}" for i in range(4)], np.zeros(64), 36, lambda m: (m * m).sum())
    return tuple(" ".join(grown(base, total, 4, lambda m: (np.clip(m, -1, 1) * sides * way).sum())[0]) for way in (1, -1))


def test_similar_texts_without_a_common_least_shingle_meet(spark, data):
    one, two = least_shingles_apart()
    x, y = (shingles.shingles(t, 5) for t in (one, two))
    assert shingles.enough(len(np.intersect1d(x, y)), len(x), len(y))
    assert not np.isin(x[:20], y).any()
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()] == [1]


def test_similar_texts_with_unlike_fingerprints_meet(spark, data):
    one, two = fingerprints_apart()
    x, y = (shingles.shingles(t, 5) for t in (one, two))
    assert shingles.enough(len(np.intersect1d(x, y)), len(x), len(y))
    assert (simhash.majority(x.view(np.uint64)) ^ simhash.majority(y.view(np.uint64))).bit_count() > simhash.WIDE
    docs = spark.createDataFrame([(1, one), (2, two), (3, "other " + two)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()] == [1]


@pytest.mark.parametrize("group_rows, block_shingles", [(2048, 1 << 20), (4, 300)])
def test_the_pivot_tables_leave_out_nothing(spark, monkeypatch, group_rows, block_shingles):
    monkeypatch.setattr(simhash, "WIDE", 6)
    texts = different_texts(25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_dissimilar(docs, group_rows=group_rows, block_shingles=block_shingles).collect())
    assert kept == brute_kept(list(enumerate(texts)))


def test_cells_discard_no_similar_set():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 400, 100_000):  # in the last, a cell holds over 255
        base = rng.integers(-(1 << 62), 1 << 62, n + n // 9)
        for gone in range(0, n // 9 + 1, max(1, n // 90)):
            x, y = base[:n], base[gone : n + gone]
            counts = np.array([shingles.cells(x), shingles.cells(y)], np.int16)
            assert simhash._possible(0, np.array([1]), np.array([n, n]), counts).tolist() == [1]
    unlike = [rng.integers(-(1 << 62), 1 << 62, 300) for _ in "xy"]
    assert not len(simhash._possible(0, np.array([1]), np.array([300, 300]), np.array([shingles.cells(s) for s in unlike], np.int16)))

def test_rows_that_repeat_key_and_text_keep_one(spark):
    text = "one two three four five six seven"
    rows = [(7, text, "a", 1), (7, text, "b", 2), (8, text, "c", 3), (None, text, "d", 4), (None, None, "e", 5), (None, None, "f", 6), (9, "", "g", 7), (9, None, "h", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, said string, k int").coalesce(1)
    kept = simhash.keep_dissimilar(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["k"] in (1, 2)) for r in kept.collect()) == [(7, True), (9, False)]
    lone = simhash.keep_dissimilar(docs.where("doc_id is null and text is null"))
    assert [r["doc_id"] for r in lone.collect()] == [None]


def test_tables_on_the_way_are_deleted(spark):
    from scriptorium.llm import scratch

    made = []

    def make():
        made.append(scratch.stored(spark.range(3), "way"))
        return made[0].where("id > 0")

    assert scratch.alone(spark, make, "kept").count() == 2
    assert made[0]._stored_at not in scratch._WRITTEN[spark.sparkContext.applicationId]


def test_text_ids_tell_null_from_empty(spark):
    from scriptorium.llm.scratch import text_id

    ids = [bytes(r[0]) for r in spark.createDataFrame([("",), (None,), ("a",), ("a",)], "t string").select(text_id(shingles.F.col("t"))).collect()]
    assert ids[1] == b"" and len(ids[0]) == len(ids[2]) == 16 and ids[2] == ids[3] != ids[0]
