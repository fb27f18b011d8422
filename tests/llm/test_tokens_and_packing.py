import zlib
from collections import defaultdict

import numpy as np
import pytest

from scriptorium.llm import packing, token_files
from scriptorium.llm.mph import MinimalPerfectHash, fingerprint
from scriptorium.llm.tokens import WordEncoder, default_tokenizer

ODD = ["a\x1cb c", "İstanbul ΣΑΣ ΑΣ. x", "<|endoftext|>hi <|startoftext|>", "don't we'll 12.5% ...", "é क़ 한국어 日本語 ﬁ", "", " ", "ß ÿ µ", "A B　C", "x" * 5000, "퟿ 😀"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_tokenizer())
    return lambda t: lib.encode(t or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_equals_the_library(library, documents):
    texts = [r["text"] for r in documents.collect()] + ODD + [None]
    enc = WordEncoder(max_words=500)  # so small that it is emptied again and again
    for a in range(0, len(texts), 16):
        for t, ids in zip(texts[a : a + 16], enc.encode(texts[a : a + 16])):
            assert np.frombuffer(ids, enc.dtype).tolist() == library(t)


def test_minimal_perfect_hash():
    keys = np.random.default_rng(0).choice(1 << 40, 20_000, replace=False).astype(np.int64)
    mph = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(mph.number(keys).tolist()) == list(range(len(keys)))
    table = np.zeros(len(keys), np.uint32)
    table[mph.number(keys)] = fingerprint(keys)
    others = -1 - keys
    at = mph.number(others)
    assert (table[at[at >= 0]] == fingerprint(others[at >= 0])).sum() <= 2
    assert MinimalPerfectHash.build(keys[:0]).number(keys[:3]).tolist() == [-1, -1, -1]


def test_round_trip(library, documents):
    start = 0
    got = token_files.token_table(documents, rows_per_shard=40).orderBy("doc_id").collect()
    docs = documents.orderBy("doc_id").collect()
    assert len(got) == len(docs) and len({r["shard"] for r in got}) > 2
    for d, r in zip(docs, got):
        ids = library(d["text"])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), crc(ids))
        start += len(ids)


def test_lookup_by_key(spark, documents):
    path, manifest = token_files.write(documents, rows_per_shard=50)
    assert manifest.count() > 1
    keys = spark.createDataFrame([(3,), (3,), (10**9,), (None,)], "doc_id long")
    assert [r["doc_id"] for r in token_files.lookup(keys, path).collect()] == [3]


def test_awkward_rows_are_all_stored(library, awkward):
    got = token_files.token_table(awkward).collect()
    want = sorted((len(library(r["text"])), crc(library(r["text"]))) for r in awkward.collect())
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, -7, 1, 1, 2, 3, 4, 5, 6]
    assert token_files.token_table(awkward.limit(0)).count() == 0


def check_packing(rows, library, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    assert sum(r["length"] for r in rows) == sum(len(library(t)) for t in texts)
    return sequences


def test_packing_fills_sequences(library, documents):
    docs = documents.collect()
    rows = packing.packed_table(documents).collect()
    sequences = check_packing(rows, library, [r["text"] for r in docs])
    for d in docs[:50]:
        ids = library(d["text"])
        for r in (r for r in rows if r["doc_id"] == d["doc_id"]):
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
    assert sum(r["length"] for r in rows) / (len(sequences) * packing.CAPACITY) > 0.97


def test_packing_of_awkward_rows(library, awkward):
    check_packing(packing.packed_table(awkward).collect(), library, [r["text"] for r in awkward.collect()])
    assert packing.packed_table(awkward.limit(0)).count() == 0


def test_whole_sequences(library, awkward):
    assigned = packing.assign(packing.token_pieces(awkward))
    for r in packing.sequences(assigned).collect():
        n = len(r["ids"]) // 4
        assert n == packing.CAPACITY or n == r["n_tokens"] and n & (n - 1) == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(c): int(n) for c, n in zip(rng.choice(np.arange(1, 65), 20, replace=False), rng.integers(1, 300, 20))}
    patterns = packing.solve_patterns(histogram, 64)
    held = defaultdict(int)
    for p in patterns:
        assert sum(c * a for c, a in p.items.items()) <= 64
        for c, a in p.items.items():
            held[c] += a * p.count
    assert dict(held) == histogram
    sizes = np.array(sorted(histogram))
    first_fit = packing._first_fit(sizes, np.array([histogram[int(c)] for c in sizes]), 64)
    assert sum(p.count for p in patterns) <= len(first_fit) + 2


def test_knapsack_against_enumeration():
    values, sizes = np.array([1.0, 2.6, 4.1]), np.array([2, 5, 7])
    best = max(a + 2.6 * b + 4.1 * c for a in range(12) for b in range(5) for c in range(4) if 2 * a + 5 * b + 7 * c <= 23)
    worth, amounts = packing._knapsack(values, sizes, 23)
    assert worth == pytest.approx(best) and (amounts * sizes).sum() <= 23 and (amounts * values).sum() == pytest.approx(best)
