import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, quality, toxicity, vptree


def test_toxicity_on_held_out_documents(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_table(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.75 and all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_never_learned(documents, read):
    labels = read("labels")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(documents, labels) == toxicity.fit(documents, turned)


def test_offending_sentences(spark):
    model = toxicity.Model(-6.0, {b: 12.0 for b in toxicity.buckets("vile")[:1]})
    docs = spark.createDataFrame([(1, "All is well. You vile thing! Bye."), (2, "All is well."), (3, None), (4, "a.vile.b")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    (one,) = rows[1]["sentences"]
    assert "All is well. You vile thing! Bye."[one["from"] : one["to"]].strip() == "You vile thing"
    assert rows[1]["score"] > 0.9 > rows[2]["score"] and rows[3]["score"] == 0 and rows[4]["score"] > 0.9


def test_long_quiet_texts_score_nothing(spark):
    weights = {b: 12.0 for b in toxicity.buckets("vile")[:1]}
    docs = spark.createDataFrame([(1, "All is well here. " * 30_000), (2, "All is well here. " * 30_000 + "Vile.")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.Model(-3.0, weights)).collect()}
    assert scores[1] == 0 and scores[2] > 0.9


def test_scores_against_the_plain_formula(documents, read):
    model = toxicity.fit(documents, read("labels"))
    quiet = 1 / (1 + np.exp(-model.bias))

    def plain(text):
        none = 1.0
        for s in re.findall(r"[^.!?\n]*\w[^.!?\n]*", text or ""):
            said = {w.strip(toxicity.EDGES) for w in s.lower().split()} - {""}
            z = sum(model.weights.get(b, 0.0) for w in said for b in toxicity.buckets(w))
            none *= (1 - min(1 / (1 + np.exp(-(z + model.bias))), 1 - 1e-12)) / (1 - quiet) if z else 1
        return 1 - none

    rows = toxicity.score(documents, model).join(documents.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == documents.count() and max(abs(r["score"] - plain(r["text"])) for r in rows) < 1e-9


def test_noisy_or_gradient():
    rng = np.random.default_rng(0)
    sentences = [[rng.integers(1, 6, 4) for _ in range(3)] for _ in range(400)]
    labels = rng.integers(0, 2, 400)
    for own, y in zip(sentences, labels):
        if y:
            own[int(rng.integers(3))][0] = 0
    bias, weights = toxicity.fit_mil(sentences, labels, 6)
    assert weights[0] > 5 and abs(weights[1:]).max() < weights[0] / 2 and bias < -2


def test_toxicity_of_awkward_rows(spark, awkward, read):
    rows = toxicity.toxicity_table(awkward, read("labels")).collect()
    assert len(rows) == awkward.count() and all(r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    nothing = read("labels").limit(0)
    assert toxicity.toxicity_table(awkward, nothing).where("predicted = 1").count() == 0
    kept = toxicity.clean(awkward, nothing)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert toxicity.toxicity_table(awkward.limit(0), read("labels")).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_table(awkward, odd).count() == awkward.count()


def test_quality_keeps_good_documents(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.assess(docs).join(labels, "doc_id").collect()
    good, bad = ([r["accepted"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    n = len(quality.LABELLERS)
    patterns, truth = {}, {}
    for _ in range(5000):
        good = rng.random() < 0.8
        wrong = rng.random(n) < 0.003
        junk = rng.integers(n)
        p = "".join("-" if (w if good else k == junk or w) else "+" for k, w in enumerate(wrong))
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    post = quality.posteriors(patterns)
    assert post["+" * n] > 0.95
    assert np.mean([(post[p] > 0.5) == (np.mean(t) > 0.5) for p, t in truth.items() if len(t) > 20]) == 1
    assert quality.posteriors({}) == {}
    good = quality.estimate(patterns)[1][0]
    assert (abs(good - 0.997) < 0.015).all()  # estimated, not set


def test_votes_and_scores_against_the_plain_way(documents):
    table = {r["doc_id"]: r["text"] for r in documents.collect()}
    examined = quality.examine(documents)
    good, weights = quality.fit(examined)
    seen = {r["doc_id"]: r for r in examined.collect()}
    for r in quality.assess(documents).collect():
        text = table[r["doc_id"]]
        words = (text or "").split()
        if not words:
            assert not r["accepted"] and r["score"] == 0
            continue
        stats = quality.measure(text, words)
        assert stats.symbols == sum(c in quality.SYMBOLS for c in text) / len(text)
        assert stats.distinct == len(set(words)) / len(words) and stats.mean_length == sum(map(len, words)) / len(words)
        assert r["votes"] == "".join("0" if stats.words < least else {1: "+", 0: "0", -1: "-"}[f(stats)] for least, f in quality.LABELLERS.values())
        assert r["posterior"] == good[r["votes"]]
        x = np.frombuffer(seen[r["doc_id"]]["features"], np.uint8) / 255.0
        assert abs(r["score"] - 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1])))) < 1e-6 and r["accepted"] == (r["score"] >= 0.5)


def test_estimation_against_plain_votes(spark):
    """On labelled documents the posteriors keep no fewer good ones than votes do, and no more bad ones."""
    big = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.assess(docs).join(labels, "doc_id").collect()
    for y, better in ((1, lambda a, b: a >= b), (0, lambda a, b: a <= b)):
        own = [r for r in rows if r["quality"] == y]
        assert better(sum(r["posterior"] >= 0.5 for r in own), sum("-" not in r["votes"] for r in own))


def test_quality_of_awkward_rows(awkward):
    rows = quality.assess(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["accepted"] for r in rows if r["doc_id"] in (2, 3, 4)} == {False}
    assert {r["accepted"] for r in rows if r["doc_id"] == 5} == {False}
    kept = quality.clean(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} <= {1, None, 6, -7}
    assert quality.assess(awkward.limit(0)).count() == 0


def brute_nearest(ids, vectors, queries, k):
    out = {}
    for q in queries:
        products = vectors @ vectors[q]
        products[ids == ids[q]] = -np.inf
        by = np.lexsort((ids, -products))[: min(k, (ids != ids[q]).sum())]
        out[int(ids[q])] = ids[by].tolist()
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_factor_one_is_exact(spark, unit, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 500)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 8)) * rng.uniform(0.2, 3, (1500, 1))
    vectors[100:140] = vectors[100]  # equal vectors: ties go to the smaller id
    if unit:
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    rows = vptree.nearest_table(df, factor=1.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest(ids, vectors, range(0, 1500, 20), 20)
    for q in want:
        if 100 <= q < 140:
            continue
        assert sorted(got[q]) == sorted(want[q])
    assert got[100] == want[100]


def test_recall_with_the_default_factor(read):
    e = read("embeddings")
    table = e.orderBy("vec_id").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64)
    want = brute_nearest(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    got = {}
    for r in vptree.nearest_table(e).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(want[q])) / len(want[q]) for q in want]) > 0.9


def test_clustered_vectors_skip_most_leaves():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    vectors = centres[rng.integers(60, size=4000)] + rng.normal(size=(4000, 32)) * 0.15
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids, largest = np.arange(4000), np.linalg.norm(vectors, axis=1).max()
    factor, tree = vptree.calibrated(vectors, largest, 20), vptree.Tree(ids, vectors, largest)
    q, v, _ = tree.search(ids[::20], vectors[::20], 20, factor)
    want = brute_nearest(ids, vectors, ids[::20], 20)
    assert np.mean([len(set(v[q == i].tolist()) & set(want[20 * i])) / 20 for i in range(200)]) > 0.9
    assert factor > 1 and tree.read < 0.3 * tree.there


def test_shards_of_the_router():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 6))
    router = vptree.Router(vectors[:800], np.linalg.norm(vectors, axis=1).max(), 13)
    shard, bounds = router.shard_of(vectors), router.bounds(vectors[:50])
    assert router.shards == 16 and np.bincount(shard, minlength=16).min() > 60
    lifted = vptree.lifted(vectors, router.largest)
    asked = np.hstack([vectors[:50], np.zeros((50, 1))])
    d = np.sqrt(((asked[:, None] - lifted[None]) ** 2).sum(axis=2))
    assert all((d[:, shard == k].min(axis=1) >= bounds[:, k] - 1e-9).all() for k in range(16))


def test_equal_vectors_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 50)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(7, [1.0, 2.0, 3.0])] * 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest_table(df, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [*range(1, 7), *[7] * 14] and len(got) == 15


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (20, [1.0]), (40, []), (None, [1.0, 1.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, vector string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest_table(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 2.0), (0, 2, 1, 0.5), (0, 3, 1, 0.5)]
    assert vptree.nearest_table(df.limit(0)).count() == 0


def test_viterbi_against_enumeration(read):
    model = chat.fit(read("conversations"))
    first, step, rng = np.full(6, -np.inf), chat.transitions(model), np.random.default_rng(0)
    first[::2] = model.first
    for _ in range(30):
        shown = rng.normal(size=(4, 6)) * 3
        best = max(itertools.product(range(6), repeat=4), key=lambda z: first[z[0]] + sum(shown[i, z[i]] for i in range(4)) + sum(step[z[i], z[i + 1]] for i in range(3)))
        assert chat.viterbi(shown, first, step).tolist() == list(best)


def test_line_features_agree(spark):
    texts = ["", "Hello there?", "lower", "123", "É " * 200, "x" * 20, "x" * 240, "漢字? "]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", chat.line_feature_column(F.col("s")).alias("f"))
    assert [r["f"] for r in df.collect()] == [chat.line_feature(t) for t in texts]


def test_transcripts_are_parsed(read):
    model = chat.fit(read("conversations"))
    assert chat.decode("User: hi\nthere\n\nAssistant: yes", model) == [("user", "hi\nthere"), ("assistant", "yes")]
    assert [r for r, _ in chat.decode("<|system|>Be kind\n<|user|>q\n<|assistant|>a", model)] == ["system", "user", "assistant"]
    assert chat.decode(None, model) == [] and chat.decode(" \n", model) == []


def test_no_text_is_lost(read):
    model = chat.fit(read("conversations"))
    assert chat.decode("Note: buy milk", model)[0][1] == "Note: buy milk" and chat.decode("https: //x", model)[0][1] == "https: //x"
    for text in ("\n\nUser: hi\nthere\n\n\nAssistant: yes \n\n", "Note: a\n[USER] b\n  c", "x", "AI: \nBob: said"):
        assert "\n".join(mark + body for _, mark, body in chat.turns_of(text, model)) == text


def test_a_repeated_turn_is_cut(spark):
    rows = [(1, 0, "user", f"line {i}") for i in range(200)] + [(1, 1, "assistant", "b"), (1, None, "user", "c"), (2, 0, "user", "d")]
    made = chat.transcripts_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r["text"].count("line ") for r in made) == 200 and max(r["text"].count("\n") for r in made) < 2 * 64
    assert any("b" in r["text"] and "line" not in r["text"] for r in made)


def test_most_roles_are_recovered(read):
    turns = read("conversations")
    truth, got = {}, {}
    for r in turns.orderBy("turn").collect():
        truth.setdefault(r["conv_id"], []).append(r["role"])
    rows = chat.chat_table(turns).orderBy("conv_id", "turn").collect()
    for r in rows:
        got.setdefault(r["conv_id"], []).append(r["role"])
    assert np.mean([got[c] == truth[c] for c in truth]) > 0.85
    assert rows[0]["rendered"].startswith("<|") and rows[0]["rendered"].endswith("\n<|end|>\n")


def test_awkward_turns(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 0, "odd", "x\ny"), (3, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, content string")
    found = chat.chat_table(df).collect()
    assert {r["conv_id"] for r in found} == {None, 1, 2, 3}
    assert chat.chat_table(df.limit(0)).count() == 0


def test_texts_without_words_cost_their_length():
    import re
    import time

    from scriptorium.llm import toxicity

    judge = toxicity._scorer(toxicity.Model(-5.0, {b: 9.0 for b in toxicity.buckets("bad")}), 0.5)
    for junk in (" ", "\t", "# ", "…", "-", ".", "?! ", "\n"):
        began = time.time()
        text = junk * (1_000_000 // len(junk))
        scores, counts, _ = judge([text, text + " bad", f"bad.{text}"])
        assert time.time() - began < 3 and counts[0] == 0 and str(scores[0]) == "0.0" and min(scores[1:]) > 0.9, junk
    old = re.compile(r"[^.!?\n]*\w[^.!?\n]*")
    for text in ("A b. C!? d\n\ne.f ", "... x", "", "no end", " .a. . "):
        assert [m.span() for m in old.finditer(text)] == [m.span() for m in toxicity.sentences_of(text)]
