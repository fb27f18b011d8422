import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import simhash, toxicity

PASSAGES = 3


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_rows_are_judged_by_their_own_text(spark, data, read, documents, monkeypatch, name, stage):
    model = toxicity.Model(-12.0, dict.fromkeys(toxicity.buckets("grobbleword"), 20.0))
    monkeypatch.setattr(toxicity, "fit", lambda *_, **__: model)  # labels know documents by their keys
    tests = [(None, t, "en", "s", 1) for t in ["Such a grobbleword is rare.", *(r["text"] for r in read("benchmark").limit(PASSAGES).collect())]]
    docs = documents.limit(150).union(documents.limit(5)).union(spark.createDataFrame(tests, documents.schema))
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(docs.collect())], documents.schema).coalesce(1)
    kept = sorted(r["text"] for r in stage(spark, docs, data).collect())
    assert len(kept) < docs.count()
    for key in (None, 7):
        assert sorted(r["text"] for r in stage(spark, docs.withColumn("doc_id", F.lit(key).cast("long")), data).collect()) == kept


def test_a_repeated_key_loses_only_its_copy(spark):
    texts = ["a b c d e f g", "h i j k l m n", "a b c d e f g", "a b c d e f g"]
    docs = spark.createDataFrame(list(zip([2, 2, 1, None], texts)), "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, texts[0]), (2, texts[1])]


def test_a_labelled_key_of_many_rows_is_sampled(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} {i}") for k, n in ((1, 200), (2, 30)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "held_out", lambda key: F.lit(False))
    seen = []
    monkeypatch.setattr(toxicity, "fit_mil", lambda s, y, n: seen.append(len(y)) or (-12.0, [0.0] * n))
    toxicity.fit(docs, labels, max_docs=20)
    assert seen and seen[0] <= 20
