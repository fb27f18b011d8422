import pytest

import corpus_pipeline
from scriptorium.llm import packing


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-duplicates", "decontamination", "packing"]


def test_run_keeps_what_every_stage_keeps(spark, data, documents):
    packed = corpus_pipeline.run(spark, data).collect()
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data)
        assert kept.columns == documents.columns
        assert 0 < kept.count() <= docs.count()
        docs = kept
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert max(r["offset"] + r["length"] for r in packed) <= packing.CAPACITY


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_no_rows(spark, data, awkward, name, stage):
    for docs in (awkward, awkward.limit(0)):
        out = stage(spark, docs, data)
        assert out.count() >= 0
        if name != "packing":
            assert out.columns == docs.columns


def test_planted_copies_and_passages_go(spark, data, read):
    passage = read("benchmark").first()["text"]
    clean = ["The river rose slowly over night and the people of the village moved their boats up to the old stone wall again.", "A baker kept three ovens warm through winter so that travellers could buy bread before the first coach left the square."]
    rows = [(1, clean[0]), (2, clean[0]), (3, clean[1]), (4, clean[1] + " " + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert {r["doc_id"] for r in once.collect()} == {1, 3, 4}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, once, data).collect()} == {1, 3}
