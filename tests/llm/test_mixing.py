import pytest
from pyspark.sql import functions as F

from scriptorium.llm import mixing, queries
from scriptorium.llm.scratch import discard_all


def poured(total, caps, weights):
    """Targets by giving out and taking back, again and again."""
    full, out = set(), {}
    while True:
        left = total - sum(caps[k] for k in full)
        free = [k for k in caps if k not in full]
        out = {k: caps[k] if k in full else left * weights[k] / sum(weights[x] for x in free) for k in caps}
        over = {k for k in free if out[k] > caps[k] * (1 + 1e-12)}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("name", ["op11_mixing", "op12_divergence", "op13_repair"])
def test_same_rows_as_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 7}, {"a": 1, "b": 1, "c": 1, "d": 900, None: 40}, {"a": 0, "b": 5}])
def test_targets_are_poured(frame, sizes):
    found = {r["_source"]: r["_target"] for r in mixing.targets(frame(list(sizes.items()), "_source string, _words long")).collect()}
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    want = poured(1.5 * sum(sizes.values()), {k: 2 * v for k, v in sizes.items()}, {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(order)})
    assert found == pytest.approx(want)


def test_sources_come_near_their_targets(documents):
    rows = mixing.mix_table(documents).collect()
    assert len(rows) == documents.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    for source in {d["source"] for d in documents.select("source").collect()}:
        keys = {d["doc_id"] for d in documents.where(F.col("source") == source).collect()}
        own = [r for r in rows if r["doc_id"] in keys]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.1 * own[0]["target"]  # ten documents a source


def test_short_documents_are_taken_more_often(frame):
    docs = frame([(i, "w " * (4 if i % 2 else 64), "s") for i in range(400)] + [(1000 + i, "w " * 50, "t") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_table(docs, share=0.5).where("doc_id < 1000").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    mean = {r["size"]: r["c"] for r in rows}
    assert mean[4] == 2 and 0 < mean[64] < 2


def test_a_document_does_not_hang_on_partitions(documents):
    one, other = (sorted(map(tuple, mixing.mix_table(d).collect())) for d in (documents.coalesce(1), documents.repartition(7)))
    assert one == other


def test_awkward_rows_are_mixed(awkward, spark):
    docs = awkward.withColumn("source", F.when(F.col("doc_id") == 5, F.lit(None).cast("string")).otherwise("s"))
    table = mixing.mix_table(docs)
    assert table.count() == docs.count() and table.where("size = 0 and taken > 0").count() == 0
    made = mixing.mixed(docs)
    assert made.columns == docs.columns and made.count() == table.agg(F.sum("copies")).first()[0]
    alike = {(r["size"], r["copies"]) for r in table.where("doc_id = 1").collect()}
    assert len(alike) == 1
    assert mixing.mix_table(docs.limit(0)).count() == 0 and mixing.mixed(docs.where("text is null")).count() == 0
    discard_all(spark)


def test_ranks_are_cut_in_cells_as_without_them(documents, monkeypatch):
    whole = sorted(map(tuple, mixing.mix_table(documents).collect()))
    for cells in (1, 7):
        monkeypatch.setattr(mixing, "CELLS", cells)
        assert sorted(map(tuple, mixing.mix_table(documents).collect())) == whole
