"""Readers, writers and streams over real files."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import manifest
from scriptorium.sources import files
from scriptorium.streaming import commits

ROW = "| 1 | https://example.com/known | Known | 01/01/26 00:00:00 | [[k_raw]] | | Raw only |"


def test_link_list_keeps_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n https://b/1 \r\n\nfile.mp3\n")
    assert [(r["pos"], r["item"]) for r in files.link_list(spark, str(tmp_path)).orderBy("pos").collect()] == [(1, "https://b/1"), (3, "file.mp3")]


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.md").write_text(f"\n| STT | Link | a | b | c | d | e |\n{ROW}\n")
    assert files.manifest(spark, str(tmp_path / "m.md")).first()["stt"] == 1


def test_history(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text(json.dumps({"source": "s", "status": "failed", "update": True, "usage": [{"model": "m", "attempt": 1}], "time": "2026-09-07T22:47:09+07:00"}))
    row = files.history(spark, str(tmp_path)).first()
    assert row["usage"][0]["model"] == "m" and row["time"].hour == 15


def test_media_files(spark, tmp_path):
    (tmp_path / "A.MP3").write_bytes(b"x" * 1025)
    (tmp_path / "b.txt").write_text("x")
    assert [(r["name"], r["size_kb"]) for r in files.media_files(spark, str(tmp_path)).collect()] == [("A.MP3", 2)]


def test_documents_are_not_written_twice(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "stem string, text string")
    folder = tmp_path / "docs"
    assert files.write_documents(docs(("a", "1"), (None, "x")), str(folder)) == 1
    assert files.write_documents(docs(("a", "2"), ("b", "é")), str(folder)) == 1
    read = lambda: {p.name: p.read_text() for p in folder.iterdir()}
    assert read() == {"a_raw.md": "1", "b_raw.md": "é"}
    assert files.write_documents(docs(("a", "3"), ("a", "2")), f"file://{folder}", overwrite=True) == 1
    assert files.write_documents(docs(("a", None)), str(folder), kind="refine") == 1
    assert read() == {"a_raw.md": "2", "a_refine.md": "", "b_raw.md": "é"}


def test_links_are_written_in_order(spark, tmp_path):
    files.write_links(spark.createDataFrame([(2, "b"), (1, "a")], "pos int, url string"), str(tmp_path / "l"))
    assert files.link_list(spark, str(tmp_path / "l")).orderBy("path", "pos").select("item").collect()[0]["item"] == "a"


def test_replayed_batch_merges_once(spark, tmp_path):
    start = manifest.parse(spark.createDataFrame([(0, ROW)], "pos long, line string"))
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("https://new.com/a", "New", "a_raw", None, None, 0)], commits.RESULT).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(commits.RESULT).parquet(source)
        query = commits.commit_stream(stream, start, folder, str(tmp_path / checkpoint), F.lit("now"))
        query.awaitTermination(60)
        return sorted(r["stt"] for r in commits.current(spark, folder, 0).collect())

    assert run("c1") == [1, 2]
    assert run("c2") == [1, 2]  # a lost checkpoint replays the batch


def test_failures_are_committed_and_a_missing_version_is_an_error(spark, tmp_path):
    start = manifest.parse(spark.createDataFrame([(0, ROW)], "pos long, line string"))
    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "out"), f"{commits.RESULT}, reason string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query = commits.commit_stream(spark.readStream.schema(schema).parquet(source), start, folder, str(tmp_path / "c"), F.lit("now"))
        query.awaitTermination(60)
        return query

    run([("https://example.com/known", None, None, None, None, 0, "gone"), ("https://new.com/a", "New", "a_raw", None, None, 1, None)])
    assert sorted(r["status"] for r in commits.current(spark, folder, 0).collect()) == ["Failed: gone", "Raw only"]
    (tmp_path / "out" / "version=0").rename(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="is missing"):
        run([("https://new.com/b", "New", "b_raw", None, None, 2, None)])


def test_stream_operators(spark, tmp_path):
    events = spark.createDataFrame([("k", "2026-01-01 00:00:00", "error"), ("k", "2026-01-01 00:01:00", "view"), ("j", "2026-01-01 02:00:00", "view")], "url_key string, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, df in (("once", commits.dedup_stream(stream())), ("rates", commits.error_rates(stream()))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert sorted(r["url_key"] for r in spark.table("once").collect()) == ["j", "k"]
    assert [(r["errors"], r["n"]) for r in spark.table("rates").collect()] == [(1, 2)]
