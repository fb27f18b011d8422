"""Commits, numbered lines, rename orders, logs, and sources and sinks of the data source API."""

import functools
import json
from random import Random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import captions, keytable, manifest, renames, scans, tables
from scriptorium.sources import channels, files, sink
from scriptorium.streaming import commits, ledger, rests

ROW = ledger.ROW
SAID = f"{commits.RESULT}, reason string"


def known(k, url, **cells):
    return {"pos": k, "stt": 100 - k, "url": url, "title": f"T{k}", "ts": "then", "raw_link": "", "refine_link": "", "status": "Raw only"} | cells


def result(order, url, reason=None, refine=None):
    return url, f"N{order}", f"r{order}_raw", refine, None, order, reason


def rows_of(df):
    return sorted(df.select(*manifest.COLUMNS).collect(), key=lambda r: r["pos"])


def merged(rows, batch):
    return tables.written(manifest.mark_failures(manifest.upsert(rows, batch.where("reason is null"), F.lit("now")), batch.where("reason is not null")), "merged")


@pytest.fixture
def start(frame):
    return frame([known(1, "https://a.com/x"), known(2, None), known(3, "https://a.com/x"), known(4, "https://b.com/y?utm_source=q"), known(5, None), known(6, "")], ROW)


def test_rows_without_a_link_stay(frame, start):
    results = frame([result(0, "https://b.com/y"), result(1, None), result(2, None), result(3, "https://new.com")], SAID)
    merged = manifest.upsert(start, results, F.lit("now"))
    by = {r["pos"]: r for r in rows_of(merged)}
    assert len(by) == 6 + 3 and [by[k]["title"] for k in range(1, 7)] == ["T1", "T2", "T3", "N0", "T5", "T6"]
    assert sorted(r["stt"] for r in by.values() if r["ts"] == "now") == [100, 101, 102] and sum(r["url"] is None for r in by.values()) == 4
    failed = manifest.mark_failures(start, frame([(None, "gone", 0), ("https://a.com/x", "gone", 1)], "url string, reason string, `order` int"))
    assert [r["status"] for r in rows_of(failed)] == ["Failed: gone"] + ["Raw only"] * 5
    links = frame([(0, None), (1, "https://c.com"), (2, "https://b.com/y"), (3, None)], "pos long, url string")
    assert {r["pos"]: r["stt"] for r in manifest.assign_numbers(links, start).collect()} == {0: None, 1: 100, 2: 96, 3: None}


def test_commits_equal_one_merge_and_replays_change_nothing(spark, frame, start, tmp_path):
    first = frame([result(0, "https://a.com/x", refine="f"), result(1, "https://new.com/1"), result(2, None), result(3, "https://b.com/y", reason="gone")], SAID)
    second = frame([result(4, "https://new.com/2"), result(5, "https://b.com/y")], SAID)
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=4)
    book.create(start)
    with pytest.raises(Exception, match="(?i)exist"):
        book.create(start)
    want = merged(start, first)
    assert book.commit(first, 0, F.lit("now")) and rows_of(book.read()) == rows_of(want)
    assert not book.commit(first, 0, F.lit("later")) and rows_of(book.read()) == rows_of(want)
    want = rows_of(merged(want, second))
    assert book.commit(second, 1, F.lit("now")) and rows_of(book.read()) == want
    due = book.compact(least=1)
    assert due and rows_of(book.read()) == want and book.compact(least=1) == []
    assert not book.commit(second, 1, F.lit("now"))
    book.vacuum(kept=1)
    assert rows_of(book.read()) == want and len(tables.names(spark, f"{book.folder}/delta")) == 0


def test_a_commit_writes_its_batch_and_compaction_touched_buckets(spark, frame, tmp_path):
    start = spark.range(5000).select(F.col("id").alias("pos"), F.col("id").alias("stt"), F.concat(F.lit("https://x.com/"), F.col("id").cast("string")).alias("url"), *(F.lit("t").alias(c) for c in manifest.COLUMNS[3:]))
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=16)
    book.create(start)
    book.commit(frame([result(0, "https://x.com/7"), result(1, "https://new.com")], SAID), 0, F.lit("now"))
    listed = book.snapshot()[1]
    (at, version, held), = listed["deltas"]
    assert spark.read.parquet(f"{book.folder}/delta/at={at}").count() == 2 and len(held) <= 2
    assert sorted(book.compact(least=1)) == held
    moved = {b for b, (a, _) in book.snapshot()[1]["base"].items() if a != listed["base"].get(b, [None])[0]}
    assert moved == {str(b) for b in held} and book.read().count() == 5001


def test_a_failed_commit_is_not_seen(spark, frame, start, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=2)
    book.create(start)
    before = rows_of(book.read())
    with monkeypatch.context() as patched:
        patched.setattr(ledger.Ledger, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            book.commit(frame([result(0, "https://new.com")], SAID), 0, F.lit("now"))
    assert rows_of(book.read()) == before
    assert book.commit(frame([result(0, "https://new.com")], SAID), 0, F.lit("now")) and len(rows_of(book.read())) == 7
    book.vacuum(kept=5)
    assert len(tables.names(spark, f"{book.folder}/delta")) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        book._publish(book.snapshot()[0], {})  # of two writers one wins


def test_streamed_commits(spark, frame, start, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=2)
    book.create(start)
    want = start
    for k in range(3):
        batch = frame([result(2 * k, f"https://new.com/{k}"), result(2 * k + 1, "https://a.com/x", reason="gone" if k == 1 else None)], SAID)
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        ledger.commit_stream(spark.readStream.schema(SAID).parquet(str(tmp_path / "in")), book, str(tmp_path / "c"), F.lit("now"), least=2).awaitTermination(120)
        want = merged(want, batch)
    assert rows_of(book.read()) == rows_of(want)
    ledger.commit_stream(spark.readStream.schema(SAID).parquet(str(tmp_path / "in")), book, str(tmp_path / "lost"), F.lit("now")).awaitTermination(120)
    assert len(rows_of(book.read())) == len(rows_of(want))


def test_lines_are_numbered_over_splits(spark, tmp_path):
    random = Random(1)
    text = "".join(random.choice(["a", "bb é", "", " c "]) + random.choice(["\n", "\r\n", "\r", "\n\n"]) for _ in range(4000)) + "end"
    (tmp_path / "list.txt").write_bytes(text.encode())
    (tmp_path / "more.txt").write_bytes(b"x\r\ny")
    small = {(r["path"], r["pos"], r["item"]) for r in files.items(files.whole_files(spark, str(tmp_path))).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = files.link_list(spark, str(tmp_path)).collect()
        split = files.numbered_lines(spark, str(tmp_path)).inputFiles()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(split) > 4
    assert {(r["path"], r["pos"], r["item"]) for r in found} == small
    assert [r["item"] for r in sorted(found, key=lambda r: r["n"])] == [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()] + ["x", "y"]


CALLS = "key string, tier string, at timestamp, message string, interval double"


def calls(frame):
    quota = lambda s: f"429 quota, retryDelay: {s}s"
    rows = [("a", 0, None), ("a", 10, quota(30)), ("a", 20, quota(5)), ("b", 1, "quota"), ("c", 2, None), ("c", 2, None), ("d", 3, "boom"), ("a", 12, None), ("b", 0, quota(500)), ("a", 20, quota(5)), ("p", 5, quota(9)), ("c", 8000, None)]
    return [frame([(k, "paid" if k == "p" else "free", None, m, 4.5)], CALLS).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + s))) for k, s, m in rows]


def test_rests_in_one_batch(frame):
    found = {r["key"]: tuple(r)[1:] for r in rests.key_rests(functools.reduce(lambda a, b: a.union(b), calls(frame))).collect()}
    us = lambda s: int((1_700_000_000 + s) * 1_000_000)
    assert found == {"a": (us(25), us(12), us(25)), "b": (us(61), None, us(61)), "c": (None, us(8000), us(8004.5)), "d": (None, None, None), "p": (None, None, None)}


def test_streamed_rests_equal_the_batch(spark, frame, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    every = calls(frame)
    out, seen = str(tmp_path / "out"), str(tmp_path / "in")

    def save(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    groups = [every[6:9], every[:6], every[9:]]  # late ones first, and one event twice
    for group in groups:
        functools.reduce(lambda a, b: a.union(b), group).coalesce(1).write.mode("append").parquet(seen)
        stream = rests.key_rest_stream(spark.readStream.schema(CALLS).parquet(seen))
        stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = spark.read.parquet(out)
    last = {r["key"]: (r["r"]["rest_until"], r["r"]["last_call"], r["r"]["ready"]) for r in told.where("event = 'rests'").groupBy("key").agg(F.max_by(F.struct("rest_until", "last_call", "ready"), "batch").alias("r")).collect()}
    batch = {r["key"]: tuple(r)[1:] for r in rests.key_rests(spark.read.parquet(seen)).collect()}
    assert last == batch
    assert {r["key"] for r in told.where("event = 'free'").collect()} == {"a", "b"}  # the watermark is past their rest, not yet past c's


def test_values_are_carried_over_cells(spark, frame):
    random = Random(2)
    rows = [("hot" if random.random() < 0.4 else random.choice(["u", "v", None]), k, random.choice([None, None, None, "ios", "vr"])) for k in range(600)]
    held, want = {}, {}
    for run, k, client in rows:
        want[k] = held.get(run)
        held[run] = client or held.get(run)
    df = frame(rows, "run string, seq long, client string").repartition(5)
    for cell in (1, 4, 16):
        assert {r["seq"]: r["pinned"] for r in scans.carried(df, F.col("client"), "run", "seq", "pinned", cell=cell).collect()} == want


def applied(names, steps, random):
    """Names after the steps, with the file that each has; a rename over a file is an error."""
    held = {n: n for n in names}
    for step in sorted({s["step"] for s in steps if s["step"] is not None}):
        own = [s for s in steps if s["step"] == step]
        random.shuffle(own)
        for s in own:
            assert s["new"] not in held
            held[s["new"]] = held.pop(s["old"])
    return {file: name for name, file in held.items()}


@pytest.mark.parametrize("seed", range(4))
def test_renames_write_nothing_over(frame, seed):
    random = Random(seed)
    pool = [f"f{k}" for k in range(40)]
    names = random.sample(pool, 32) + ([".parked-f0"] if seed == 3 else [])
    wanted = list(zip(random.sample(pool, 30), random.sample(pool, 30))) if seed % 2 else [(f"f{k}", f"f{(k + 1) % 9 if k < 9 else k + 1}") for k in range(30)]
    wanted += [(pool[0], pool[1]), (pool[0], pool[1]), (pool[5], pool[5]), (None, "x"), ("y", None)] + ([(pool[3], "two"), (pool[4], "two")] if seed == 1 else [])
    plan = renames.rename_steps(frame(wanted, "old string, new string"), frame([(n,) for n in names], "name string")).collect()

    clean = {(o, n) for o, n in wanted if o and n and o != n}
    present = {(o, n) for o, n in clean if o in names}
    active = {(o, n) for o, n in present if sum(x == o for x, _ in present) == 1 and sum(x == n for _, x in present) == 1}
    able = set(active)
    while blocked := {(o, n) for o, n in able if n in names and n not in {x for x, _ in able}}:
        able -= blocked
    if ".parked-f0" in names:  # a ring through f0 can't be opened
        ring, at = set(), "f0"
        while at in dict(able) and at not in ring:
            ring.add(at)
            at = dict(able)[at]
        able -= {(o, n) for o, n in able if o in ring and at == "f0" and ring}
    after = applied(names, plan, random)
    assert after == {n: dict(able).get(n, n) for n in names}
    kinds = lambda a: {(s["old"], s["new"]) for s in plan if s["action"] == a}
    assert kinds("missing") == clean - present and kinds("conflict") == present - active and kinds("taken") == active - able


def test_captions_meet_ids_of_any_length(frame):
    media = frame([("v",), ("vid1",), ("vid",), ("é1",), ("",), (None,), ("nobody",)], "media_id string")
    names = ["vid1.vi.vtt", "vid1.en.VTT", "vid2.en.srt", "é1.SRT", "other.vtt", "vid1.txt", None]
    found = captions.choose_caption(media, frame([(n,) for n in names], "name string"))
    assert {r["media_id"]: r["name"] for r in found.collect()} == {"v": "vid1.en.VTT", "vid": "vid1.en.VTT", "vid1": "vid1.en.VTT", "é1": "é1.SRT"}
    assert captions.choose_caption(media.limit(0), frame([("a.vtt",)], "name string")).count() == 0


def test_a_beginning_of_all_names_is_no_hot_key(spark):
    names = spark.range(20_000).select(F.concat(F.lit("common-"), F.col("id").cast("string"), F.lit(".vtt")).alias("name")).repartition(4)
    media = spark.createDataFrame([("common-",), ("common-7",)], "media_id string")
    found = captions.choose_caption(media, names)
    assert "partial_min_by" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["media_id"]: r["name"] for r in found.collect()} == {"common-": "common-0.vtt", "common-7": "common-7.vtt"}


def test_known_keys_are_not_moved(spark, frame, start):
    keytable.create(start, "known_keys_a", buckets=4)
    links = frame([(0, "https://a.com/x#f"), (1, "https://c.com"), (2, None)], "pos long, url string")
    new = keytable.new_links(links, "known_keys_a")
    assert {r["pos"] for r in new.collect()} == {1, 2}
    keytable.add(links, "known_keys_a", buckets=4)
    new = keytable.new_links(links, "known_keys_a")
    assert {r["pos"] for r in new.collect()} == {2}
    plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    spark.sql("DROP TABLE known_keys_a")


PAGES = {"c1": 3, "c2": 1}


def test_listings_are_read_page_by_page(spark, tmp_path):
    tried = tmp_path / "tried"

    def fetch(channel, page):
        if (channel, page) == ("c1", 1) and not tried.exists():
            tried.write_text("x")
            yield {"id": "lost"}  # rows of a page that then fails
            raise OSError("connection reset")
        yield {"url": "", "id": f"{channel}-{page}", "title": None, "duration": 7}
        yield None
        yield {"url": f"https://v/{channel}/{page}", "id": None, "title": "T"}

    counts = tmp_path / "counts"
    counts.write_text(json.dumps({"c1": 3, "c2": 1}))
    count = lambda channel: json.loads(counts.read_text())[channel]
    spark.dataSource.register(channels.channel_source(count, fetch, wait=0.0))
    option = json.dumps(["c1", "c2"])
    found = channels.videos(spark.read.format("channel_listing").option("channels", option).load())
    rows = {(r["channel"], r["page"], r["pos"]): (r["url"], r["title"], r["duration"]) for r in found.collect()}
    assert len(rows) == 8 and rows["c1", 1, 0] == ("https://www.youtube.com/watch?v=c1-1", "c1-1", 7.0) and rows["c2", 0, 2] == ("https://v/c2/0", "T", 0.0)

    def stream():
        query = spark.readStream.format("channel_listing").option("channels", option).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r["channel"], r["page"], r["pos"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    tried.unlink()
    assert stream() == sorted(rows)
    counts.write_text(json.dumps({"c1": 4, "c2": 1}))
    assert stream() == sorted([*rows, ("c1", 3, 0), ("c1", 3, 2)])


def test_all_documents_appear_or_none(spark, frame, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a_raw.md").write_text("old")
    docs = frame([("a", "1"), ("b", None), ("b", "z"), (None, "x"), ("c", "é")], "stem string, text string")
    read = lambda: {p.name: p.read_text() for p in folder.iterdir()}

    @F.udf("string")
    def fails(stem, text):
        if stem == "c":
            raise OSError("executor lost")
        return text

    with pytest.raises(Exception, match="executor lost"):
        sink.write_committed(docs.repartition(4, "stem").withColumn("text", fails("stem", "text")), str(folder), overwrite=True)
    assert read() == {"a_raw.md": "old"}
    sink.write_committed(docs, str(folder))
    assert read() == {"a_raw.md": "old", "b_raw.md": "", "c_raw.md": "é"}
    sink.write_committed(docs, f"file://{folder}", kind="refine")
    sink.write_committed(docs.where("stem = 'a'"), str(folder), overwrite=True)
    assert read() == {"a_raw.md": "1", "b_raw.md": "", "c_raw.md": "é", "a_refine.md": "1", "b_refine.md": "", "c_refine.md": "é"}


def test_a_move_that_fails_takes_the_others_back(tmp_path, monkeypatch):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a_raw.md").write_text("old")
    import pyarrow as pa

    writer = sink._Writer(str(folder), "raw", True)
    messages = [writer.write(iter([pa.RecordBatch.from_pydict({"stem": [s], "text": ["new"]})])) for s in "ab"]
    (folder / "b_raw.md").write_text("old b")
    real = sink.filesystem(str(folder))[0]

    class Breaks:
        broken = False

        def __getattr__(self, name):
            return getattr(real, name)

        def move(self, old, new):
            if new.endswith("docs/b_raw.md") and not self.broken:
                self.broken = True
                raise OSError("no")
            real.move(old, new)

    with monkeypatch.context() as patched:
        patched.setattr(sink, "filesystem", lambda f, breaks=Breaks(): (breaks, str(folder)))
        with pytest.raises(OSError, match="no"):
            writer.commit(messages)
    assert {p.name: p.read_text() for p in folder.iterdir()} == {"a_raw.md": "old", "b_raw.md": "old b"}


def test_no_shared_folder_is_an_error(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_folder(spark) == folder.rstrip("/")

    class Without:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Without)


def test_ordinals_by_any_columns(spark):
    from scriptorium.operators import dedup

    random = Random(3)
    rows = [(random.choice(["free", "paid", None]), f"k{k}") for k in random.sample(range(500), 300)]
    found = dedup.ranked(spark.createDataFrame(rows, "tier string, name string").repartition(7), "tier", "name").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["tier"], r["name"]) for r in sorted(found, key=lambda r: r["n"])] == order and {r["n"] for r in found} == set(range(1, 301))


def test_a_service_is_shared_by_operators(spark):
    from scriptorium.operators import keypool

    def setup():
        import uuid

        return {"id": uuid.uuid4().hex, "calls": 0}

    def work(service, batch):
        import os

        service["calls"] += 1
        return batch.assign(pid=os.getpid(), service=service["id"])[["id", "pid", "service"]]

    schema = "id long, pid long, service string"
    first = keypool.with_service(spark.range(8).repartition(4), work, schema, setup, shared="pool").collect()
    second = keypool.with_service(spark.range(8).repartition(4), work, schema, setup, shared="pool").collect()
    by_process = {}
    for r in first + second:
        by_process.setdefault(r["pid"], set()).add(r["service"])
    assert all(len(services) == 1 for services in by_process.values())
    assert {r["pid"] for r in first} & {r["pid"] for r in second}
    alone = keypool.with_service(spark.range(8).repartition(4), work, schema, setup).collect()
    assert not {r["service"] for r in alone} & {r["service"] for r in first}


def test_many_secrets_and_none_in_a_plan(spark, frame):
    from scriptorium.functions import text
    from scriptorium.operators import secrets

    random = Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    known = ["".join(random.choices(letters, k=random.choice([12, 39]))) for _ in range(10_000)]
    kept = secrets.digests(spark, [*known, "", "ÄÖ-key-日本語-long"], "pepper")
    said = [f"call {random.choice(known)} failed\n at  x{random.choice(known)}y, {random.choice(known)}{random.choice(known)} ?key=abc&z" for _ in range(40)]
    said += [None, "", "nothing", "é " * 700 + known[0], ("x" * 1020 + known[1] + " ") * 3, "a ÄÖ-key-日本語-long b", said[0], known[2]]
    df = frame([(k, m) for k, m in enumerate(said)], "_places long, message string")
    found = secrets.redacted(df, kept, salt="pepper")
    assert found.columns == df.columns
    plan = found._jdf.queryExecution().toString() + found._jdf.queryExecution().logical().toString()
    assert not any(s in plan for s in known)
    got = {r["_places"]: r["message"] for r in found.collect()}

    def literally(m):
        line = " ".join(m.split())
        for s in [*known, "ÄÖ-key-日本語-long"]:
            line = line.replace(s, text.REDACTED)
        return line.replace("?key=abc", "?key=[REDACTED]")[:500]

    assert got == {k: None if m is None else literally(m) for k, m in enumerate(said)}
    assert secrets.redacted(df, kept.limit(0), salt="pepper").where("message like '%REDACTED%'").count() == 40 + 1  # only key parameters
