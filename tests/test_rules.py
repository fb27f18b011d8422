"""Literal cases of the rules."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import errors as E
from scriptorium.functions import text as T
from scriptorium.functions import urls as U
from scriptorium.operators import captions, dedup, keypool, manifest, reconcile, selection
from scriptorium.sources import files


@pytest.fixture
def value(spark):
    def apply(f, *args):
        row = spark.createDataFrame([args], ", ".join(f"a{i} {'double' if isinstance(a, float) else 'string'}" for i, a in enumerate(args)))
        return row.select(f(*(F.col(f"a{i}") for i in range(len(args)))).alias("x")).first()["x"]

    return apply


@pytest.mark.parametrize(
    "link, key",
    [
        ("https://youtu.be/abc123?si=tracking", "youtube:abc123"),
        ("https://www.youtube.com/watch?v=abc123&utm_source=x", "youtube:abc123"),
        ("https://m.youtube.com/shorts/abc123", "youtube:abc123"),
        ("https://www.facebook.com/reel/123?fbclid=abc&utm_source=x", "https://facebook.com/reel/123"),
        (" HTTPS://WWW.Example.com:8080/a/?q=1&&x&SI=2&z=a*~+c#f ", "https://example.com:8080/a?q=1&x=&z=a%2A~+c"),
        ("https://facebook.com/a b?x=1", "https://facebook.com/a b?x=1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(value, link, key):
    assert value(U.canonical_url, link) == key


def test_link_predicates(value):
    assert not value(U.is_channel, "https://www.facebook.com/share/x")
    assert value(U.is_channel, "https://www.youtube.com/@example/videos")
    assert not value(U.is_channel, "https://www.youtube.com/watch?v=abc&list=xyz")
    assert value(U.is_url, " https://a.b/c d")
    assert not value(U.is_url, "a.b/c")
    assert value(U.is_social, "https://m.facebook.com/x")
    assert not value(U.is_social, "https://notfacebook.com/x")
    assert value(U.channel_url, "https://www.youtube.com/@h/") == "https://www.youtube.com/@h/videos"


def test_one_bad_link_rejects_all(value):
    assert value(U.split_links, "https://a.b/c, https://x.y;") == ["https://a.b/c", "https://x.y"]
    with pytest.raises(Exception, match="not a link"):
        value(U.split_links, "https://a.b/c, nope")


def test_names(value):
    alphabet = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđĐ"
    assert value(T.fold_marks, alphabet) == "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "dD"
    assert value(T.file_name, "“Curly” name | Channel") == "“Curly” name"
    assert value(T.shorten, "a" * 14 + " " + "b" * 40) == "a" * 14 + " " + "b" * 25
    assert value(T.shorten, "a" * 15 + " " + "b" * 40) == "a" * 15
    assert value(T.custom_name, " lesson: one.mp4 ") == "lesson_ one"
    assert value(T.custom_name, "😀" * 70) == "😀" * 60
    with pytest.raises(Exception, match="empty"):
        value(T.custom_name, " .mp4 ")
    assert value(T.duration, 0.0) == "  --  " and value(T.duration, 125.0) == "  2:05"
    assert value(T.local_title, "/a/b/c.d.mp3") == "c.d"


def test_titles_of_posts(value):
    post = "https://www.facebook.com/reel/1"
    assert value(T.representative_title, post, "1.2K views · 34 reactions - Caption - Page", "") == "Caption"
    assert value(T.representative_title, post, "1K views · 3 reactions - ", "a b c d e f g h i j k l m") == "a b c d e f g h i j k l"
    # The counters' second words are only known in the spelling that the source uses.
    assert value(T.representative_title, post, "5 lượt xem · 3 lượt thích - x", "") == "5 lượt xem · 3 lượt thích - x"
    assert value(T.representative_title, "https://example.com/v", "1K views · 3 reactions - x", "") == "1K views · 3 reactions - x"


def test_captions(value):
    vtt = "WEBVTT\n\n1\n00:00.000 --> 00:01.000\nHello.\n\n2\n00:01.000 --> 00:02.000\nHello.\n<c>World!</c>\n"
    assert value(captions.caption_text, vtt) == "Hello.\n\nWorld!"
    assert value(lambda s: captions.folded(F.split(s, ",")), "alpha beta,beta,alpha") == ["alpha beta"]
    assert value(captions.caption_text, "") == ""


def test_selections(value):
    pick = lambda s: selection.selection(s, F.lit(8))
    menu = lambda s: selection.menu_selection(s, F.lit(8))
    assert value(pick, "1, 3-5; 8") == [1, 3, 4, 5, 8]
    assert value(pick, "abc") is None and value(pick, "99") is None and value(pick, "") is None
    assert value(pick, "5-3 2") == [2, 3, 4, 5]
    assert value(pick, "4-0") == [1, 2, 3, 4]
    assert value(menu, "1 2,7-99;x") == [7, 8]  # "1 2" is twelve there
    assert value(menu, "12-20") == [8]


def test_errors(value):
    assert value(E.retry_delay, "Retry_delay: '12.5s'") == 12.5
    assert value(E.cooldown, "quota") == 60.0
    assert not value(E.is_permanent, "This video is not available")
    assert value(lambda m: E.classify(m, F.lit("free")), "404 file not found") == "other"
    assert value(lambda m: E.classify(m, F.lit("paid")), "503") == "other"
    assert value(lambda m: T.redact(m, ["s3cret"]), "u?key=s3cret  s3cret") == "u?key=[REDACTED] [REDACTED]"
    assert value(lambda u: E.clients(u, F.lit("ios")), "https://youtu.be/x") == ["ios", "default", "android", "mweb", "tv"]
    assert value(lambda u: E.clients(u), "https://facebook.com/x") == ["default"]


ROW = "| 1 | https://example.com/known | Known | 01/01/26 00:00:00 | [[001_Old_raw]] | | Raw only |"


@pytest.fixture
def table(frame):
    return manifest.parse(frame([(0, ""), (1, "| STT | Link | a | b | c | d | e |"), (2, ROW), (3, ROW.replace("| 1 |", "| 7 |"))], "pos int, line string"))


def test_manifest_scan(table):
    assert [r["stt"] for r in table.orderBy("pos").collect()] == [1, 7]
    assert manifest.known_keys(table).first()["stt"] == 7
    assert manifest.highest(table.limit(0)).first()["stt_max"] == 0


RESULT = "url string, title string, raw_name string, refine_name string, stt long, `order` long"


def test_upsert_updates_the_first_row_only_and_keeps_its_time(frame, table):
    merged = manifest.upsert(table, frame([("https://www.example.com/known/", "A|b", "n_raw", None, None, 0), ("https://new.com/a", "New", "a_raw", "a_refine", None, 1)], RESULT), F.lit("now")).orderBy("pos").collect()
    assert [(r["stt"], r["title"], r["ts"], r["status"]) for r in merged] == [(8, "New", "now", "Done"), (1, "A-b", "01/01/26 00:00:00", "Raw only"), (7, "Known", "01/01/26 00:00:00", "Raw only")]


def test_failure_of_an_unknown_link_writes_no_row(frame, table):
    marked = manifest.mark_failures(table, frame([("https://nowhere.com/x", "r", 0), ("https://example.com/known", "y" * 100, 1)], "url string, reason string, `order` int")).orderBy("pos").collect()
    assert [r["status"] for r in marked] == ["Failed: " + "y" * 80, "Raw only"]


def test_repeated_new_link_shares_a_number(frame, table):
    links = frame([(0, "https://n.com/1"), (1, "https://example.com/known"), (2, "https://n.com/2"), (3, "https://n.com/1/")], "pos long, url string")
    assert [r["stt"] for r in manifest.assign_numbers(links, table).orderBy("pos").collect()] == [8, 7, 9, 8]


def test_rename_plan(frame, table):
    plan = lambda *stems: {r["stt"]: r["action"] for r in reconcile.rename_plan(table, frame([(s,) for s in stems], "stem string")).collect()}
    assert plan("001_Old_raw") == {1: "rename", 7: "rename"}
    assert plan("001_Old_raw", "001_Known_raw") == {1: "relink", 7: "rename"}
    assert plan("other") == {1: "skip", 7: "skip"}


CALLS = "run string, seq int, model string, key string, tier string, outcome string"


def test_runs_of_logged_calls(frame):
    rows = [("busy", 0, "m", "k", "free", "429 quota"), ("busy", 1, "m", "k", "free", "503 busy")]
    rows += [("next", 0, "a", "k", "free", "404 NOT_FOUND: model is unavailable"), ("next", 1, "b", "k", "free", ""), ("next", 2, "b", "p", "paid", None)]
    rows += [("none", 0, "a", "k", "free", "404 file not found"), ("none", 1, "a", "p", "paid", "503")]
    found = {r["run"]: r for r in keypool.run_results(frame(rows, CALLS)).collect()}
    assert (found["busy"]["result"], found["busy"]["calls_free"]) == ("busy", 0)
    assert (found["next"]["result"], found["next"]["model"], found["next"]["key"], found["next"]["bad_models"]) == ("ok", "b", "p", "a")
    assert (found["next"]["calls_free"], found["next"]["calls_paid"]) == (1, 1)
    assert (found["none"]["result"], found["none"]["key"], found["none"]["bad_models"]) == ("exhausted", None, "")
    assert {r["tier"]: r["calls"] for r in keypool.call_counts(frame(rows, CALLS)).collect()} == {"free": 1, "paid": 1}


def test_trial_order(frame):
    keys = frame([("GEMINI_API_KEY_2", "paid"), ("GEMINI_API_KEY_FREE_2", "free"), ("GEMINI_API_KEY_FREE_10", "free"), ("GEMINI_API_KEY_10", "paid")], "name string, tier string")
    assert [r["name"] for r in keypool.trial_order(keys).collect()] == ["GEMINI_API_KEY_FREE_10", "GEMINI_API_KEY_FREE_2", "GEMINI_API_KEY_10", "GEMINI_API_KEY_2"]


def test_clients_give_way(frame):
    def call(url, client):
        if url == "gone":
            raise ValueError("ERROR: Private video")
        if client != "ios":
            raise ValueError("try another")
        return f"{url} by {client}"

    rows = frame([(1, "u", ["default", "ios", "tv"]), (2, "gone", ["default", "ios"]), (3, "u", ["tv"]), (4, "u", [])], "id int, url string, clients array<string>")
    found = {r["id"]: (r["client"], r["result"], r["tried"]) for r in keypool.with_clients(rows, call, key="id", clock=lambda: 0.0).collect()}
    assert found == {1: ("ios", "u by ios", 2), 2: (None, None, 1), 3: (None, None, 1), 4: (None, None, 0)}


def test_transcription_waits_for_the_upload(frame):
    def upload(path):
        return [path, 0]

    def state(handle):
        handle[1] += 1
        return "FAILED" if handle[0] == "bad" else "PROCESSING" if handle[1] < 3 else "ACTIVE"

    found = keypool.transcribed(frame([("a",), ("bad",)], "path string"), upload, state, lambda h: f"text of {h[0]} after {h[1]}", sleep=lambda s: None)
    assert {r["path"]: r["text"] for r in found.collect()} == {"a": "text of a after 3", "bad": None}


def test_models(value):
    assert value(keypool.models, "one", "two, one ,three") == ["one", "two", "three"]
    with pytest.raises(Exception, match="no model"):
        value(keypool.models, "", " ,")


def test_first_wins_and_numbers(frame):
    rows = frame([(5, "a", 1), (3, "a", 2), (70000, "b", 3), (4, None, 4)], "n int, k string, x int")
    assert sorted(r["x"] for r in dedup.first_wins(rows, "k", "n").collect()) == [2, 3, 4]
    assert [(r["n"], r["i"]) for r in dedup.numbered(rows, "n", "i").orderBy("n").collect()] == [(3, 1), (4, 2), (5, 3), (70000, 4)]
    assert dedup.first_wins(rows.limit(0), "k", "n").count() == 0
    wide = [-(1 << 62), -70_000, -1, 0, 65_536, 1 << 33, (1 << 33) + 1, 1 << 50, (1 << 63) - 1]
    spread = dedup.numbered(frame([(n,) for n in wide], "n long"), "n", "i")
    assert [r["i"] for r in spread.orderBy("n").collect()] == list(range(1, len(wide) + 1))


def test_captions_by_any_prefix(frame):
    media = frame([("abc",), ("abcd",), ("x",), ("x",), ("",), (None,)], "media_id string")
    named = frame([("abc.en.vtt",), ("abcd.vi.srt",), ("x.vi.vtt",), ("x1.en.vtt",), ("q.vtt",)], "name string")
    assert {r["media_id"]: r["name"] for r in captions.choose_caption(media, named).collect()} == {"abc": "abc.en.vtt", "abcd": "abcd.vi.srt", "x": "x1.en.vtt"}


def test_batch_scan(frame):
    lines = frame([(0, "|1|a|b|c|"), (1, "x"), (2, "| STT | Link |"), (3, "|---|---|"), (4, "|| 12 | ht tp://a | t | 1 |"), (5, "| 08 | b |"), (6, "| -3 | c |"), (7, "")], "pos int, line string")
    assert [(r["stt"], r["link"], r["third"]) for r in manifest.parse_batch(lines).orderBy("pos").collect()] == [(12, "http://a", " t "), (-3, "c", None)]


def test_pages_are_clamped(frame):
    rows = frame([(i,) for i in range(1, 46)], "n int")
    assert [dedup.page(rows, "n", p).count() for p in (-1, 0, 2, 9)] == [20, 20, 5, 5]


def test_documents(value):
    assert value(files.raw_body, "> **Reference:** x\n\nbody ") == "body"
    assert value(files.raw_body, "# H\n> **Reference:** x\n") == "# H\n> **Reference:** x"
    assert value(files.raw_body, "> a Reference: b\n") is None
    parts = value(files.refine_parts, "# T\n- l\n---\n# E\n> q\n---\n**Reference:** r")
    assert (parts["vi"]["title"], parts["en"]["quotes"], parts["reference"]) == ("T", ["q"], "r")
    assert value(files.mp3_url, '<meta property="og:audio" content="u"> https://x/y.mp3') == "u"
    assert value(files.mp3_url, "z https://x/y.mp3 ") == "https://x/y.mp3"
    assert value(files.mp3_url, "none") is None


def test_config(frame):
    lines = frame([(0, "save-mp4: Yes  # c"), (1, "MODEL=from-file"), (2, "save_mp4=No"), (3, "# x")], "pos int, line string")
    own = frame([("MODEL", "own")], "key string, value string")
    assert {r["key"]: r["value"] for r in files.config(lines, own).collect()} == {"SAVE_MP4": "Yes", "MODEL": "own"}
