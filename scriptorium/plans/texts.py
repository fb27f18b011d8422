"""Queries over texts, errors, settings and runs, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, text
from ..operators import captions, dedup, keypool, selection
from ..sources import files


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")


# Injected so that every rule has something to do: the same text in both engines.
TITLE = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'Đặng – ' || text WHEN 1 THEN '  ' || text || ' | Kênh # x' WHEN 2 THEN 'a/b:c*?  😀 “q” ' || text ELSE text END"
MARKED = "'—  x 😀' || text || ' – '"
CAPTION = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '1.2K views · 34 reactions - ' || text || ' - Page name' WHEN 1 THEN '5 lượt xem · 3 lượt thích - ' || text WHEN 2 THEN '12K Views · 7 Reactions - ' ELSE text END"
POST = "CASE CAST(doc_id % 8 AS INT) WHEN 7 THEN 'https://example.com/v' WHEN 6 THEN 'https://m.facebook.com/reel/1' ELSE 'https://www.instagram.com/p/1' END"
MESSAGE = """CASE CAST(event_id % 11 AS INT) WHEN 0 THEN '404 NOT_FOUND: model is unavailable' WHEN 1 THEN '404 file not found' WHEN 2 THEN '503 Service busy' WHEN 3 THEN 'The MODEL is overloaded'
 WHEN 4 THEN '429 RESOURCE_EXHAUSTED retry_delay: "12.5s"' WHEN 5 THEN 'quota: retryDelay=' || CAST(event_id % 50 AS STRING) || 's' WHEN 6 THEN 'ERROR: Private video' WHEN 7 THEN 'This video is not available'
 WHEN 8 THEN 'https://x.example/?key=abc' || CAST(event_id AS STRING) || '&z=1   boom' WHEN 9 THEN NULL ELSE 'other' END"""
VTT = "'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || chr(10) || '1' || chr(10) || '00:00:00.000 --> 00:00:01.000' || chr(10) || '<c>alpha beta</c>' || chr(10) || 'beta' || chr(10) || '2' || chr(10) || '00:00:01.000 --> 00:00:02.000' || chr(10) || 'alpha' || chr(10) || text"
PICK = "CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '1, 3-5; 8' WHEN 1 THEN '9-7 2,2' WHEN 2 THEN 'abc' WHEN 3 THEN '99' WHEN 4 THEN CAST(page_id % 12 AS STRING) || '-' || CAST(page_id % 7 AS STRING) ELSE '1,x;4 5' END"


def t1_fold_marks(spark, d):
    return _docs(spark, d).select("doc_id", text.fold_marks(F.concat(F.lit("Đặng Thị Ngọc Ánh ưỡng ế "), "text")).alias("folded"))


def t3_file_name(spark, d):
    return _docs(spark, d).select("doc_id", text.file_name(F.expr(TITLE)).alias("name"))


def t4_representative_title(spark, d):
    own = _docs(spark, d).select("doc_id", "text", F.expr(CAPTION).alias("title"), F.expr(POST).alias("url"))
    return own.select("doc_id", text.representative_title(F.col("url"), F.col("title"), F.col("text")).alias("title"))


def t6_plain_markdown(spark, d):
    return _docs(spark, d).select("doc_id", text.plain_markdown(F.expr(MARKED)).alias("plain"))


def t7_caption_text(spark, d):
    return _docs(spark, d).select("doc_id", captions.caption_text(F.expr(VTT.replace("chr(10)", "char(10)"))).alias("said"))


def w2_fold(spark, d):
    lines = F.filter(F.split(F.concat(F.lit("alpha beta\nbeta\nalpha\n"), "text"), "\n"), lambda x: x != "")
    kept = captions.folded(lines)
    return _docs(spark, d).select("doc_id", F.size(kept).alias("n_kept"), F.array_join(kept, "|").alias("kept"))


def t8_custom_name(spark, d):
    return _docs(spark, d).select("doc_id", text.custom_name(F.concat(F.lit(" l: "), "text", F.lit(".MP4"))).alias("name"))


def t_small_functions(spark, d):
    n = F.col("doc_id")
    return _docs(spark, d).select(
        "doc_id",
        text.table_title(F.concat(F.lit("a|b"), "text")).alias("table_title"),
        text.stem(n, F.concat(F.lit("N "), n.cast("string"))).alias("stem"),
        text.wikilink_target(text.wikilink(F.concat(F.lit("x"), n.cast("string")))).alias("target"),
        text.duration(F.when(n % 5 > 0, n * 7.5)).alias("duration"),
        text.model_id(F.concat(F.lit("models/m"), n.cast("string"))).alias("model"),
        text.config_key(F.concat(F.lit("save-mp"), n.cast("string"))).alias("config_key"),
        text.number_or(F.when(n % 3 == 0, " 2.5 ").when(n % 3 == 1, "bad"), 60).alias("number"),
        text.title_template((n % 200).cast("string")).alias("template"),
        text.first_line("text").alias("first_line"),
        text.local_title(F.concat(F.lit("/m/d/Clip "), n.cast("string"), F.lit(".final.MP3"))).alias("local_title"),
    )


def t13_redact(spark, d):
    return _events(spark, d).select("event_id", text.redact(F.expr(MESSAGE)).alias("message"))


def f_error_classes(spark, d):
    own = _events(spark, d).select("event_id", F.expr(MESSAGE).alias("m"), F.when(F.col("event_id") % 2 == 0, "free").otherwise("paid").alias("tier"))
    m = F.col("m")
    return own.select("event_id", errors.is_permanent(m).alias("permanent"), errors.is_no_model(m).alias("no_model"), errors.is_transient(m).alias("transient"), errors.is_quota(m).alias("quota"), errors.classify(m, F.col("tier")).alias("class"), errors.retry_delay(m).alias("delay"), errors.cooldown(m).alias("cooldown"))


def f_settings(spark, d):
    n = F.col("event_id")
    own = _events(spark, d).select("event_id", F.when(n % 3 == 0, "").when(n % 3 == 1, " Yes").alias("a"), F.when(n % 2 == 0, "YES").alias("b"), F.when(n % 4 == 0, " 720 ").when(n % 4 == 1, "480").alias("h"), F.array(F.lit("embedContent"), F.when(n % 5 == 0, "generateContent").otherwise("x")).alias("actions"))
    return own.select("event_id", errors.is_yes(F.col("a"), F.col("b")).alias("yes"), errors.max_height(F.col("h")).alias("height"), errors.supports_generate(F.col("actions")).alias("generates"))


def st_waits(spark, d):
    v = F.coalesce("value", F.lit(0.0))
    n = F.col("event_id")
    return _events(spark, d).select("event_id", errors.wait_before_call(v, F.when(n % 3 == 0, v + 10).otherwise(F.lit(0.0)), v - 2, F.lit(4.5)).alias("wait"), errors.backoff((n % 4).cast("int")).alias("backoff"))


def a4_error_counts(spark, d):
    own = _events(spark, d).select("event_id", F.expr(MESSAGE).alias("m"), F.when(F.col("event_id") % 2 == 0, "free").otherwise("paid").alias("tier"))
    return own.groupBy("tier", errors.classify(F.col("m"), F.col("tier")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def a3_successes(spark, d):
    ok = F.coalesce(F.col("event_type") != "error", F.lit(True))
    return _events(spark, d).groupBy("user_id").agg(F.sum(ok.cast("long")).alias("ok"), F.count(F.lit(1)).alias("total"), F.min(ok).alias("all_ok"))


def st5_first_client(spark, d):
    trials = _events(spark, d).select((F.col("event_id") / 5).cast("long").alias("item"), (F.col("event_id") % 5).alias("n"), F.element_at(F.array(*map(F.lit, errors.CLIENTS)), (F.col("event_id") % 5 + 1).cast("int")).alias("client"), F.expr(MESSAGE).alias("message"))
    return keypool.first_client(trials, "item")


def _calls(spark, d) -> DataFrame:
    """A log of calls: an answer has no message, every thirteenth is empty."""
    n = F.col("event_id")
    outcome = F.when(n % 13 == 0, "").otherwise(F.expr(MESSAGE))
    return _events(spark, d).select((n / 12).cast("long").cast("string").alias("run"), n.alias("seq"), F.concat(F.lit("m"), (n % 2).cast("string")).alias("model"), (n % 2).cast("int").alias("model_order"), F.concat(F.lit("k"), (n % 3).cast("string")).alias("key"), F.when(n % 3 == 0, "paid").otherwise("free").alias("tier"), outcome.alias("outcome"))


def st1_pool_runs(spark, d):
    return keypool.run_results(_calls(spark, d))


def a4_call_counts(spark, d):
    return keypool.call_counts(_calls(spark, d))


def a6_models_per_key(spark, d):
    n = F.col("event_id")
    listed = _events(spark, d).select((n % 50).alias("key"), text.model_id(F.when(n % 9 == 0, "models/").otherwise(F.concat(F.lit("models/m"), n.cast("string")))).alias("model"), F.array(F.lit("embedContent"), F.when(n % 4 < 2, "generateContent").otherwise("x")).alias("actions"))
    return keypool.models_per_key(listed)


def j7_trial_plan(spark, d):
    return keypool.trial_plan(spark.createDataFrame([("m0",), ("m1",)], "model string"), f6_usable_keys(spark, d).select("name", "tier"), 2)


def s1_link_items(spark, d):
    return files.items(_docs(spark, d)).select("doc_id", "pos", "item")


def s14_history(spark, d):
    n = F.col("event_id").cast("string")
    line = F.concat(F.lit('{"source": "s'), n, F.lit('", "status": "'), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("done"), F.lit('", "update": true, "usage": [{"model": "m'), n, F.lit('", "attempt": 1, "total": '), n, F.lit('}], "time": "2026-09-07T22:47:09+07:00"}'))
    own = _events(spark, d).select("event_id", files.history_row(line).alias("h"))
    return own.select("event_id", "h.source", "h.status", F.col("h.update").alias("updated"), F.get("h.usage", F.lit(0))["total"].alias("total"), F.unix_timestamp(F.to_timestamp("h.time")).alias("seconds"))


def t18_prompts(spark, d):
    return _docs(spark, d).select("doc_id", text.transcribe_prompt(F.concat(F.lit("T "), F.col("doc_id").cast("string"))).alias("transcribe"), F.md5(text.refine_prompt(F.col("text")).cast("binary")).alias("refine"))


def f6_usable_keys(spark, d):
    n = F.col("event_id")
    names = _events(spark, d).select(n.alias("pos"), F.when(n % 4 == 0, F.concat(F.lit("GEMINI_API_KEY_"), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("GEMINI_API_KEY_FREE_"), n.cast("string"))).when(n % 4 == 2, "OTHER").otherwise("GEMINI_API_KEYS").alias("name"), F.when(n % 7 > 0, n % 500).alias("value_id"), (n % 11 == 0).alias("placeholder"))
    return keypool.usable_keys(names)


def f7_models(spark, d):
    n = F.col("event_id").cast("string")
    return _events(spark, d).select("event_id", F.array_join(keypool.models(F.concat(F.lit(" m"), n), F.concat(F.lit("two, m"), n, F.lit(" ,three,,two"))), ",").alias("models"))


def o4_best_format(spark, d):
    n = F.col("event_id")
    formats = _events(spark, d).select(n, (n / 6).cast("long").alias("media"), F.when(n % 4 > 0, (n % 5) * 360).alias("height"), F.when(n % 3 > 0, (n % 7) * 300).alias("width"), (n % 6 != 1).alias("video"), (n % 2 == 0).alias("audio"))
    ranked = formats.withColumn("rank", errors.format_rank(F.col("height"), F.col("width"), F.col("video"), F.col("audio"), 1080))
    return dedup.best_format(ranked, "media", "rank", "event_id").select("media", "event_id", "rank")


def g1_selection(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(PICK).alias("picked"))
    return p.select("page_id", F.array_join(selection.selection(F.col("picked"), F.lit(8)), ",").alias("chosen"))


def g2_menu_selection(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(PICK).alias("picked"))
    return p.select("page_id", F.array_join(selection.menu_selection(F.col("picked"), F.lit(8)), ",").alias("chosen"))


def g3_pick_by_name(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    listed = p.select(F.concat(F.lit("Clip "), F.col("page_id").cast("string"), F.lit(".MP4")).alias("name"))
    return selection.pick_by_name(listed, p.where("page_id % 3 = 0").select(F.concat(F.lit(" CLIP "), F.col("page_id").cast("string"), F.lit(" ")).alias("wanted")))


def j8_pick_by_number(spark, d):
    p = dedup.numbered(spark.read.parquet(f"{d}/pages.parquet").select("page_id"), "page_id")
    return selection.pick_by_number(p, spark.range(2, 30, 3).select(F.col("id").alias("n"))).select("page_id", "n")


def w3_next_line(spark, d):
    from pyspark.sql import Window

    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


def s7_raw_documents(spark, d):
    body = F.col("text")
    made = F.when(F.col("doc_id") % 3 > 0, files.raw_document(F.concat(F.lit("ref "), F.col("doc_id").cast("string")), body)).otherwise(F.concat(F.lit("# Heading\n> **Reference:** x\n"), body))
    return _docs(spark, d).select("doc_id", files.raw_body(made).alias("body"))


def s12_config(spark, d):
    n = F.col("event_id")
    lines = _events(spark, d).select(n.alias("pos"), F.when(n % 5 == 0, "# comment").when(n % 5 == 1, F.concat(F.lit("  save-mp"), (n % 40).cast("string"), F.lit(": Yes "), n.cast("string"), F.lit("  # c"))).when(n % 5 == 2, F.concat(F.lit("KEY"), (n % 30).cast("string"), F.lit("="), n.cast("string"))).when(n % 5 == 3, "9bad=1").otherwise("").alias("line"))
    return files.config(lines)


def d9_refine_parts(spark, d):
    made = F.concat(F.lit("# Tiêu đề "), F.col("doc_id").cast("string"), F.lit("\n- bài học\n> trích\n***\n# Title\n- lesson one\n- lesson two\n***\n**Reference:** ref "), F.col("doc_id").cast("string"))
    own = _docs(spark, d).select("doc_id", files.refine_parts(made).alias("r"))
    return own.select("doc_id", F.col("r.vi.title").alias("vi_title"), F.col("r.en.title").alias("en_title"), F.array_join("r.en.lessons", "|").alias("lessons"), F.array_join("r.vi.quotes", "|").alias("quotes"), F.col("r.reference").alias("reference"))


def x4_injected_service(spark, d):
    """The call for refined text, with a stand-in that reverses nothing and costs nothing."""
    own = _docs(spark, d)

    def work(service, batch):
        return batch.assign(answer=batch["text"].map(service)).drop(columns=["text"])

    def setup():
        return lambda t: f"{len(t)} characters"

    return keypool.with_service(own, work, "doc_id long, answer string", setup)


QUERIES = {f.__name__: f for f in (t1_fold_marks, t3_file_name, t4_representative_title, t6_plain_markdown, t7_caption_text, w2_fold, t8_custom_name, t_small_functions, t13_redact, f_error_classes, f_settings, st_waits, a4_error_counts, a3_successes, st5_first_client, st1_pool_runs, a4_call_counts, a6_models_per_key, j7_trial_plan, s1_link_items, s14_history, t18_prompts, f6_usable_keys, f7_models, o4_best_format, g1_selection, g2_menu_selection, g3_pick_by_name, j8_pick_by_number, w3_next_line, s7_raw_documents, s12_config, d9_refine_parts, x4_injected_service)}

_D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
_DASH = r"[\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}\x{2212}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"


def _single(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')")


def _fold(x: str) -> str:
    return f"strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))"


def _name(source: str) -> str:
    """CTEs that end in n: the columns of ``source`` and name, the file name of its column s."""
    return rf"""n0 AS ({source}), n1 AS (SELECT *, {_single(rf"regexp_replace(regexp_replace(regexp_replace({_fold(_strip("regexp_extract(s, '(?s)^([^|#]*)', 1)"))}, '{_EMOJI}', '', 'g'), '{_DASH}', '-', 'g'), '[\\/*?:""<>|]', '_', 'g')".replace('""', '"'))} AS x FROM n0),
n2 AS (SELECT *, left(x, 40) AS cut, CASE WHEN contains(left(x, 40), ' ') THEN length(left(x, 40)) - instr(reverse(left(x, 40)), ' ') ELSE -1 END AS last FROM n1),
n AS (SELECT *, CASE WHEN length(x) <= 40 THEN x ELSE regexp_replace(CASE WHEN last >= 15 THEN left(cut, last) ELSE cut END, '[ .,_-]+$', '') END AS name FROM n2)"""


_COUNT = r"(?i)^[\s\x{A0}]*[0-9][0-9.,]*\s*[kmb]?\+?\s*(?:views?|luợt\s*xem)\s*[·-]\s*[0-9][0-9.,]*\s*[kmb]?\+?\s*(?:reactions?|luợt\s*thích)\s*-\s*"
_FOLDED = "list_reduce({0}[2:], lambda a, x: CASE WHEN contains(split_part(a, chr(10), -1), x) THEN a ELSE a || chr(10) || x END, {0}[1])"
_MSG = f"e AS (SELECT event_id, user_id, event_type, value, {MESSAGE} AS m, CASE WHEN event_id % 2 = 0 THEN 'free' ELSE 'paid' END AS tier FROM events)"
_DELAY = r"""TRY_CAST(nullif(regexp_extract(m, '(?i)retry[_ ]?delay[''"]?\s*[:=]\s*[''"]?(\d+(?:\.\d+)?)s', 1), '') AS DOUBLE)"""
_CLS = ", c AS (SELECT *, coalesce(regexp_matches(lower(m), '404|not found|not supported') AND contains(lower(m), 'model'), false) AS no_model, coalesce(regexp_matches(lower(m), '503|unavailable|high demand|overloaded'), false) AS transient, coalesce(regexp_matches(lower(m), '429|resource_exhausted|quota|rate limit|too many requests'), false) AS quota, coalesce(regexp_matches(lower(m), 'private video|removed by the uploader|account associated with this video has been terminated|members-only'), false) AS permanent FROM e), k AS (SELECT *, CASE WHEN m IS NULL THEN 'ok' WHEN no_model THEN 'no_model' WHEN tier = 'free' AND transient THEN 'transient' WHEN tier = 'free' AND quota THEN 'quota' ELSE 'other' END AS class FROM c)"
_TOK = "list_filter(list_transform(string_split(translate(picked, '; ', ',,'), ','), lambda t: trim(t)), lambda t: t <> '')"
_SPREAD = "list_sort(list_distinct(flatten(list_transform({t}, lambda t: {f}))))"

ORACLE = {
    "t1_fold_marks": f"WITH {_D} SELECT doc_id, {_fold("'Đặng Thị Ngọc Ánh ưỡng ế ' || text")} AS folded FROM d",
    "t3_file_name": f"WITH {_D}, " + _name(f"SELECT doc_id, {TITLE} AS s FROM d") + " SELECT doc_id, name FROM n",
    "t4_representative_title": rf"""WITH {_D}, a AS (SELECT doc_id, text, {CAPTION} AS title, {POST} AS url FROM d), b AS (SELECT *, regexp_matches(title, '{_COUNT}') AS hit FROM a),
c AS (SELECT *, CASE WHEN hit THEN {_strip(f"regexp_replace(title, '{_COUNT}', '')")} ELSE title END AS cap FROM b),
f AS (SELECT *, CASE WHEN hit AND contains(cap, ' - ') THEN {_strip("left(cap, length(cap) - (instr(reverse(cap), ' - ') + 2))")} ELSE cap END AS named FROM c)
SELECT doc_id, CASE WHEN url = 'https://example.com/v' THEN title WHEN named <> '' THEN named WHEN text <> '' AND {_single("text")} <> '' THEN array_to_string(string_split({_single("text")}, ' ')[1:12], ' ') ELSE title END AS title FROM f""",
    "t6_plain_markdown": f"WITH {_D} SELECT doc_id, {_strip(rf"regexp_replace(regexp_replace(regexp_replace({MARKED}, '{_DASH}', '-', 'g'), '{_EMOJI}', '', 'g'), '[ \t]{{2,}}', ' ', 'g')")} AS plain FROM d",
    "t7_caption_text": rf"""WITH {_D}, a AS (SELECT doc_id, regexp_split_to_array({VTT}, '\r\n|\r|\n') AS ls FROM d),
b AS (SELECT doc_id, list_filter(list_transform(list_filter(list_zip(ls, list_concat(ls[2:], [''])), lambda z: {_strip("z[1]")} <> '' AND NOT regexp_matches({_strip("z[1]")}, '^(WEBVTT|Language:|Kind:)') AND NOT contains(z[1], '-->') AND NOT contains(z[2], '-->')), lambda z: regexp_replace({_strip("z[1]")}, '<[^>]+>', '', 'g')), lambda x: x <> '') AS kept FROM a)
SELECT doc_id, regexp_replace(replace({_FOLDED.format("kept")}, chr(10), ' '), '([.!?])[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', '\1' || chr(10) || chr(10), 'g') AS said FROM b""",
    "w2_fold": f"WITH {_D}, a AS (SELECT doc_id, list_filter(string_split('alpha beta' || chr(10) || 'beta' || chr(10) || 'alpha' || chr(10) || text, chr(10)), lambda x: x <> '') AS ls FROM d), b AS (SELECT doc_id, string_split({_FOLDED.format('ls')}, chr(10)) AS kept FROM a) SELECT doc_id, CAST(len(kept) AS INT) AS n_kept, array_to_string(kept, '|') AS kept FROM b",
    "t8_custom_name": rf"""WITH {_D}, a AS (SELECT doc_id, regexp_replace({_single(r"regexp_replace(regexp_replace(" + _strip("' l: ' || text || '.MP4'") + r", '(?i)\.mp[34]$', ''), '[\\/*?:" + '"' + r"<>|]', '_', 'g')")}, '\.+$', '') AS x FROM d)
SELECT doc_id, left(x, (SELECT max(n) FROM range(1, 121) r(n) WHERE n + length(regexp_replace(left(x, CAST(n AS INT)), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) <= 120)) AS name FROM a""",
    "t_small_functions": rf"""WITH {_D} SELECT doc_id, 'a-b' || translate(text, '|', '-') AS table_title, CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END || '_N ' || doc_id AS stem, 'x' || doc_id AS target,
CASE WHEN doc_id % 5 = 0 OR doc_id = 0 THEN '  --  ' ELSE printf('%3d:%02d', CAST(floor(floor(doc_id * 7.5) / 60) AS BIGINT), CAST(floor(doc_id * 7.5) AS BIGINT) % 60) END AS duration, 'm' || doc_id AS model, 'SAVE_MP' || doc_id AS config_key,
CAST(CASE WHEN doc_id % 3 = 0 THEN 2.5 ELSE 60.0 END AS DOUBLE) AS number, '%(title).' || CASE WHEN doc_id % 200 BETWEEN 80 AND 180 THEN doc_id % 200 ELSE 150 END || 'B.%(ext)s' AS template, left(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')[1], 160) AS first_line, 'Clip ' || doc_id || '.final' AS local_title FROM d""",
    "t13_redact": rf"WITH {_MSG} SELECT event_id, left(regexp_replace({_single('m')}, '(?i)([?&](?:key|api[_-]?key)=)[^&\s]+', '\1[REDACTED]', 'g'), 500) AS message FROM e",
    "f_error_classes": f"WITH {_MSG}{_CLS} SELECT event_id, permanent, no_model, transient, quota, class, {_DELAY} AS delay, coalesce({_DELAY}, 60.0) AS cooldown FROM k",
    "f_settings": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN true ELSE event_id % 2 = 0 END AS yes, CASE WHEN event_id % 4 = 0 THEN 720 ELSE 1080 END AS height, event_id % 5 = 0 AS generates FROM events",
    "st_waits": "SELECT event_id, greatest(0.0, CASE WHEN event_id % 3 = 0 THEN v + 10 ELSE 0.0 END - v, (v - 2) + 4.5 - v) AS wait, CASE WHEN event_id % 4 < 2 THEN least(30.0, 3.0 * pow(2.0, event_id % 4)) END AS backoff FROM (SELECT event_id, coalesce(value, 0.0) AS v FROM events)",
    "a4_error_counts": f"WITH {_MSG}{_CLS} SELECT tier, class, count(*) AS n FROM k GROUP BY tier, class",
    "a3_successes": "SELECT user_id, CAST(sum(CASE WHEN coalesce(event_type <> 'error', true) THEN 1 ELSE 0 END) AS BIGINT) AS ok, count(*) AS total, bool_and(coalesce(event_type <> 'error', true)) AS all_ok FROM events GROUP BY user_id",
    "st5_first_client": f"WITH {_MSG}{_CLS}, t AS (SELECT event_id // 5 AS item, event_id % 5 AS n, ['default', 'android', 'ios', 'mweb', 'tv'][event_id % 5 + 1] AS client, m, permanent FROM k), s AS (SELECT item, least(min(CASE WHEN permanent THEN n END), min(CASE WHEN m IS NULL THEN n END)) AS stop FROM t GROUP BY item) SELECT item, arg_min(client, n) FILTER (WHERE m IS NULL) AS client, count(*) AS tried FROM t JOIN s USING (item) WHERE stop IS NULL OR n <= stop GROUP BY item",
    "f6_usable_keys": "WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GEMINI_API_KEY_' || event_id WHEN 1 THEN 'GEMINI_API_KEY_FREE_' || event_id END AS name, event_id % 500 AS v FROM events WHERE event_id % 4 < 2 AND event_id % 7 > 0 AND event_id % 11 > 0) SELECT name, CASE WHEN contains(name, 'FREE') THEN 'free' ELSE 'paid' END AS tier, CAST(CASE WHEN contains(name, 'FREE') THEN 4.5 ELSE 0.5 END AS DOUBLE) AS interval FROM (SELECT arg_min(name, event_id) AS name FROM a GROUP BY v)",
    "f7_models": "SELECT event_id, 'm' || event_id || ',two,three' AS models FROM events",
    "o4_best_format": """WITH f AS (SELECT event_id, event_id // 6 AS media, CASE WHEN event_id % 4 > 0 THEN (event_id % 5) * 360 END AS h, CASE WHEN event_id % 3 > 0 THEN (event_id % 7) * 300 END AS w, event_id % 6 <> 1 AS v, event_id % 2 = 0 AS a FROM events),
r AS (SELECT *, CASE WHEN v AND NOT a AND h <= 1080 THEN 1 WHEN v AND a AND h <= 1080 THEN 2 WHEN v AND NOT a AND w <= 1080 THEN 3 WHEN v AND a AND w <= 1080 THEN 4 WHEN v AND a THEN 5 END AS rank FROM f)
SELECT media, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY rank, event_id) AS n FROM r WHERE rank IS NOT NULL) WHERE n = 1""",
    "g1_selection": f"""WITH p AS (SELECT page_id, {PICK} AS picked FROM pages), t AS (SELECT page_id, {_TOK} AS t FROM p), c AS (SELECT page_id, len(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+(-[0-9]+)?'))) = 0 AS good, t FROM t),
x AS (SELECT page_id, unnest(t) AS tok FROM c WHERE good), y AS (SELECT page_id, CAST(split_part(tok, '-', 1) AS BIGINT) AS a, CAST(CASE WHEN contains(tok, '-') THEN split_part(tok, '-', 2) ELSE tok END AS BIGINT) AS b FROM x),
z AS (SELECT DISTINCT page_id, unnest(range(greatest(least(a, b), 1), least(greatest(a, b), 8) + 1)) AS v FROM y), s AS (SELECT page_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS chosen FROM z GROUP BY page_id)
SELECT page_id, chosen FROM p LEFT JOIN s USING (page_id)""",
    "g2_menu_selection": f"""WITH p AS (SELECT page_id, {PICK} AS picked FROM pages), x AS (SELECT page_id, unnest(string_split(translate(replace(picked, ' ', ''), ';', ','), ',')) AS tok FROM p), g AS (SELECT * FROM x WHERE regexp_full_match(tok, '[0-9]+(-[0-9]+)?')),
y AS (SELECT page_id, contains(tok, '-') AS r, CAST(split_part(tok, '-', 1) AS BIGINT) AS a, CAST(CASE WHEN contains(tok, '-') THEN split_part(tok, '-', 2) ELSE tok END AS BIGINT) AS b FROM g),
z AS (SELECT DISTINCT page_id, unnest(CASE WHEN r THEN range(least(greatest(least(a, b), 1), 8), least(greatest(greatest(a, b), 1), 8) + 1) WHEN a BETWEEN 1 AND 8 THEN [a] ELSE [] END) AS v FROM y), s AS (SELECT page_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS chosen FROM z GROUP BY page_id)
SELECT page_id, coalesce(chosen, '') AS chosen FROM p LEFT JOIN s USING (page_id)""",
    "g3_pick_by_name": "SELECT 'Clip ' || page_id || '.MP4' AS name FROM pages WHERE page_id % 3 = 0",
    "j8_pick_by_number": "SELECT page_id, n FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages) WHERE n BETWEEN 2 AND 29 AND n % 3 = 2",
    "w3_next_line": "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations",
    "s7_raw_documents": rf"WITH {_D} SELECT doc_id, nullif({_strip("CASE WHEN doc_id % 3 > 0 THEN text ELSE '# Heading' || chr(10) || '> **Reference:** x' || chr(10) || text END")}, '') AS body FROM d",
    "s12_config": "WITH a AS (SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'SAVE_MP' || event_id % 40 ELSE 'KEY' || event_id % 30 END AS key, CASE WHEN event_id % 5 = 1 THEN 'Yes ' || event_id ELSE CAST(event_id AS VARCHAR) END AS value FROM events WHERE event_id % 5 IN (1, 2)) SELECT key, arg_min(value, event_id) AS value FROM a GROUP BY key",
    "d9_refine_parts": "SELECT doc_id, 'Tiêu đề ' || doc_id AS vi_title, 'Title' AS en_title, 'lesson one|lesson two' AS lessons, 'trích' AS quotes, 'ref ' || doc_id AS reference FROM documents",
    "x4_injected_service": f"WITH {_D} SELECT doc_id, length(text) || ' characters' AS answer FROM d",
}

_CALLS = f"WITH {_MSG.replace(MESSAGE + ' AS m', 'CASE WHEN event_id % 13 = 0 THEN chr(0) ELSE ' + MESSAGE + ' END AS m').replace('event_id % 2 = 0', 'event_id % 3 <> 0')}{_CLS}, r AS (SELECT *, event_id // 12 AS run, 'm' || event_id % 2 AS model, 'k' || event_id % 3 AS key, CASE WHEN m = chr(0) THEN 'empty' ELSE class END AS kind FROM k)"
ORACLE |= {
    "st1_pool_runs": _CALLS
    + " SELECT CAST(run AS VARCHAR) AS run, CASE WHEN count(*) FILTER (WHERE kind = 'ok') > 0 THEN 'ok' WHEN arg_max(kind, event_id) = 'transient' THEN 'busy' ELSE 'exhausted' END AS result, arg_min(model, event_id) FILTER (WHERE kind = 'ok') AS model, arg_min(key, event_id) FILTER (WHERE kind = 'ok') AS key, count(*) FILTER (WHERE kind IN ('ok', 'empty') AND tier = 'free') AS calls_free, count(*) FILTER (WHERE kind IN ('ok', 'empty') AND tier <> 'free') AS calls_paid, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE kind = 'no_model'), '') AS bad_models FROM r GROUP BY run",
    "a4_call_counts": _CALLS + " SELECT tier, count(*) AS calls FROM r WHERE kind IN ('ok', 'empty') GROUP BY tier",
    "a6_models_per_key": "SELECT event_id % 50 AS key, count(*) FILTER (WHERE event_id % 4 < 2 AND event_id % 9 <> 0) AS models FROM events GROUP BY 1",
    "j7_trial_plan": f"WITH k AS ({ORACLE['f6_usable_keys']}), m AS (SELECT unnest(['m0', 'm1']) AS model) SELECT model, a AS attempt, name, tier FROM m, k, (SELECT unnest([0, 1]) AS a) WHERE tier = 'free' UNION ALL SELECT model, 2, name, tier FROM m, k WHERE tier = 'paid'",
    "s1_link_items": rf"WITH {_D}, l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS n FROM d) SELECT doc_id, CAST(n - 1 AS INT) AS pos, {_strip('line')} AS item FROM l WHERE {_strip('line')} <> ''",
    "s14_history": "SELECT event_id, 's' || event_id AS source, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, true AS updated, event_id AS total, CAST(1788796029 AS BIGINT) AS seconds FROM events",
    "t18_prompts": rf"""WITH {_D} SELECT doc_id, 'Transcribe all speech of the recording "T ' || doc_id || '" as plain text, in its own language, without comments.' AS transcribe, md5('Summarise the transcript in Vietnamese, then after a line with *** in English. Each half: a title, a summary of three sentences, a bulleted list of lessons, quotes.' || chr(10) || chr(10) || text) AS refine FROM d""",
}
