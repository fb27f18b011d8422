"""Queries that go through files, tables and rounds: commits, numbered lines, rename orders, logs; with the same rules in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keypool, keytable, renames, scans, secrets, tables
from ..sources import files
from ..streaming import ledger, rests
from . import links
from .texts import MESSAGE, _docs, _single, f6_usable_keys
from .texts import ORACLE as TEXTS

# Links of every kind, some of them missing.
LINK = f"CASE WHEN page_id % 50 IN (13, 14) THEN NULL ELSE {links.LINK} END"
BATCH = "CAST(FLOOR(page_id / 2) % 3 AS INT)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").select("page_id", F.trim(F.expr(LINK)).alias("url"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every second link, the null ones among them."""
    p = F.col("page_id")
    own = _pages(spark, d).where("page_id % 2 = 0")
    n = p.cast("string")
    return own.select((-p).alias("pos"), (p + 1).alias("stt"), "url", F.concat(F.lit("Title "), n).alias("title"), F.lit("01/09/26 10:20:30").alias("ts"), F.concat(F.lit("[["), n, F.lit("_raw]]")).alias("raw_link"), F.lit("").alias("refine_link"), F.lit("Raw only").alias("status"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Results of every page in three batches; a fifth of them failed."""
    p = F.col("page_id")
    n = p.cast("string")
    return _pages(spark, d).select("url", F.concat(F.lit("New|"), n).alias("title"), F.concat(F.lit("r"), n, F.lit("_raw")).alias("raw_name"), F.when(p % 2 == 0, F.concat(F.lit("r"), n, F.lit("_refine"))).alias("refine_name"), F.lit(None).cast("long").alias("stt"), p.alias("order"), F.when(p % 5 == 3, F.concat(F.lit("reason "), n)).alias("reason"), F.expr(BATCH).alias("batch"))


def st6_ledger(spark, d):
    """Three commits with a compaction between, one of them twice."""
    book = ledger.Ledger(spark, tables.new_path(spark, "ledger"), buckets=8)
    book.create(_manifest(spark, d))
    results = _results(spark, d)
    for number in (0, 1, 1, 2):
        book.commit(results.where(F.col("batch") == number).drop("batch"), number, F.lit("02/09/26 00:00:00"))
        if number == 1:
            book.compact(least=2)
    return book.read()


def s1_numbered_lines(spark, d):
    """Texts of conversations as a folder of text files, their lines numbered over all files."""
    said = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.coalesce("text", F.lit("")).alias("url"))
    folder = tables.new_path(spark, "said")
    files.write_links(said, folder)
    return files.link_list(spark, folder).select("n", "item")


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """Groups of eight names: a chain, a ring, two that want one name, one without a file, a chain whose end is taken."""
    p = F.col("page_id")
    group, k = F.floor(p / 8), p % 8
    n = lambda x: F.concat(F.lit("n"), (group * 8 + x).cast("string"))
    to = F.when(group % 4 == 0, F.when(k < 7, n(k + 1)).otherwise(F.concat(F.lit("z"), group.cast("string"))))
    to = to.when(group % 4 == 1, n((k + 1) % 8)).when(group % 4 == 2, F.when(k < 3, n(F.lit(100_000_000))).when(k < 6, n(k + 1)))
    return _pages(spark, d).select(n(k).alias("old"), to.otherwise(F.when(k < 5, n(k + 1)).when(k == 6, n(F.lit(200_000_000)))).alias("new"))


def k7_rename_steps(spark, d):
    names = _pages(spark, d).where("page_id % 8 <> 6 or page_id % 32 < 16").select(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"))
    return renames.rename_steps(_wanted(spark, d), names)


# A log of as many events as there are turns.
LOG = "SELECT conv_id * 1000 + turn AS event_id, conv_id FROM conversations"
CLIENT = "CASE WHEN event_id % 5 = 2 THEN 'ios' WHEN event_id % 35 = 7 THEN 'vr' WHEN event_id % 101 = 0 THEN 'tv' END"
RUN = "CASE WHEN event_id % 3 = 0 THEN 'hot' WHEN event_id % 50 = 1 THEN NULL ELSE 'r' || CAST(FLOOR(conv_id / 4) AS BIGINT) END"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "conv_id")


def st5_pinned_clients(spark, d):
    own = _log(spark, d).select(F.expr(RUN).alias("run"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "https://example.com/a").otherwise("https://youtu.be/x").alias("url"), F.expr(CLIENT).alias("client"))
    return scans.pinned_clients(own).select("run", "seq", "pinned", F.array_join("clients", ",").alias("clients"))


def st3_key_rests(spark, d):
    n = F.col("event_id")
    calls = _log(spark, d).select(F.concat(F.lit("k"), F.when(n % 3 == 0, 0).otherwise(n % 40).cast("string")).alias("key"), F.when(n % 4 < 3, "free").otherwise("paid").alias("tier"), F.timestamp_seconds(1_700_000_000 + n).alias("at"), F.when(n % 6 > 0, F.expr(MESSAGE)).alias("message"), F.when(n % 4 < 3, 4.5).otherwise(0.5).alias("interval"))
    return rests.key_rests(calls)


def j2_bucketed_links(spark, d):
    """Known keys in a bucketed table, to which every fourth page's are added before the links come."""
    name = tables.new_path(spark, "keys").rsplit("/", 1)[1].replace("-", "_")
    keytable.create(links._manifest(spark, d), name, buckets=8)
    own = links.links(spark, d)
    keytable.add(own.where("page_id % 4 = 1"), name, buckets=8)
    return keytable.new_links(own, name).select("page_id", "url_key")


def o1_trial_order(spark, d):
    return keypool.trial_places(f6_usable_keys(spark, d)).select("name", "tier", "place")


def d9_notes_of_documents(spark, d):
    """Notes made of the documents' own lines, with both kinds of rules and halves that are missing."""
    n = F.col("doc_id")
    rule = F.when(n % 3 == 0, "\n---\n").otherwise("\n***\n")
    lessons = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"(?m)^", "- ")
    first = F.concat(F.lit("# Tiêu đề "), n.cast("string"), F.lit("\n"), lessons)
    second = F.concat(F.lit("## Title\n> "), F.regexp_replace(F.left("text", F.lit(80)), r"[\r\n]+", " "))
    note = F.concat(first, F.when(n % 4 > 0, F.concat(rule, second)).otherwise(""), rule, F.lit("**Reference:** ref "), n.cast("string"))
    own = _docs(spark, d).select("doc_id", files.refine_parts(note).alias("r"))
    return own.select("doc_id", F.col("r.vi.title").alias("vi_title"), F.size("r.vi.lessons").alias("n_lessons"), F.md5(F.array_join("r.vi.lessons", "|").cast("binary")).alias("lessons_md5"), F.col("r.en.title").alias("en_title"), F.array_join("r.en.quotes", "|").alias("quotes"), F.col("r.reference").alias("reference"))


SALT, SECRETS = "pepper", 1000


def t13_many_secrets(spark, d):
    """Turns as errors that quote a key, of which half are secrets; these are known by their digests alone."""
    known = secrets.digests(spark, (hashlib.md5(f"s{k}".encode()).hexdigest() for k in range(SECRETS)), SALT)
    said = F.concat(F.left(F.coalesce("text", F.lit("")), F.lit(150)), F.lit("\n key=x"), F.md5(F.concat(F.lit("s"), (F.col("conv_id") % (2 * SECRETS)).cast("string")).cast("binary")), F.lit("y?key=abc&z"))
    return secrets.redacted(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", said.alias("message")), known, salt=SALT)


QUERIES = {f.__name__: f for f in (t13_many_secrets, o1_trial_order, d9_notes_of_documents, st6_ledger, s1_numbered_lines, k7_rename_steps, st5_pinned_clients, st3_key_rests, j2_bucketed_links)}

ORACLE = {
    "st6_ledger": links.sql_links(f"SELECT page_id, {LINK} AS raw FROM pages")
    + f""", x AS (SELECT page_id, trim(raw) AS url, k, coalesce(k, '#' || page_id) AS ke, {BATCH.replace('AS INT', 'AS INT')} AS b, page_id % 5 = 3 AS bad FROM l),
m AS (SELECT -page_id AS pos, page_id + 1 AS stt, page_id, url, k FROM x WHERE page_id % 2 = 0),
edge AS (SELECT min(pos) AS top, max(stt) AS most FROM m),
done AS (SELECT ke, any_value(k) AS k, b, max(page_id) AS rp FROM x WHERE NOT bad GROUP BY ke, b),
ins AS (SELECT ke, min(b) AS b0, arg_min(rp, b) AS o FROM done WHERE k IS NULL OR k NOT IN (SELECT k FROM m WHERE k IS NOT NULL) GROUP BY ke),
high AS (SELECT coalesce(max(o + 1) FILTER (WHERE b0 = 0), 0) AS h0, coalesce(max(o + 1) FILTER (WHERE b0 = 1), 0) AS h1 FROM ins),
rows AS (SELECT pos, stt, page_id, url, k AS ke, -1 AS b0, pos = min(pos) OVER (PARTITION BY k) AND k IS NOT NULL AS first FROM m
 UNION ALL SELECT top - CASE WHEN b0 > 0 THEN h0 ELSE 0 END - CASE WHEN b0 > 1 THEN h1 ELSE 0 END - 1 - o, most + row_number() OVER (ORDER BY b0, o), o, (SELECT url FROM x WHERE x.page_id = o), ke, b0, true FROM ins, high, edge),
last AS (SELECT ke, arg_max(rp, b) AS rp FROM done GROUP BY ke),
told AS (SELECT ke, b, 0 AS f, rp FROM done UNION ALL SELECT ke, b, 1, max(page_id) FROM x WHERE bad AND k IS NOT NULL GROUP BY ke, b),
said AS (SELECT r.ke, arg_max({{'f': f, 'rp': rp}}, t.b * 2 + f) AS s FROM (SELECT ke, b0 FROM rows WHERE first) r JOIN told t ON t.ke = r.ke AND t.b >= r.b0 GROUP BY r.ke)
SELECT pos, stt, url, CASE WHEN first AND rp IS NOT NULL THEN 'New-' || rp ELSE 'Title ' || page_id END AS title, CASE WHEN b0 >= 0 THEN '02/09/26 00:00:00' ELSE '01/09/26 10:20:30' END AS ts,
 CASE WHEN first AND rp IS NOT NULL THEN '[[r' || rp || '_raw]]' ELSE '[[' || page_id || '_raw]]' END AS raw_link, CASE WHEN first AND rp IS NOT NULL AND rp % 2 = 0 THEN '[[r' || rp || '_refine]]' ELSE '' END AS refine_link,
 CASE WHEN NOT first OR s IS NULL THEN 'Raw only' WHEN s.f = 1 THEN 'Failed: reason ' || s.rp WHEN s.rp % 2 = 0 THEN 'Done' ELSE 'Raw only' END AS status
FROM rows LEFT JOIN last USING (ke) LEFT JOIN said USING (ke)""",
    "s1_numbered_lines": r"""WITH t AS (SELECT conv_id * 1000 + turn AS pos, string_split(regexp_replace(coalesce(text, '') || chr(10), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations),
e AS (SELECT pos, unnest(ls[:-2]) AS line, generate_subscripts(ls[:-2], 1) AS k FROM t), o AS (SELECT row_number() OVER (ORDER BY pos, k) - 1 AS n, regexp_replace(line, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS item FROM e)
SELECT n, item FROM o WHERE item <> ''""",
    "k7_rename_steps": r"""
WITH RECURSIVE p AS (SELECT page_id, page_id // 8 AS g, page_id % 8 AS k FROM pages),
nm AS (SELECT 'n' || page_id AS name FROM pages WHERE page_id % 8 <> 6 OR page_id % 32 < 16),
w AS (SELECT DISTINCT * FROM (SELECT 'n' || page_id AS old, CASE g % 4 WHEN 0 THEN CASE WHEN k < 7 THEN 'n' || (g * 8 + k + 1) ELSE 'z' || g END WHEN 1 THEN 'n' || (g * 8 + (k + 1) % 8)
  WHEN 2 THEN CASE WHEN k < 3 THEN 'n' || (g * 8 + 100000000) WHEN k < 6 THEN 'n' || (g * 8 + k + 1) END ELSE CASE WHEN k < 5 THEN 'n' || (g * 8 + k + 1) WHEN k = 6 THEN 'n' || (g * 8 + 200000000) END END AS new FROM p) WHERE new <> old),
there AS (SELECT * FROM w WHERE old IN (SELECT name FROM nm)),
marked AS (SELECT *, count(*) OVER (PARTITION BY new) > 1 OR count(*) OVER (PARTITION BY old) > 1 AS clash FROM there),
c AS (SELECT old, new FROM marked WHERE NOT clash),
chain AS (SELECT old, new, 1 AS step, new IN (SELECT name FROM nm) AS taken FROM c WHERE new NOT IN (SELECT old FROM c)
  UNION ALL SELECT c.old, c.new, chain.step + 1, chain.taken FROM chain JOIN c ON c.new = chain.old),
ring AS (SELECT * FROM c WHERE old NOT IN (SELECT old FROM chain)),
reach AS (SELECT old AS a, old AS b, 0 AS hops FROM ring UNION ALL SELECT reach.a, ring.new, hops + 1 FROM reach JOIN ring ON ring.old = reach.b WHERE ring.new <> reach.a),
least AS (SELECT a AS old, min(b) AS least, count(*) AS size FROM reach GROUP BY a),
steps AS (SELECT r.old, r.new, CASE WHEN r.old = l.least THEN l.size ELSE (SELECT hops FROM reach x WHERE x.a = r.old AND x.b = l.least) END AS step, r.old = l.least AS first FROM ring r JOIN least l USING (old))
SELECT 'rename' AS action, CAST(step AS BIGINT) AS step, CASE WHEN first THEN '.parked-' || old ELSE old END AS old, new FROM steps
UNION ALL SELECT 'park', 0, old, '.parked-' || old FROM steps WHERE first
UNION ALL SELECT CASE WHEN taken THEN 'taken' ELSE 'rename' END, CASE WHEN NOT taken THEN step END, old, new FROM chain
UNION ALL SELECT 'missing', NULL, old, new FROM w WHERE old NOT IN (SELECT name FROM nm)
UNION ALL SELECT 'conflict', NULL, old, new FROM marked WHERE clash""",
    "st5_pinned_clients": f"""
WITH e AS (SELECT event_id AS seq, event_id % 4 = 0 AS plain, {RUN} AS run, {CLIENT} AS client FROM ({LOG})),
p AS (SELECT *, last_value(client IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pinned FROM e),
c AS (SELECT *, ['default', 'android', 'ios', 'mweb', 'tv'] AS all5 FROM p)
SELECT run, seq, pinned, CASE WHEN plain THEN 'default' WHEN list_contains(all5, pinned) THEN array_to_string(list_concat([pinned], list_filter(all5, lambda x: x <> pinned)), ',') ELSE array_to_string(all5, ',') END AS clients FROM c""",
    "st3_key_rests": rf"""
WITH e AS (SELECT 'k' || CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 40 END AS key, event_id % 4 < 3 AS free, (1700000000 + event_id) * 1000000 AS us, CASE WHEN event_id % 6 > 0 THEN {MESSAGE} END AS m FROM ({LOG})),
c AS (SELECT *, free AND coalesce(regexp_matches(lower(m), '429|resource_exhausted|quota|rate limit|too many requests') AND NOT regexp_matches(lower(m), '503|unavailable|high demand|overloaded') AND NOT (regexp_matches(lower(m), '404|not found|not supported') AND contains(lower(m), 'model')), false) AS quota FROM e),
r AS (SELECT *, us + CAST(round(coalesce(TRY_CAST(nullif(regexp_extract(m, '(?i)retry[_ ]?delay[''"]?\s*[:=]\s*[''"]?(\d+(?:\.\d+)?)s', 1), '') AS DOUBLE), 60.0) * 1000000) AS BIGINT) AS until FROM c)
SELECT key, (max({{'us': us, 'until': until}}) FILTER (WHERE quota)).until AS rest_until, max(us) FILTER (WHERE m IS NULL) AS last_call,
 greatest((max({{'us': us, 'until': until}}) FILTER (WHERE quota)).until, (max({{'us': us, 'again': us + CASE WHEN free THEN 4500000 ELSE 500000 END}}) FILTER (WHERE m IS NULL)).again) AS ready FROM r GROUP BY key""",
    "j2_bucketed_links": links._both() + " SELECT page_id, k AS url_key FROM l WHERE k NOT IN (SELECT k FROM known) AND k NOT IN (SELECT k FROM l WHERE page_id % 4 = 1)",
    "o1_trial_order": f"SELECT name, tier, row_number() OVER (ORDER BY tier, name) AS place FROM ({TEXTS['f6_usable_keys']})",
    "d9_notes_of_documents": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t, coalesce(text, '') AS raw FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace('- ' || x, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')) AS ls, regexp_replace('> ' || regexp_replace(left(raw, 80), '[\r\n]+', ' ', 'g'), '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS q FROM d),
k AS (SELECT *, list_transform(list_filter(ls, lambda x: regexp_matches(x, '^[-*][\s\x0b]+')), lambda x: regexp_replace(x, '^[-*][\s\x0b]+', '')) AS lessons FROM l)
SELECT doc_id, 'Tiêu đề ' || doc_id AS vi_title, CAST(len(lessons) AS INT) AS n_lessons, md5(array_to_string(lessons, '|')) AS lessons_md5, CASE WHEN doc_id % 4 > 0 THEN 'Title' END AS en_title, CASE WHEN doc_id % 4 > 0 THEN regexp_replace(q, '^>[\s\x0b]*', '') END AS quotes, 'ref ' || doc_id AS reference FROM k""",
    "t13_many_secrets": rf"""WITH a AS (SELECT conv_id, turn, left(coalesce(text, ''), 150) || chr(10) || ' key=x' || CASE WHEN conv_id % {2 * SECRETS} < {SECRETS} THEN '[REDACTED]' ELSE md5('s' || conv_id % {2 * SECRETS}) END || 'y?key=abc&z' AS m FROM conversations)
SELECT conv_id, turn, left(regexp_replace({_single('m')}, '(?i)([?&](?:key|api[_-]?key)=)[^&\s]+', '\1[REDACTED]', 'g'), 500) AS message FROM a""",
}
