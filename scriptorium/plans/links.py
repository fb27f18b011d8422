"""Queries over links, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, urls
from ..operators import captions, dedup, keypool, manifest, reconcile
from ..sources import files

# The same text in both engines: links of every kind that the rules tell apart.
LINK = """CASE CAST(page_id % 10 AS INT)
 WHEN 0 THEN url
 WHEN 1 THEN 'https://youtu.be/v' || CAST(page_id % 40 AS STRING) || '?si=x'
 WHEN 2 THEN 'https://www.youtube.com/watch?v=v' || CAST(page_id % 40 AS STRING) || '&utm_source=x'
 WHEN 3 THEN ' https://m.youtube.com/shorts/v' || CAST(page_id % 40 AS STRING) || '/ '
 WHEN 4 THEN 'https://www.facebook.com/reel/' || CAST(page_id % 60 AS STRING) || '?fbclid=abc&b=a*~+c&utm_source=x'
 WHEN 5 THEN 'HTTPS://WWW.Example.com:8080/a/b/?q=1&&x&SI=2&n=' || CAST(page_id % 20 AS STRING) || '#frag'
 WHEN 6 THEN 'not a url ' || CAST(page_id % 7 AS STRING)
 WHEN 7 THEN 'https://www.youtube.com/@chan' || CAST(page_id % 30 AS STRING)
 WHEN 8 THEN 'https://youtube.com/watch?v=v' || CAST(page_id % 40 AS STRING) || '&list=L1'
 ELSE 'https://www.youtube.com/playlist?list=P' || CAST(page_id % 30 AS STRING) END"""

SHAPE = r"(?s)^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def sql_links(source: str = f"SELECT page_id, {LINK} AS raw FROM pages") -> str:
    """CTEs that end in ``l``: the columns of the source and raw, u, sch, host, path, p (path without closing slashes), q (pairs), v (video id), k (canonical link)."""
    return rf"""
WITH l0 AS ({source}),
l1 AS (SELECT *, trim(raw) AS u FROM l0),
l2 AS (SELECT *, lower(regexp_extract(u, '{SHAPE}', 1)) AS sch, regexp_extract(u, '{SHAPE}', 2) AS loc, regexp_extract(u, '{SHAPE}', 3) AS path, regexp_extract(u, '{SHAPE}', 4) AS qs FROM l1),
l3 AS (SELECT *, regexp_replace(lower(loc), '^www\.', '') AS host, regexp_replace(path, '/+$', '') AS p,
  list_transform(list_filter(string_split(qs, '&'), lambda x: x <> ''), lambda x: {{'key': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'value': CASE WHEN contains(x, '=') THEN url_decode(replace(x[instr(x, '=') + 1:], '+', ' ')) ELSE '' END}}) AS q FROM l2),
l4 AS (SELECT *, coalesce(list_filter(q, lambda x: x.key = 'v' AND x.value <> '')[1].value, '') AS pv, coalesce(list_filter(q, lambda x: x.key = 'list' AND x.value <> '')[1].value, '') AS pl FROM l3),
l5 AS (SELECT *, CASE WHEN host = 'youtu.be' THEN split_part(ltrim(p, '/'), '/', 1) WHEN host IN ('youtube.com', 'm.youtube.com') AND p = '/watch' THEN pv
  WHEN host IN ('youtube.com', 'm.youtube.com') AND starts_with(p, '/shorts/') THEN split_part(p, '/', 3) ELSE '' END AS v,
  array_to_string(list_transform(list_filter(q, lambda x: NOT starts_with(lower(x.key), 'utm_') AND lower(x.key) NOT IN ('fbclid', 'si', 'pp')), lambda x: replace(url_encode(x.key), '%20', '+') || '=' || replace(url_encode(x.value), '%20', '+')), '&') AS eq FROM l4),
l AS (SELECT *, CASE WHEN v <> '' THEN 'youtube:' || v ELSE CASE WHEN sch <> '' THEN sch || ':' ELSE '' END || CASE WHEN host <> '' THEN '//' || host ELSE '' END || p || CASE WHEN eq <> '' THEN '?' || eq ELSE '' END END AS k FROM l5)
"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


def links(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.expr(LINK).alias("url"))


def r1_canonical_dedup(spark, d):
    own = _pages(spark, d).withColumn("url_key", urls.canonical_url(F.col("url")))
    return dedup.first_wins(own, "url_key", "page_id").select("page_id", "url_key")


def u2_canonical_url(spark, d):
    return links(spark, d).select("page_id", urls.canonical_url(F.col("url")).alias("url_key"))


def u_link_functions(spark, d):
    u = F.col("url")
    return links(spark, d).select("page_id", urls.is_url(u).alias("is_url"), urls.extraction_url(u).alias("extraction_url"), urls.is_video_host(u).alias("is_video"), urls.is_social(u).alias("is_social"), urls.is_channel(u).alias("is_channel"), urls.channel_url(u).alias("channel_url"), urls.media_id(u).alias("media_id"))


def u8_split_links(spark, d):
    pasted = _pages(spark, d).select("page_id", F.concat(F.col("url"), F.lit(", https://youtu.be/a;;https://www.youtube.com/watch?v=a ,"), F.col("url"), F.lit("#x")).alias("text"))
    each = pasted.select("page_id", F.posexplode(urls.split_links(F.col("text"))).alias("pos", "link")).withColumn("k", F.struct("page_id", urls.canonical_url(F.col("link"))))
    return dedup.first_wins(each, "k", "pos").select("page_id", "pos", "link")


def f12_clients(spark, d):
    preferred = F.when(F.col("page_id") % 3 == 0, "ios").when(F.col("page_id") % 3 == 1, "vr")
    return links(spark, d).select("page_id", F.array_join(errors.clients(F.col("url"), preferred, cookies=True), ",").alias("clients"))


# A manifest of every second link that is one, newest (largest page_id) first.
STT = "CAST(page_id AS BIGINT) + 1"


def _manifest(spark, d) -> DataFrame:
    """Parsed from its text lines, as the file would be."""
    own = links(spark, d).where("page_id % 2 = 0")
    cells = [F.lit(""), F.concat(F.lit(" "), (F.col("page_id") + 1).cast("string"), F.lit(" ")), F.concat(F.lit(" "), F.trim("url"), F.lit(" ")), F.concat(F.lit(" Title "), F.col("page_id").cast("string"), F.lit(" ")), F.lit(" 01/09/26 10:20:30 "), F.concat(F.lit(" [["), F.format_string("%03d", F.col("page_id") + 1), F.lit("_Title_raw]] ")), F.when(F.col("page_id") % 4 == 0, " [[x_refine]] ").otherwise(" "), F.when(F.col("page_id") % 4 == 0, " Done ").otherwise(" Raw only "), F.lit("")]
    lines = own.select((-F.col("page_id")).alias("pos"), F.concat_ws("|", *cells).alias("line"))
    return manifest.parse(lines)


MANIFEST_SQL = "SELECT -page_id AS pos, page_id + 1 AS stt, page_id, trim(" + LINK + ") AS raw FROM pages WHERE page_id % 2 = 0"


def s2_manifest_scan(spark, d):
    return manifest.known_keys(_manifest(spark, d))


def s2_manifest_rows(spark, d):
    return _manifest(spark, d)


def a7_duplicate_keys(spark, d):
    return manifest.duplicates(_manifest(spark, d))


def w1_numbers(spark, d):
    return manifest.assign_numbers(links(spark, d), _manifest(spark, d), pos="page_id").select("page_id", "stt")


def j2_new_links(spark, d):
    return manifest.new_links(links(spark, d), _manifest(spark, d)).select("page_id", "url_key")


def a2_link_counts(spark, d):
    own = links(spark, d).withColumn("channel", F.col("page_id") % 5)
    return manifest.link_counts(own, _manifest(spark, d), "channel")


def _results(spark, d) -> DataFrame:
    """A result for every third link, each key's numbers left to the merge."""
    p = F.col("page_id")
    return links(spark, d).where("page_id % 3 = 0").select(F.trim("url").alias("url"), F.concat(F.lit("New|"), p.cast("string")).alias("title"), F.concat(F.lit("r"), p.cast("string"), F.lit("_raw")).alias("raw_name"), F.when(p % 2 == 0, F.concat(F.lit("r"), p.cast("string"), F.lit("_refine"))).alias("refine_name"), F.lit(None).cast("long").alias("stt"), p.alias("order"))


def k3_upsert(spark, d):
    merged = manifest.upsert(_manifest(spark, d), _results(spark, d), F.lit("02/09/26 00:00:00"))
    return merged.select("pos", "stt", "url", "title", "ts", "raw_link", "refine_link", "status")


def k5_failures(spark, d):
    failed = links(spark, d).where("page_id % 3 = 0").select("url", F.concat(F.lit("reason "), F.col("page_id").cast("string"), F.repeat(F.lit("x"), F.lit(90))).alias("reason"), F.col("page_id").alias("order"))
    return manifest.mark_failures(_manifest(spark, d), failed).select("stt", "status")


FILES = "SELECT printf('%03d', page_id + 1) || '_Title_raw' AS stem FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT printf('%03d', page_id + 1) || '_Title ' || CAST(page_id AS STRING) || '_raw' AS stem FROM pages WHERE page_id % 5 = 0"


def _files(spark, d) -> DataFrame:
    p = _pages(spark, d)
    n = F.format_string("%03d", F.col("page_id") + 1)
    return p.where("page_id % 3 = 0").select(F.concat(n, F.lit("_Title_raw")).alias("stem")).unionByName(p.where("page_id % 5 = 0").select(F.concat(n, F.lit("_Title "), F.col("page_id").cast("string"), F.lit("_raw")).alias("stem")))


def j4_rename_plan(spark, d):
    return reconcile.rename_plan(_manifest(spark, d), _files(spark, d))


def a5_plan_counts(spark, d):
    return reconcile.plan_counts(j4_rename_plan(spark, d))


def j4_broken_links(spark, d):
    return reconcile.broken_links(_manifest(spark, d), _files(spark, d)).select("stt", "kind", "target")


def j4_orphans(spark, d):
    return reconcile.orphans(_manifest(spark, d), _files(spark, d)).distinct()


def j4_misnumbered(spark, d):
    return reconcile.misnumbered(_manifest(spark, d))


def j3_pending(spark, d):
    items = _pages(spark, d).select("page_id", F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("stem"))
    there = _pages(spark, d).where("page_id % 4 = 1").select(F.concat(F.lit("s"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 8 == 1, "_raw.md").otherwise("_refine.md")).alias("name"))
    return reconcile.pending(items, there)


def j6_captions(spark, d):
    p = _pages(spark, d)
    media = p.select(F.concat(F.lit("vid"), F.col("page_id").cast("string"), F.lit("x")).alias("media_id"))
    kinds = F.array(F.lit(".vi.vtt"), F.lit(".en.vtt"), F.lit(".en.srt"), F.lit(".txt"))
    named = p.where("page_id % 3 <> 0").select(F.explode(F.transform(F.slice(kinds, 1, (F.col("page_id") % 4 + 1).cast("int")), lambda k: F.concat(F.lit("vid"), F.col("page_id").cast("string"), F.lit("x"), k))).alias("name"))
    return captions.choose_caption(media, named)


def w5_page(spark, d):
    from ..operators.dedup import numbered, page

    return page(numbered(_pages(spark, d).select("page_id"), "page_id"), "n", 3).select("page_id", "n")


def w4_numbers(spark, d):
    return dedup.numbered(links(spark, d), "page_id").select("page_id", "n")


def s9_channel_videos(spark, d):
    p = F.col("page_id")
    entry = F.struct(F.when(p % 3 == 0, "").when(p % 3 == 1, F.col("url")).alias("url"), F.concat(F.lit("id"), p.cast("string")).alias("id"), F.when(p % 4 == 0, "").when(p % 4 == 1, F.concat(F.lit("T"), p.cast("string"))).alias("title"), F.when(p % 5 > 0, p.cast("double")).alias("duration"))
    listings = _pages(spark, d).select(p.alias("channel"), F.array(entry, F.lit(None)).alias("entries"))
    return files.channel_videos(listings)


def s11_mp3_url(spark, d):
    p = F.col("page_id")
    tag = F.when(p % 3 == 0, F.concat(F.lit('<meta property="og:audio" content="https://a.example/'), p.cast("string"), F.lit('.mp3">'))).when(p % 3 == 1, F.concat(F.lit("<script>x='https://b.example/"), p.cast("string"), F.lit(".mp3'</script>"))).otherwise("")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", files.mp3_url(F.concat(F.coalesce("html", F.lit("")), tag)).alias("mp3"))


def a8_call_estimate(spark, d):
    return keypool.call_estimate(a2_link_counts(spark, d).select("channel", "remaining"), "remaining")


def s5_batch_scan(spark, d):
    """The manifest's lines as the batch menu reads them, leading bars and all."""
    own = links(spark, d)
    n = F.col("page_id").cast("string")
    cells = [F.lit(""), F.concat(F.lit(" "), (F.col("page_id") + 1).cast("string"), F.when(F.col("page_id") % 7 == 0, "x ").otherwise(" ")), F.concat(F.lit(" "), F.trim("url"), F.lit(" ")), F.concat(F.lit(" Title "), n, F.lit(" ")), F.lit(" 01/09/26 "), F.lit("")]
    return manifest.parse_batch(own.select(F.col("page_id").alias("pos"), F.concat_ws("|", *cells).alias("line")))


def s8_media_files(spark, d):
    p = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, (".MP3", ".mkv", ".txt", "mp4", ".Flac"))), (p % 5 + 1).cast("int"))
    return files.media_of(_pages(spark, d).select(F.concat(F.lit("file:/m/Clip "), p.cast("string"), kind).alias("path"), (p * 700).alias("length")))


QUERIES = {f.__name__: f for f in (a5_plan_counts, a8_call_estimate, s5_batch_scan, s8_media_files, r1_canonical_dedup, u2_canonical_url, u_link_functions, u8_split_links, f12_clients, s2_manifest_scan, s2_manifest_rows, a7_duplicate_keys, w1_numbers, j2_new_links, a2_link_counts, k3_upsert, k5_failures, j4_rename_plan, j4_broken_links, j4_orphans, j4_misnumbered, j3_pending, j6_captions, w4_numbers, w5_page, s9_channel_videos, s11_mp3_url)}

_OWN = sql_links("SELECT page_id, url AS raw FROM pages")
_MAN = sql_links(MANIFEST_SQL)
_ALL = sql_links()


def _both() -> str:
    """``l`` of all links, and m of the manifest's rows with their keys."""
    return _ALL + ", m AS (SELECT page_id, -page_id AS pos, page_id + 1 AS stt, trim(raw) AS url, k, 'Title ' || page_id AS title, '01/09/26 10:20:30' AS ts, '[[' || printf('%03d', page_id + 1) || '_Title_raw]]' AS raw_link, CASE WHEN page_id % 4 = 0 THEN '[[x_refine]]' ELSE '' END AS refine_link, CASE WHEN page_id % 4 = 0 THEN 'Done' ELSE 'Raw only' END AS status FROM l WHERE page_id % 2 = 0), known AS (SELECT k, arg_max(stt, pos) AS stt FROM m WHERE url <> '' GROUP BY k)"


_LINKS_OF = "lk AS (SELECT stt, 'raw' AS kind, printf('%03d', stt) || '_Title_raw' AS target FROM m UNION ALL SELECT stt, 'refine', 'x_refine' FROM m WHERE refine_link <> '')"

ORACLE = {
    "r1_canonical_dedup": _OWN + "SELECT min(page_id) AS page_id, k AS url_key FROM l GROUP BY k",
    "u2_canonical_url": _ALL + "SELECT page_id, k AS url_key FROM l",
    "u_link_functions": _ALL
    + r""", x AS (SELECT *, CASE WHEN host = 'youtu.be' THEN split_part(ltrim(path, '/'), '/', 1) WHEN host IN ('youtube.com', 'm.youtube.com') AND path = '/watch' THEN pv WHEN host IN ('youtube.com', 'm.youtube.com') AND starts_with(path, '/shorts/') THEN split_part(path, '/', 3) ELSE '' END AS xv FROM l)
SELECT page_id, sch <> '' AND loc <> '' AS is_url, CASE WHEN xv <> '' THEN 'https://www.youtube.com/watch?v=' || xv ELSE u END AS extraction_url, host IN ('youtube.com', 'm.youtube.com', 'youtu.be') AS is_video,
 regexp_matches(regexp_replace(host, '^m\.', ''), '^(.*\.)?(facebook\.com|instagram\.com|linkedin\.com)$') AS is_social,
 host IN ('youtube.com', 'm.youtube.com') AND ((p <> '/watch' AND pl <> '') OR regexp_matches(path, '^/(@[^/]+|channel/[^/]+|(c|user)/[^/]+)(/(videos|streams|shorts|playlists))?/?$|^/playlist/?$')) AS is_channel,
 CASE WHEN pl <> '' THEN u ELSE coalesce(nullif(sch, ''), 'https') || '://' || loc || CASE WHEN loc <> '' AND p <> '' AND NOT starts_with(p, '/') THEN '/' ELSE '' END || p || CASE WHEN regexp_matches(p, '^/(@[^/]+|channel/[^/]+|(c|user)/[^/]+)$') THEN '/videos' ELSE '' END || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END END AS channel_url,
 regexp_replace(k, '^youtube:', '') AS media_id FROM x""",
    "u8_split_links": sql_links("SELECT page_id, pos - 1 AS pos, trim(x) AS raw FROM (SELECT page_id, unnest(list_filter(list_transform(regexp_split_to_array(url || ', https://youtu.be/a;;https://www.youtube.com/watch?v=a ,' || url || '#x', '[,;]'), lambda y: trim(y)), lambda y: y <> '')) AS x, generate_subscripts(list_filter(list_transform(regexp_split_to_array(url || ', https://youtu.be/a;;https://www.youtube.com/watch?v=a ,' || url || '#x', '[,;]'), lambda y: trim(y)), lambda y: y <> ''), 1) AS pos FROM pages)")
    + "SELECT page_id, CAST(min(pos) AS INT) AS pos, arg_min(raw, pos) AS link FROM l GROUP BY page_id, k",
    "f12_clients": _ALL + "SELECT page_id, CASE WHEN host NOT IN ('youtube.com', 'm.youtube.com', 'youtu.be') THEN 'default' WHEN page_id % 3 = 0 THEN 'ios,default,android,mweb,tv,cookies' ELSE 'default,android,ios,mweb,tv,cookies' END AS clients FROM l",
    "s2_manifest_scan": _both() + "SELECT k AS url_key, stt FROM known",
    "s2_manifest_rows": _both() + "SELECT pos, stt, url, title, ts, raw_link, refine_link, status FROM m",
    "a7_duplicate_keys": _both() + "SELECT k AS url_key, count(*) AS n FROM m GROUP BY k HAVING count(*) > 1",
    "w1_numbers": _both() + ", f AS (SELECT k, min(page_id) AS first FROM l WHERE k NOT IN (SELECT k FROM known) GROUP BY k), n AS (SELECT k, (SELECT max(stt) FROM m) + row_number() OVER (ORDER BY first) AS stt FROM f UNION ALL SELECT k, stt FROM known) SELECT page_id, n.stt FROM l JOIN n USING (k)",
    "j2_new_links": _both() + "SELECT page_id, k AS url_key FROM l WHERE k NOT IN (SELECT k FROM known)",
    "a2_link_counts": _both() + "SELECT page_id % 5 AS channel, count(*) AS total, count(known.k) AS skipped, count(*) - count(known.k) AS remaining FROM l LEFT JOIN known USING (k) GROUP BY 1",
    "k3_upsert": _both()
    + """, r AS (SELECT k, max(page_id) AS rp FROM l WHERE page_id % 3 = 0 GROUP BY k), f AS (SELECT k, min(pos) AS first FROM m GROUP BY k)
SELECT pos, stt, url, CASE WHEN h THEN 'New-' || rp ELSE title END AS title, ts, CASE WHEN h THEN '[[r' || rp || '_raw]]' ELSE raw_link END AS raw_link, CASE WHEN h THEN CASE WHEN rp % 2 = 0 THEN '[[r' || rp || '_refine]]' ELSE '' END ELSE refine_link END AS refine_link, CASE WHEN h THEN CASE WHEN rp % 2 = 0 THEN 'Done' ELSE 'Raw only' END ELSE status END AS status
FROM (SELECT m.*, rp, rp IS NOT NULL AND pos = first AS h FROM m JOIN f USING (k) LEFT JOIN r USING (k))
UNION ALL SELECT (SELECT min(pos) FROM m) - 1 - rp, (SELECT max(stt) FROM m) + row_number() OVER (ORDER BY rp), trim(l.raw), 'New-' || rp, '02/09/26 00:00:00', '[[r' || rp || '_raw]]', CASE WHEN rp % 2 = 0 THEN '[[r' || rp || '_refine]]' ELSE '' END, CASE WHEN rp % 2 = 0 THEN 'Done' ELSE 'Raw only' END
FROM r JOIN l ON l.page_id = r.rp WHERE r.k NOT IN (SELECT k FROM m)""",
    "k5_failures": _both() + ", r AS (SELECT k, max(page_id) AS p FROM l WHERE page_id % 3 = 0 GROUP BY k), f AS (SELECT k, min(pos) AS first FROM m GROUP BY k) SELECT stt, CASE WHEN p IS NOT NULL AND pos = first THEN 'Failed: ' || left('reason ' || p || repeat('x', 90), 80) ELSE status END AS status FROM m JOIN f USING (k) LEFT JOIN r USING (k)",
    "j4_rename_plan": _both() + f", {_LINKS_OF}, fl AS ({FILES}), w AS (SELECT stt, kind, target AS old, printf('%03d', stt) || '_Title ' || (stt - 1) || '_' || kind AS new FROM lk) SELECT stt, kind, old, new, CASE WHEN new IN (SELECT stem FROM fl) THEN 'relink' WHEN old IN (SELECT stem FROM fl) THEN 'rename' ELSE 'skip' END AS action FROM w WHERE old <> new",
    "j4_broken_links": _both() + f", {_LINKS_OF}, fl AS ({FILES}) SELECT stt, kind, target FROM lk WHERE target NOT IN (SELECT stem FROM fl)",
    "j4_orphans": _both() + f", {_LINKS_OF}, fl AS ({FILES}) SELECT DISTINCT stem FROM fl WHERE stem NOT IN (SELECT target FROM lk)",
    "j4_misnumbered": _both() + f", {_LINKS_OF} SELECT stt, kind, target FROM lk WHERE NOT starts_with(target, printf('%03d', stt) || '_')",
    "j3_pending": "SELECT 's' || page_id AS stem, page_id FROM pages WHERE page_id % 4 <> 1",
    "j6_captions": "SELECT 'vid' || page_id || 'x' AS media_id, 'vid' || page_id || CASE WHEN page_id % 4 = 0 THEN 'x.vi.vtt' ELSE 'x.en.vtt' END AS name FROM pages WHERE page_id % 3 <> 0",
    "w4_numbers": "SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages",
    "w5_page": "SELECT page_id, n FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n, count(*) OVER () AS c FROM pages) WHERE n > least(3, CAST(ceil(c / 20.0) AS BIGINT) - 1) * 20 AND n <= (least(3, CAST(ceil(c / 20.0) AS BIGINT) - 1) + 1) * 20",
    "s9_channel_videos": "SELECT page_id AS channel, 0 AS pos, CASE WHEN page_id % 3 = 1 THEN url ELSE 'https://www.youtube.com/watch?v=id' || page_id END AS url, CASE WHEN page_id % 4 = 1 THEN 'T' || page_id ELSE 'id' || page_id END AS title, CASE WHEN page_id % 5 > 0 THEN CAST(page_id AS DOUBLE) ELSE 0 END AS duration FROM pages",
    "s11_mp3_url": r"""SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(h, '(<meta\b[^>]*\bproperty\s*=\s*["'']?og:audio["'']?[\s/>][^>]*)', 1), 'content\s*=\s*["'']([^"'']*)["'']', 1), ''), nullif(regexp_extract(h, '(https?://[^"''\s>]+?\.mp3)', 1), '')) AS mp3
FROM (SELECT page_id, coalesce(html, '') || CASE page_id % 3 WHEN 0 THEN '<meta property="og:audio" content="https://a.example/' || page_id || '.mp3">' WHEN 1 THEN '<script>x=''https://b.example/' || page_id || '.mp3''</script>' ELSE '' END AS h FROM pages)""",
}

ORACLE |= {
    "a5_plan_counts": f"SELECT action, count(*) AS n FROM ({ORACLE['j4_rename_plan']}) GROUP BY action",
    "a8_call_estimate": f"SELECT channel, remaining, remaining AS calls_least, 2 * remaining AS calls_most FROM ({ORACLE['a2_link_counts']})",
    "s5_batch_scan": f"SELECT page_id AS pos, page_id + 1 AS stt, replace({LINK}, ' ', '') AS link, ' Title ' || page_id || ' ' AS third, ' 01/09/26 ' AS fourth FROM pages WHERE page_id >= 2 AND page_id % 7 <> 0",
    "s8_media_files": "SELECT 'file:/m/' || name AS path, name, CAST(ceil(page_id * 700 / 1024.0) AS BIGINT) AS size_kb FROM (SELECT page_id, 'Clip ' || page_id || CASE page_id % 5 WHEN 0 THEN '.MP3' WHEN 1 THEN '.mkv' ELSE '.Flac' END AS name FROM pages WHERE page_id % 5 IN (0, 1, 4))",
}
