"""Link functions as Column expressions: keys, predicates and rewrites. Null gives null (predicates: false)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, tracking keys and path shapes that decide a link's key and kind.
VIDEO_HOSTS = ("youtube.com", "m.youtube.com", "youtu.be")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com")
TRACKING_KEYS = ("fbclid", "si", "pp")
TRACKING_PREFIX = "utm_"
TABS = "videos|streams|shorts|playlists"
CHANNEL_PATHS = rf"^/(@[^/]+|channel/[^/]+|(c|user)/[^/]+)(/({TABS}))?/?$|^/playlist/?$"
BARE_CHANNEL = r"^/(@[^/]+|channel/[^/]+|(c|user)/[^/]+)$"

#: Scheme, authority, path, query, fragment; blanks and control characters before a link don't count.
_SHAPE = r"(?s)^[\x00-\x20]*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


#: White space of text tools. Spelled out one by one, a class of these is one table lookup up to U+00FF in Java.
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
SPACE = ASCII_SPACE + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(s: Column) -> Column:
    """Trim Unicode white space, as text tools do; by default Spark's trim only removes blanks."""
    return F.trim(s, F.lit(SPACE))


def replace_spaces(s: Column, pattern: str, to: str) -> Column:
    """Replace ``pattern``, in which {} stands for a class of white space; the class is short where all of ``s`` is ASCII."""
    return let(s, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.regexp_replace(x, pattern.format(f"[{SPACE}]"), to)).otherwise(F.regexp_replace(x, pattern.format(f"[{ASCII_SPACE}]"), to)))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _SHAPE, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Lower-case authority without one leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def _decoded(s: Column) -> Column:
    return F.coalesce(F.call_function("try_url_decode", s), s)


def _encoded(s: Column) -> Column:
    """Form encoding: ``*`` is escaped and ``~`` is not, unlike the built-in function."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(url: Column) -> Column:
    """Query parameters in order, as structs of decoded key and value; blank values stay."""
    pieces = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("key"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "(?s)^[^=]*=", ""))).otherwise("").alias("value")))


def parameter(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, or empty."""
    found = F.filter(_pairs(url), lambda p: (p["key"] == name) & (p["value"] != ""))
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def is_url(s: Column) -> Column:
    return F.coalesce((_part(s, 1) != "") & (netloc(s) != ""), F.lit(False))


def _segment(p: Column, n: int) -> Column:
    return F.coalesce(F.get(F.split(p, "/"), F.lit(n)), F.lit(""))


def _parsed(url: Column) -> Column:
    return F.struct(url.alias("url"), scheme(url).alias("scheme"), host(url).alias("host"), path(url).alias("path"), _pairs(url).alias("pairs"))


def _first(pairs: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(pairs, lambda p: (p["key"] == name) & (p["value"] != "")), F.lit(0))["value"], F.lit(""))


def _video_id(u: Column, p: Column) -> Column:
    """Of a parsed link with path ``p``."""
    long_host = u["host"].isin(*VIDEO_HOSTS[:2])
    return F.when(u["host"] == VIDEO_HOSTS[2], _segment(F.regexp_replace(p, "^/+", ""), 0)).when(long_host & (p == "/watch"), _first(u["pairs"], "v")).when(long_host & F.startswith(p, F.lit("/shorts/")), _segment(p, 2)).otherwise("")


def canonical_url(s: Column) -> Column:
    """One stable key for a link: video links by their id, others without trackers, fragment, ``www.`` and closing slash."""

    def key(u: Column) -> Column:
        return let(F.regexp_replace(u["path"], "/+$", ""), lambda p: let(_video_id(u, p), lambda video: F.when(video != "", F.concat(F.lit("youtube:"), video)).otherwise(plain(u, p))))

    def plain(u: Column, p: Column) -> Column:
        kept = F.filter(u["pairs"], lambda x: ~F.startswith(F.lower(x["key"]), F.lit(TRACKING_PREFIX)) & ~F.lower(x["key"]).isin(*TRACKING_KEYS))
        q = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["key"]), F.lit("="), _encoded(x["value"]))), "&")
        return F.concat(
            F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(""),
            F.when(u["host"] != "", F.concat(F.lit("//"), u["host"])).otherwise(""),
            F.when((u["host"] != "") & (p != "") & ~F.startswith(p, F.lit("/")), F.concat(F.lit("/"), p)).otherwise(p),
            let(q, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise("")),
        )

    return let(strip(s), lambda url: let(_parsed(url), key))


def extraction_url(s: Column) -> Column:
    """Video links as plain watch links, others trimmed. The path keeps its closing slash here."""

    def made(u: Column) -> Column:
        return let(_video_id(u, u["path"]), lambda video: F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)).otherwise(u["url"]))

    return let(strip(s), lambda url: let(_parsed(url), made))


def is_video_host(s: Column) -> Column:
    return F.coalesce(host(s).isin(*VIDEO_HOSTS), F.lit(False))


def is_social(s: Column) -> Column:
    h = F.regexp_replace(host(s), r"^m\.", "")
    return F.coalesce(h.rlike(r"^(.*\.)?(" + "|".join(x.replace(".", r"\.") for x in SOCIAL_HOSTS) + ")$"), F.lit(False))


def is_channel(s: Column) -> Column:
    url = strip(s)
    listed = (F.regexp_replace(path(url), "/+$", "") != "/watch") & (parameter(url, "list") != "")
    return F.coalesce(host(url).isin(*VIDEO_HOSTS[:2]) & (listed | path(url).rlike(CHANNEL_PATHS)), F.lit(False))


def channel_url(s: Column) -> Column:
    """A bare channel page as its videos tab; links to lists stay as they are."""
    url = strip(s)
    p = F.regexp_replace(path(url), "/+$", "")
    tab = F.when(p.rlike(BARE_CHANNEL), F.concat(p, F.lit("/videos"))).otherwise(p)
    made = F.concat(
        F.coalesce(F.nullif(scheme(url), F.lit("")), F.lit("https")),
        F.lit("://"),
        netloc(url),
        F.when((netloc(url) != "") & (tab != "") & ~F.startswith(tab, F.lit("/")), F.concat(F.lit("/"), tab)).otherwise(tab),
        F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""),
    )
    return F.when(parameter(url, "list") != "", url).otherwise(made)


def media_id(s: Column) -> Column:
    return F.regexp_replace(canonical_url(s), "^youtube:", "")


def split_links(s: Column) -> Column:
    """Links of a pasted text in order, cut at commas and semicolons. One bad link rejects the whole text."""
    pieces = F.filter(F.transform(F.split(s, "[,;]"), strip), lambda x: x != "")
    bad = F.filter(pieces, lambda x: ~(scheme(x).isin("http", "https") & (netloc(x) != "")))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("not a link: "), F.left(F.get(bad, F.lit(0)), F.lit(100))))).otherwise(pieces)
