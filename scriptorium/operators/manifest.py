"""The manifest: one row a link, newest first, keyed by the canonical link.

Rows are DataFrames with pos (place in the file, larger is older), stt, url, title, ts, raw_link, refine_link and status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import table_title, wikilink, wikilink_target
from ..functions.urls import canonical_url, strip
from .dedup import first_wins, numbered

COLUMNS = ("pos", "stt", "url", "title", "ts", "raw_link", "refine_link", "status")
TIME = "dd/MM/yy HH:mm:ss"
REASON_LENGTH = 80


def parse(lines: DataFrame, *, pos: str = "pos", line: str = "line") -> DataFrame:
    """Rows of a pipe table: at least nine parts, the second all digits. Other lines are no rows."""
    parts = F.split(F.regexp_replace(line, r"[\r\n]+$", ""), r"\|")
    cell = lambda n: strip(F.get(F.col("_parts"), F.lit(n)))
    rows = lines.select(F.col(pos).alias("pos"), parts.alias("_parts")).where((F.size("_parts") >= 9) & cell(1).rlike("^[0-9]+$"))
    return rows.select("pos", cell(1).cast("long").alias("stt"), cell(2).alias("url"), cell(3).alias("title"), cell(4).alias("ts"), cell(5).alias("raw_link"), cell(6).alias("refine_link"), cell(7).alias("status"))


def parse_batch(lines: DataFrame, *, pos: str = "pos", line: str = "line") -> DataFrame:
    """pos, stt, link, third, fourth as the batch menu reads the file: its first two lines are skipped, empty cells don't
    count, blanks are taken out of number and link, and only whole numbers without leading zeros are rows."""
    cells = F.filter(F.split(F.regexp_replace(line, r"[\r\n]+$", ""), r"\|"), lambda c: c != "")
    rows = lines.where(F.col(pos) >= 2).select(F.col(pos).alias("pos"), cells.alias("_c"))
    cell = lambda n: F.get("_c", F.lit(n))
    read = rows.select("pos", F.replace(cell(0), F.lit(" "), F.lit("")).alias("stt"), F.replace(cell(1), F.lit(" "), F.lit("")).alias("link"), cell(2).alias("third"), cell(3).alias("fourth"))
    return read.where(F.col("stt").rlike(r"^(0|-?[1-9][0-9]*)$")).withColumn("stt", F.col("stt").cast("long"))


def rendered(manifest: DataFrame) -> DataFrame:
    """pos, line: rows as text."""
    cell = lambda c: F.concat(F.lit(" "), F.coalesce(c.cast("string"), F.lit("")), F.lit(" "))
    return manifest.select("pos", F.concat(F.lit("|"), F.concat_ws("|", *(cell(F.col(c)) for c in COLUMNS[1:])), F.lit("|")).alias("line"))


def keyed(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("url_key", canonical_url(F.col("url")))


def _with_key(rows: DataFrame, known: bool) -> DataFrame:
    return rows if known else keyed(rows)


def known_keys(manifest: DataFrame) -> DataFrame:
    """url_key, stt: of a key that several rows have, the last row's number; rows without a link have no key."""
    return keyed(manifest.where(F.col("url") != "")).groupBy("url_key").agg(F.max_by("stt", "pos").alias("stt"))


def highest(manifest: DataFrame) -> DataFrame:
    """stt_max, 0 for an empty manifest."""
    return manifest.agg(F.coalesce(F.max("stt"), F.lit(0)).alias("stt_max"))


def duplicates(manifest: DataFrame) -> DataFrame:
    """url_key, n: keys of more than one row."""
    return keyed(manifest).groupBy("url_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assign_numbers(links: DataFrame, manifest: DataFrame, *, url: str = "url", pos: str = "pos") -> DataFrame:
    """``links`` with url_key and stt: known keys keep their number, each new key takes the next by its first place. Null links stay, without a number.

    Only the new distinct keys are numbered, and of these only a count per cell of places meets in one task.
    """
    own = links.withColumn("url_key", canonical_url(F.col(url)))
    known = known_keys(manifest)
    first = own.where("url_key is not null").join(known, "url_key", "left_anti").groupBy("url_key").agg(F.min(pos).alias("_first"))
    new = numbered(first, "_first", "_n").crossJoin(F.broadcast(highest(manifest))).select("url_key", (F.col("stt_max") + F.col("_n")).alias("stt"))
    return own.join(known.unionByName(new), "url_key", "left")


def first_places(keyed_rows: DataFrame) -> DataFrame:
    """url_key, _first: where each key stands first. Rows without a link have no key."""
    return keyed_rows.where("url_key is not null").groupBy("url_key").agg(F.min("pos").alias("_first"))


def latest_results(results: DataFrame) -> DataFrame:
    """url_key, r: the last result of each key, and each result without one."""
    alone = F.when(F.col("url_key").isNull(), F.col("order")).alias("_alone")
    return results.groupBy("url_key", alone).agg(F.max_by(F.struct("url", "title", "raw_name", "refine_name", "stt", "order"), "order").alias("r")).drop("_alone")


def upsert(manifest: DataFrame, results: DataFrame, now, *, top: int | None = None) -> DataFrame:
    """Merge ``results`` (url, title, raw_name, refine_name or null, stt or null, order) into ``manifest``.

    The first row of a key is updated but keeps its time; further rows of the key stay. A new key is put
    before all rows, later results above earlier ones, with its number or the next free one. Of several
    results of one key the last one counts. Null is no link: such rows stay as they are, and each such result is a row of its own.
    Where ``manifest`` is only a part of the rows, ``top`` is the first place of all; manifest and results then have their url_key, and results of new keys their number.
    """
    latest = latest_results(_with_key(results, top is not None))
    own = _with_key(manifest, top is not None)
    first = first_places(own)
    joined = own.join(first, "url_key", "left").join(latest.where("url_key is not null"), "url_key", "left").withColumn("_hit", F.coalesce(F.col("pos") == F.col("_first"), F.lit(False)) & F.col("r").isNotNull())
    done = F.coalesce(F.col("r.refine_name"), F.lit("")) != ""
    new_cells = {"title": table_title(F.col("r.title")), "raw_link": wikilink(F.col("r.raw_name")), "refine_link": F.when(done, wikilink(F.col("r.refine_name"))).otherwise(""), "status": F.when(done, "Done").otherwise("Raw only")}
    updated = joined.select(*(F.when(F.col("_hit"), new_cells[c]).otherwise(F.col(c)).alias(c) if c in new_cells else F.col(c) for c in COLUMNS))
    fresh = latest.join(first, "url_key", "left_anti")
    if top is None:
        # Numbers missing from results follow the highest known, in result order.
        missing = numbered(fresh.where(F.col("r.stt").isNull()).select(F.col("r.order").alias("_order")), "_order", "_n").select("_order", "_n")
        bounds = own.agg(F.coalesce(F.min("pos"), F.lit(0)).alias("_top"), F.coalesce(F.max("stt"), F.lit(0)).alias("_max"))
        places = fresh.withColumn("_order", F.col("r.order")).join(missing, "_order", "left").crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(fresh.agg(F.coalesce(F.max("r.stt"), F.lit(0)).alias("_given"))))
        number = F.coalesce(F.col("r.stt"), F.greatest("_max", "_given") + F.col("_n"))
    else:
        places, number = fresh.withColumn("_top", F.lit(top).cast("long")), F.col("r.stt")
    inserted = places.select((F.col("_top") - 1 - F.col("r.order")).alias("pos"), number.alias("stt"), F.col("r.url").alias("url"), new_cells["title"].alias("title"), now.alias("ts"), new_cells["raw_link"].alias("raw_link"), new_cells["refine_link"].alias("refine_link"), new_cells["status"].alias("status"))
    return updated.unionByName(inserted)


def mark_failures(manifest: DataFrame, failures: DataFrame, *, has_key: bool = False) -> DataFrame:
    """Status of the first row of each failed key (url, reason, order; the last reason counts). Unknown and null links write no row; rows without a link stay. With ``has_key`` both have their url_key."""
    latest = _with_key(failures, has_key).where("url_key is not null").groupBy("url_key").agg(F.max_by("reason", "order").alias("_reason"))
    own = _with_key(manifest, has_key)
    joined = own.join(first_places(own), "url_key", "left").join(latest, "url_key", "left")
    status = F.when((F.col("pos") == F.col("_first")) & F.col("_reason").isNotNull(), F.concat(F.lit("Failed: "), F.left("_reason", F.lit(REASON_LENGTH)))).otherwise(F.col("status"))
    return joined.select(*(status.alias(c) if c == "status" else F.col(c) for c in COLUMNS))


def new_links(links: DataFrame, manifest: DataFrame, *, url: str = "url") -> DataFrame:
    """Links whose key the manifest doesn't have."""
    own = links.withColumn("url_key", canonical_url(F.col(url)))
    return own.join(known_keys(manifest).select("url_key"), "url_key", "left_anti")


def link_counts(links: DataFrame, manifest: DataFrame, channel: str, *, url: str = "url") -> DataFrame:
    """channel, total, skipped, remaining."""
    own = links.withColumn("url_key", canonical_url(F.col(url))).join(known_keys(manifest).select("url_key", F.lit(True).alias("_known")), "url_key", "left")
    return own.groupBy(channel).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("_known", F.lit(False))).alias("skipped"), F.count_if(F.col("_known").isNull()).alias("remaining"))


def links_of(manifest: DataFrame) -> DataFrame:
    """stt, kind (raw, refine), target: the wikilinks that rows hold."""
    cells = F.array(F.struct(F.lit("raw").alias("kind"), wikilink_target(F.col("raw_link")).alias("target")), F.struct(F.lit("refine").alias("kind"), wikilink_target(F.col("refine_link")).alias("target")))
    return manifest.select("stt", "url", "title", F.explode(cells).alias("_l")).select("stt", "url", "title", "_l.kind", "_l.target").where("target is not null")


def first_row_of_each(manifest: DataFrame) -> DataFrame:
    return first_wins(keyed(manifest), "url_key", "pos")
