"""Readers and writers for the files of the library. Lines keep their order by an explicit position."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import config_key
from ..functions.urls import strip
from ..operators import manifest as M
from ..operators.tables import bounded, written

VIDEO_KINDS = ("mp4", "mkv", "avi", "mov", "webm", "flv")
AUDIO_KINDS = ("mp3", "wav", "m4a", "aac", "ogg", "flac")
# Patterns of settings, reference lines and audio addresses.
CONFIG_LINE = r"^\s*([A-Za-z_][A-Za-z0-9_-]*)\s*[:=]\s*(.*?)\s*(?:#.*)?$"
REFERENCE_LINE = r"\A>[^\n]*Reference:.*?\n"
MP3 = r"""(https?://[^"'\s>]+?\.mp3)"""

USAGE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("model", T.StringType()), ("tier", T.StringType()), ("attempt", T.LongType()), ("input", T.LongType()), ("output", T.LongType()), ("thinking", T.LongType()), ("total", T.LongType()), ("status", T.StringType()))]))
HISTORY = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "status", "message", "raw", "refine")] + [T.StructField(n, T.BooleanType()) for n in ("update", "raw_selected", "refine_selected")] + [T.StructField("usage", USAGE), T.StructField("time", T.StringType())])


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """The other columns, pos and line."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("pos", "line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, n, line: the place of each line in its file, and in all files of ``path`` by their names, from 0.

    Files of any size are read by ranges of bytes in as many tasks as they have splits. Lines are stored once with a number that grows within a split;
    lines are counted a split, and the counts of the splits before a line's own are added to its place there. No file, and no text, goes
    through one task: what meets in one is a row a split. A line ends with LF, CR LF or CR.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    own = written(spark.read.text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), "lines")
    counts = own.groupBy("split").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = lambda *by: F.sum("_n").over(Window.partitionBy(*by).orderBy("split")) - F.col("_n")
    places = written(counts.select("split", "_first", before("split.path").alias("_pos"), before(F.lit(0)).alias("_all")), "splits")
    inner = F.col("at") - F.col("_first")
    return own.join(bounded(places), "split").select("split.path", (F.col("_pos") + inner).alias("pos"), (F.col("_all") + inner).alias("n"), "line")


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, n, item: trimmed lines that aren't blank, with their places as ``numbered_lines`` gives them."""
    return numbered_lines(spark, path).select("path", "pos", "n", strip(F.col("line")).alias("item")).where("item <> ''")


def items(files: DataFrame, text: str = "text") -> DataFrame:
    """The other columns, pos and item: trimmed lines that aren't blank."""
    return lines(files, text).withColumn("item", strip(F.col("line"))).drop("line").where("item <> ''")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest file, or of the parts of one in a folder; pos counts lines over all parts."""
    return M.parse(numbered_lines(spark, path), pos="n")


def config(config_lines: DataFrame, environment: DataFrame | None = None) -> DataFrame:
    """key, value of ``KEY=VALUE`` and ``key: value`` lines (pos, line); the first of a key wins, and ``environment`` (key, value) before all."""
    from ..operators.dedup import first_wins

    named = config_lines.where(F.col("line").rlike(CONFIG_LINE)).select("pos", config_key(F.regexp_extract("line", CONFIG_LINE, 1)).alias("key"), strip(F.regexp_extract("line", CONFIG_LINE, 2)).alias("value"))
    if environment is not None:
        named = named.unionByName(environment.select(F.lit(-1).alias("pos"), "key", "value"))
    return first_wins(named, "key", "pos").select("key", "value")


def raw_body(text: Column) -> Column:
    """A raw document without the reference line at its start; null if nothing is left."""
    # Only the first match at the very start goes.
    return F.nullif(strip(F.regexp_replace(text, REFERENCE_LINE, "")), F.lit(""))


def raw_document(reference: Column, body: Column) -> Column:
    return F.concat(F.lit("> **Reference:** "), reference, F.lit("\n\n"), body)


def refine_document(body: Column, reference: Column) -> Column:
    return F.concat(strip(body), F.lit("\n\n***\n**Reference:** "), reference, F.lit("\n"))


def refine_parts(text: Column) -> Column:
    """Struct of vi, en (each title, lessons, quotes) and reference; halves that are missing are null. Rules may be ``***`` or ``---``."""
    pieces = F.filter(F.split(text, r"(?m)^\s*(?:\*\*\*|---)\s*$"), lambda p: strip(p) != "")
    body = F.filter(pieces, lambda p: ~p.rlike(r"\A\s*\*\*Reference:\*\*"))

    def half(n: int) -> Column:
        own = F.get(body, F.lit(n))
        rows = F.transform(F.split(own, "\n"), strip)
        title = F.regexp_replace(F.get(F.filter(rows, lambda r: r != ""), F.lit(0)), r"^[#*\s]+|[*\s]+$", "")
        lessons = F.transform(F.filter(rows, lambda r: r.rlike(r"^[-*]\s+")), lambda r: F.regexp_replace(r, r"^[-*]\s+", ""))
        quotes = F.transform(F.filter(rows, lambda r: r.rlike(r"^>\s*")), lambda r: F.regexp_replace(r, r"^>\s*", ""))
        return F.when(own.isNotNull(), F.struct(title.alias("title"), lessons.alias("lessons"), quotes.alias("quotes")))

    return F.struct(half(0).alias("vi"), half(1).alias("en"), F.nullif(strip(F.regexp_extract(text, r"\*\*Reference:\*\*\s*([^\n]*)", 1)), F.lit("")).alias("reference"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Runs, with time as a timestamp."""
    return spark.read.schema(HISTORY).json(path).withColumn("time", F.to_timestamp("time"))


def history_row(line: Column) -> Column:
    """A run of one JSON line, as ``history`` reads it."""
    return F.from_json(line, HISTORY)


def channel_videos(listings: DataFrame, entries: str = "entries") -> DataFrame:
    """channel, pos, url, title, duration of array<struct<url, id, title, duration>>; empty strings count as missing."""
    e = F.col("e")
    full = lambda c: F.nullif(c, F.lit(""))
    return (
        listings.select("channel", F.posexplode(entries).alias("pos", "e"))
        .where(e.isNotNull())
        .select("channel", "pos", F.coalesce(full(e["url"]), F.concat(F.lit("https://www.youtube.com/watch?v="), F.coalesce(e["id"], F.lit("None")))).alias("url"), F.coalesce(full(e["title"]), full(e["id"]), F.lit("Khong ro tieu de")).alias("title"), F.coalesce(e["duration"], F.lit(0.0)).alias("duration"))
    )


def media_files(spark: SparkSession, folder: str, kinds: tuple = VIDEO_KINDS + AUDIO_KINDS) -> DataFrame:
    """path, name, size_kb (rounded up) of media files, by extension in any case. Contents aren't read."""
    return media_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length"), kinds)


def media_of(found: DataFrame, kinds: tuple = VIDEO_KINDS + AUDIO_KINDS) -> DataFrame:
    """The same of a listing: path, length."""
    return found.where(F.lower("path").rlike(r"\.(" + "|".join(kinds) + ")$")).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.ceil(F.col("length") / 1024).alias("size_kb"))


def mp3_url(html: Column) -> Column:
    """Audio address of a page: the ``og:audio`` meta element, else the first address of an MP3, else null."""
    meta = F.regexp_extract(html, r"""(?is)(<meta\b[^>]*\bproperty\s*=\s*["']?og:audio["']?(?=[\s/>])[^>]*>)""", 1)
    return F.coalesce(F.nullif(F.regexp_extract(meta, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1), F.lit("")), F.nullif(F.regexp_extract(html, MP3, 1), F.lit("")))


def write_links(links: DataFrame, path: str, *, url: str = "url", order: str = "pos") -> None:
    """One link a line, in order: range partitions make ordered part files."""
    links.repartitionByRange(order).sortWithinPartitions(order).select(url).write.mode("overwrite").text(path)


#: Schemes of Spark's readers that the Arrow file systems know by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "wasbs": "abfs", "abfss": "abfs"}


def filesystem(folder: str):
    """The Arrow file system of a folder that Spark names, and the folder's path there."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    if mark:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}") if folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_documents(docs: DataFrame, folder: str, *, kind: str = "raw", stem: str = "stem", text: str = "text", overwrite: bool = False) -> int:
    """Each document as its own file ``<stem>_<kind>.md`` in ``folder``, which all executors share; returns how many were written.

    Files that are there stay as they are, unless ``overwrite``; files of other stems always do. A file is written under
    another name and moved, so a repeated task leaves whole files. Of a repeated stem the text that sorts first counts; null stems are
    left out, null texts are empty files.
    """
    own = docs.where(F.col(stem).isNotNull()).groupBy(F.col(stem).alias("stem")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            n = 0
            for name, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{at}/{name}_{kind}.md"
                if not overwrite and store.get_file_info(path).type.name != "NotFound":
                    continue
                draft = f"{at}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(said.encode())
                store.move(draft, path)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return own.mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
