"""Caption files to running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import let, replace_spaces, strip

# Lines that are headers, and the mark of a cue's times.
HEADERS = ("WEBVTT", "Language:", "Kind:")
CUE = "-->"


def folded(lines: Column) -> Column:
    """Lines that are no part of the last line kept. The state carries that line, so this isn't a comparison with the line before."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("last"))
    step = lambda acc, x: F.when(F.coalesce(F.contains(acc["last"], x), F.lit(False)), acc).otherwise(F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x.alias("last")))
    return F.aggregate(lines, start, step, lambda acc: acc["kept"])


def fold_text(lines: Column) -> Column:
    """The same joined with blanks; the state is the text so far, which stays linear where an array of kept lines would be copied at every step."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("last"))
    step = lambda acc, x: F.when(F.coalesce(F.contains(acc["last"], x), F.lit(False)), acc).otherwise(F.struct(F.when(acc["last"].isNull(), x).otherwise(F.concat(acc["text"], F.lit(" "), x)).alias("text"), x.alias("last")))
    return F.aggregate(lines, start, step, lambda acc: acc["text"])


def caption_lines(text: Column) -> Column:
    """Spoken lines in order: without headers, cue times, the line before each cue time, and tags."""
    def spoken(x: Column) -> Column:
        return let(strip(x), lambda y: (y != "") & ~y.rlike("^(" + "|".join(HEADERS) + ")")) & ~F.contains(x, F.lit(CUE))

    def kept(lines: Column) -> Column:
        # Each line with the next one: looking the next one up by its place would read the array once a line.
        paired = F.zip_with(lines, F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit(""))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.transform(F.filter(paired, lambda p: spoken(p["x"]) & ~F.contains(p["y"], F.lit(CUE))), lambda p: F.regexp_replace(strip(p["x"]), "<[^>]+>", ""))

    return F.filter(let(F.split(text, r"\r\n|\r|\n"), kept), lambda x: x != "")


def caption_text(text: Column) -> Column:
    """Clean running text of a caption file; white space after a sentence's end becomes a blank line."""
    return replace_spaces(fold_text(caption_lines(text)), "([.!?]){}+", "$1\n\n")


def choose_caption(media: DataFrame, files: DataFrame, *, media_id: str = "media_id", name: str = "name") -> DataFrame:
    """media_id, name: the caption file whose name starts with the id; ``.vtt`` before ``.srt`` in any case, then ``en`` before others, then by name.

    A name goes by its prefixes of lengths that ids have, and of each prefix only the best file counts. That is settled before the
    shuffle, a row a task, so a beginning that all names share is no hot key; ids then meet prefixes one to one.
    """
    ids = media.select(F.col(media_id).alias("_id")).where(F.col("_id") != "").distinct()
    lengths = ids.agg(F.sort_array(F.collect_set(F.length("_id"))).alias("_lengths"))
    listed = files.select(F.col(name).alias("_name"), F.lower(F.regexp_extract(name, r"(?i)\.(vtt|srt)$", 1)).alias("_kind")).where("_kind <> ''").crossJoin(F.broadcast(lengths))
    fitting = F.filter("_lengths", lambda n: n <= F.length("_name"))
    prefixes = listed.select("_name", F.struct((F.col("_kind") != "vtt").alias("a"), (~F.contains("_name", F.lit(".en."))).alias("b"), F.col("_name").alias("c")).alias("_order"), F.explode(F.transform(fitting, lambda n: F.left("_name", n))).alias("_id"))
    best = prefixes.groupBy("_id").agg(F.min_by("_name", "_order").alias(name))
    return ids.join(best, "_id").select(F.col("_id").alias(media_id), name)
