"""Messages without secrets, where no plan, log or table has a secret: only salted digests leave the driver."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REDACTED, single_spaced, without_keys
from .tables import bounded, written

#: Characters of a piece in which places are looked at one by one.
PIECE = 1024


def digests(spark: SparkSession, secrets: Iterable[str], salt: str) -> DataFrame:
    """length (characters), mark (CRC-32), digest (SHA-256) of the salted secrets; empty ones are left out. A mark tells 32 bits of a secret, so secrets must be longer than guesses."""
    rows = {(len(s), zlib.crc32((salt + s).encode()), hashlib.sha256((salt + s).encode()).hexdigest()) for s in secrets if s}
    return spark.createDataFrame(sorted(rows), "length int, mark long, digest string")


def spans(rows: DataFrame, known: DataFrame, *, salt: str) -> DataFrame:
    """_row, from, to (characters from 0) of all places of ``rows`` (_row, text) that hold a secret of ``known`` (``written`` digests).

    Texts are cut into pieces that overlap by the longest secret. Every place of a piece is marked for each length that secrets have, and marks meet those of the
    secrets; what shares a mark is compared by digest. The digests are broadcast if they are few enough, else places are shuffled by mark, which
    no text can make hot: alike places of a text count once a piece.
    """
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())
    if not lengths:
        return rows.select("_row", F.lit(0).alias("from"), F.lit(0).alias("to")).limit(0)
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(PIECE))
    pieces = rows.select("_row", F.explode(starts).alias("_start"), "text").select("_row", "_start", F.substring(F.col("text"), F.col("_start") + 1, F.lit(PIECE + lengths[-1] - 1)).alias("_piece"))

    def places(length: int) -> Column:
        most = F.least(F.char_length("_piece") - length + 1, F.lit(PIECE))
        at = F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(p.cast("int").alias("at"), F.lit(length).alias("length"), F.crc32(F.concat(F.lit(salt), F.substring(F.col("_piece"), p, F.lit(length))).cast("binary")).alias("mark")))

    each = pieces.select("_row", "_start", F.explode(F.flatten(F.array(*map(places, lengths)))).alias("_p")).select("_row", "_start", "_p.at", "_p.length", "_p.mark")
    alike = each.join(bounded(known.select("length", "mark", "digest")), ["length", "mark"])
    met = alike.join(rows, "_row")
    found = met.where(F.sha2(F.concat(F.lit(salt), F.substring(F.col("text"), F.col("_start") + F.col("at"), F.col("length"))).cast("binary"), 256) == F.col("digest"))
    return found.select("_row", (F.col("_start") + F.col("at") - 1).alias("from"), (F.col("_start") + F.col("at") - 1 + F.col("length")).alias("to"))


def _cut(text: Column, places: Column) -> Column:
    """``text`` with each run of overlapping places (sorted structs of from, to) replaced once."""
    start = F.struct(F.lit("").alias("said"), F.lit(0).alias("done"))
    more = lambda acc, p: F.concat(acc["said"], F.substring(text, acc["done"] + 1, p["from"] - acc["done"]), F.lit(REDACTED))
    step = lambda acc, p: F.when((p["from"] < acc["done"]), F.struct(acc["said"].alias("said"), F.greatest(acc["done"], p["to"]).alias("done"))).otherwise(F.struct(more(acc, p).alias("said"), p["to"].alias("done")))
    return F.aggregate(places, start, step, lambda acc: F.concat(acc["said"], F.substring(text, acc["done"] + 1, F.greatest(F.char_length(text) - acc["done"], F.lit(0)))))


def redacted(messages: DataFrame, known: DataFrame, *, salt: str, text: str = "message") -> DataFrame:
    """``messages`` with ``text`` as ``text.redact`` makes it: one line of at most 500 characters, without secrets and values of key parameters.

    Secrets that overlap go as one. Null texts stay null; repeated rows stay. Columns keep their names and order.
    """
    own = written(messages.select(F.struct(*messages.columns).alias("_message"), F.monotonically_increasing_id().alias("_row"), single_spaced(F.col(text)).alias("_line")), "messages")
    known = written(known, "digests")
    places = spans(own.where(F.col("_line").isNotNull()).select("_row", F.col("_line").alias("text")), known, salt=salt).distinct()
    grouped = places.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to")))).alias("_places"))
    met = own.join(grouped, "_row", "left")
    line = F.when(F.col("_places").isNull(), F.col("_line")).otherwise(_cut(F.col("_line"), F.col("_places")))
    return met.select(*(without_keys(line).alias(c) if c == text else F.col("_message")[c].alias(c) for c in messages.columns))
