"""How long keys of a rate-limited service rest, from observed calls: as a stream with state and timers, and in one batch.

A quota error lets its key rest for as long as it says; the latest error decides. After an answered call a key waits its interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import errors as E

RESTS = "key string, event string, rest_until long, last_call long, ready long"


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp; of one without a zone as it reads, whatever the session's zone."""
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(name)
    whole = F.unix_date(F.to_date(name)) * 86_400 + F.hour(name) * 3_600 + F.minute(name) * 60
    return whole.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(name)) * 1_000_000).cast("long")


def observed(calls: DataFrame) -> DataFrame:
    """key, at, rest (microseconds; null if the call lets no key rest), called, wait (microseconds from at until the key may be called again) of key, tier, at (timestamp), message (null: answered), interval (seconds).

    Times are whole microseconds, so that state needs no time zone. Only keys of the free tier rest, as paid ones don't know quota errors.
    """
    micros = _micros(calls, "at")
    quota = E.classify(F.col("message"), F.col("tier")) == "quota"
    rest = F.when(quota, micros + F.round(E.cooldown(F.col("message")) * 1_000_000).cast("long"))
    called = F.when(F.col("message").isNull(), micros)
    return calls.select("key", "at", micros.alias("micros"), rest.alias("rest"), called.alias("called"), (called + F.round(F.col("interval") * 1_000_000).cast("long")).alias("again"))


def key_rests(calls: DataFrame) -> DataFrame:
    """key, rest_until, last_call, ready (microseconds; ready is null for a key that never had to wait) after all ``calls``. A key of very many calls costs a row a task."""
    own = observed(calls).groupBy("key").agg(F.max(F.when(F.col("rest").isNotNull(), F.struct("micros", "rest"))).alias("_r"), F.max(F.when(F.col("called").isNotNull(), F.struct("called", "again"))).alias("_c"))
    return own.select("key", F.col("_r.rest").alias("rest_until"), F.col("_c.called").alias("last_call"), F.greatest("_r.rest", "_c.again").alias("ready"))


class _Rests(StatefulProcessor):
    """State of a key: time and end of its latest rest, time of its latest answer and when it may be called after it. Both are maxima, so order and repeats of events don't matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rest", "quota_at long, rest long, called long, again long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        quota, call = self._known()
        for batch in rows:
            for micros, rest, called, again in batch[["micros", "rest", "called", "again"]].itertuples(index=False):
                if pd.notna(rest):
                    quota = max(quota, (int(micros), int(rest)))
                if pd.notna(called):
                    call = max(call, (int(called), int(again)))
        self.state.update((*quota, *call))
        ready = max(quota[1], call[1])
        if ready >= 0:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-ready // 1000))
        yield self._row(key, "rests", quota, call)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, "free", *self._known())

    def close(self) -> None:
        pass

    def _known(self):
        held = self.state.get() if self.state.exists() else (-1, -1, -1, -1)
        return tuple(map(int, held[:2])), tuple(map(int, held[2:]))

    @staticmethod
    def _row(key, event, quota, call) -> pd.DataFrame:
        known = lambda x: x if x >= 0 else None
        row = {"key": [key[0]], "event": [event], "rest_until": [known(quota[1])], "last_call": [known(call[0])], "ready": [known(max(quota[1], call[1]))]}
        return pd.DataFrame(row).astype({c: "Int64" for c in ("rest_until", "last_call", "ready")})


def key_rest_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """RESTS of a stream of calls: an event ``rests`` for each key that calls came in for, with all that is known of it, and ``free`` once the watermark passes its ready time.

    Calls may come late by ``late`` and more than once; what is known of a key after all of them is what ``key_rests`` says. Needs the RocksDB state store.
    """
    seen = observed(calls).withWatermark("at", late)
    return seen.groupBy("key").transformWithStateInPandas(statefulProcessor=_Rests(), outputStructType=RESTS, outputMode="Update", timeMode="EventTime")
