"""Listings of channels as a Spark data source: pages are partitions of a batch, and what a stream goes on by."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTED = "channel string, page int, pos int, url string, id string, title string, duration double"


class Page(InputPartition):
    def __init__(self, channel: str, page: int):
        self.channel, self.page = channel, page


class _Fetch:
    """Pages by the caller's ``fetch``; a page is given out whole after it was fetched whole, so a trial that failed leaves no rows."""

    def __init__(self, fetch: Callable, trials: int, wait: float, sleep: Callable):
        self.fetch, self.trials, self.wait, self.sleep = fetch, trials, wait, sleep

    def rows(self, page: Page) -> Iterator[tuple]:
        for trial in range(1, self.trials + 1):
            try:
                found = list(self.fetch(page.channel, page.page))
                break
            except Exception:  # the caller's call may raise anything
                if trial == self.trials:
                    raise
                self.sleep(self.wait)
        for pos, entry in enumerate(found):
            if entry is not None:
                duration = entry.get("duration")
                yield page.channel, page.page, pos, entry.get("url"), entry.get("id"), entry.get("title"), None if duration is None else float(duration)


class _Batch(DataSourceReader):
    def __init__(self, channels: list[str], count: Callable, fetch: _Fetch):
        self.channels, self.count, self.fetch = channels, count, fetch

    def partitions(self) -> list[Page]:
        return [Page(c, k) for c in self.channels for k in range(self.count(c))]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch.rows(partition)


class _Stream(DataSourceStreamReader):
    """An offset is the number of pages of each channel that have been read; pages of a channel are taken as complete once they are listed."""

    def __init__(self, channels: list[str], count: Callable, fetch: _Fetch):
        self.channels, self.count, self.fetch = channels, count, fetch

    def initialOffset(self) -> dict:
        return {c: 0 for c in self.channels}

    def latestOffset(self) -> dict:
        return {c: self.count(c) for c in self.channels}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(c, k) for c in end for k in range(start.get(c, 0), end[c])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.fetch.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def channel_source(count: Callable, fetch: Callable, *, name: str = "channel_listing", trials: int = 3, wait: float = 1.0, sleep: Callable = time.sleep) -> type[DataSource]:
    """A data source to register with ``spark.dataSource.register``; then ``spark.read`` or ``readStream.format(name).option("channels", json list)``.

    ``count(channel)`` says how many pages a channel has, ``fetch(channel, page)`` gives a page's entries as dictionaries of url, id, title and
    duration (None entries are left out). Both are the caller's and must pickle. A page that fails is fetched again up to ``trials`` times.
    """

    class Channels(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LISTED

        def _channels(self) -> list[str]:
            return json.loads(self.options.get("channels", "[]"))

        def reader(self, schema) -> DataSourceReader:
            return _Batch(self._channels(), count, _Fetch(fetch, trials, wait, sleep))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(self._channels(), count, _Fetch(fetch, trials, wait, sleep))

    return Channels


def videos(listed: DataFrame) -> DataFrame:
    """channel, page, pos, url, title, duration of LISTED rows, with the fallbacks of ``files.channel_videos``."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    url = F.coalesce(full("url"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.coalesce("id", F.lit("None"))))
    return listed.select("channel", "page", "pos", url.alias("url"), F.coalesce(full("title"), full("id"), F.lit("Khong ro tieu de")).alias("title"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
