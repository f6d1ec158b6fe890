"""Candles from a paged history as a Spark data source, for ``read`` and ``readStream``.

``fetch(symbol, offset, size)`` counts back from the newest bar and returns at most ``size`` tuples
(epoch seconds, open, high, low, close, tick_volume, spread), in any order; no tuples mean that the
history goes no further back. It raises ConnectionError when a page can't be had.

Each page is a task. As bars go on arriving, offsets move; so a page is tied to an anchor, the time of
the newest bar when the job was planned, and its reader looks up where the anchor stands by now. A task
that runs again, and a batch of a stream that runs again, thus read the same bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[str, int, int], list[tuple]]

SCHEMA = "page int, fine boolean, symbol string, time timestamp, open double, high double, low double, close double, tick_volume long, spread long"
TRIES = 10


@dataclass
class Page(InputPartition):
    """``size`` bars from ``offset`` bars before the anchor on, as far as they are newer than ``after``."""

    number: int
    anchor: int
    offset: int
    size: int
    after: int | None = None


def newer(fetch: Fetch, symbol: str, epoch: int) -> int:
    """How many bars are newer than ``epoch``, by single bars at doubling and then halving steps."""

    def old(position: int) -> bool:
        rows = fetch(symbol, position, 1)
        return not rows or rows[0][0] <= epoch

    if old(0):
        return 0
    low, high = 0, 1
    while not old(high):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if old(middle) else (middle, high)
    return high


def bars_of(fetch: Fetch, symbol: str, page: Page) -> list[tuple]:
    """The page's bars, oldest first; fetched anew if others arrived meanwhile."""
    for _ in range(TRIES):
        shift = newer(fetch, symbol, page.anchor)
        rows = fetch(symbol, shift + page.offset, page.size)
        if newer(fetch, symbol, page.anchor) == shift:
            return sorted(r for r in rows if r[0] <= page.anchor and (page.after is None or r[0] > page.after))
    raise ConnectionError(f"bars of {symbol} arrive faster than page {page.number} can be read")


def _pages(anchor: int, count: int, size: int, after: int | None = None) -> list[Page]:
    return [Page(i, anchor, at, min(size, count - at), after) for i, at in enumerate(range(0, count, size))]


def _rows(symbol: str, page: Page, bars: list[tuple]) -> Iterator[tuple]:
    for epoch, *prices, volume, spread in bars:
        yield (page.number, True, symbol, datetime.fromtimestamp(epoch, timezone.utc), *map(float, prices), int(volume), int(spread))


class _Batch(DataSourceReader):
    """The last ``count`` bars. A page that can't be had is one row with ``fine`` false."""

    def __init__(self, fetch: Fetch, options: dict):
        self.fetch, self.symbol = fetch, options.get("symbol", "EURUSD")
        self.count, self.page = int(options.get("count", 5000)), int(options.get("page", 5000))

    def partitions(self):
        newest = self.fetch(self.symbol, 0, 1)
        return _pages(newest[0][0], self.count, self.page) if newest else []

    def read(self, page):
        if page is None:  # an empty history
            return
        try:
            bars = bars_of(self.fetch, self.symbol, page)
        except ConnectionError:
            yield (page.number, False, self.symbol, *[None] * 7)
            return
        yield from _rows(self.symbol, page, bars)


class _Stream(DataSourceStreamReader):
    """Bars newer than ``since`` (epoch seconds), each once. With ``open`` the newest bar is left
    until the next one begins. A page that can't be had fails the batch, which then runs again."""

    def __init__(self, fetch: Fetch, options: dict):
        self.fetch, self.symbol, self.page = fetch, options.get("symbol", "EURUSD"), int(options.get("page", 5000))
        self.since, self.first = int(options.get("since", 0)), int(options.get("open", "false").lower() == "true")
        self.seen = self.since

    def initialOffset(self):
        return {"epoch": self.since}

    def latestOffset(self):
        try:
            newest = self.fetch(self.symbol, self.first, 1)
        except ConnectionError:  # nothing new until it answers again
            newest = []
        self.seen = max([self.seen, *[r[0] for r in newest]])
        return {"epoch": self.seen}

    def partitions(self, start, end):
        begin, last = start["epoch"], end["epoch"]
        self.seen = max(self.seen, last)
        count = newer(self.fetch, self.symbol, begin) - newer(self.fetch, self.symbol, last)
        return _pages(last, count, self.page, begin)

    def read(self, page):
        if page is not None:
            yield from _rows(self.symbol, page, bars_of(self.fetch, self.symbol, page))

    def commit(self, end):
        """The history keeps its bars, so nothing has to be released."""


def register(spark: SparkSession, fetch: Fetch, name: str = "paged_history") -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read from ``fetch``.

    Options: symbol, page (bars of a page), count (batch), since and open (stream).
    """

    class History(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Batch(fetch, self.options)

        def streamReader(self, schema):
            return _Stream(fetch, self.options)

    spark.dataSource.register(History)


def unbroken(df: DataFrame) -> DataFrame:
    """The candles of a batch read that are newer than every page that could not be had."""
    broken = df.filter("not fine").groupBy(F.col("symbol").alias("_symbol")).agg(F.min("page").alias("_broken"))
    # at most one row for each symbol of the read, which is one
    kept = df.join(F.broadcast(broken), F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
    return kept.filter("fine and (_broken is null or page < _broken)").drop("page", "fine", "_symbol", "_broken")
