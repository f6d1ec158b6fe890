"""The paged history as a data source, over a fake one that grows, moves and fails."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from volclock.sources import history


class Fake:
    """Bars 0 to n - 1, every 300 s; ``n`` and pages that fail are read from files, so that tasks see them."""

    def __init__(self, folder):
        self.folder = str(folder)
        self.set(0)

    def set(self, n: int, broken: int | None = None, moving: bool = False):
        with open(f"{self.folder}/state", "w") as f:
            f.write(f"{n} {-1 if broken is None else broken} {int(moving)}")

    def __call__(self, symbol, offset, size):
        with open(f"{self.folder}/state") as f:
            n, broken, moving = map(int, f.read().split())
        if size > 1 and moving:  # a bar arrives while a page is read, once
            n += 1
            self.set(n)
        if size > 1 and offset <= n - 1 - broken < offset + size and broken >= 0:
            raise ConnectionError("no answer")
        return [(300 * i, float(i), i + 0.5, i - 0.5, float(i), 10, 1) for i in range(max(0, n - offset - size), max(0, n - offset))]


def numbers(df):
    return sorted(round(r["close"]) for r in df.collect())


@pytest.fixture
def fake(spark, tmp_path):
    made = Fake(tmp_path)
    history.register(spark, made, "fake_history")
    return made


def read(spark, **options):
    return spark.read.format("fake_history").options(**options).load()


def test_batch(spark, fake):
    assert history.unbroken(read(spark, count=10)).collect() == []
    fake.set(25)
    df = read(spark, symbol="USDJPY", count=20, page=6)
    assert df.rdd.getNumPartitions() == 4
    got = history.unbroken(df)
    assert got.columns == ["symbol", "time", "open", "high", "low", "close", "tick_volume", "spread"]
    assert numbers(got) == list(range(5, 25))
    last = got.orderBy(F.desc("time")).first()
    assert (last["symbol"], last["time"], last["high"], last["spread"]) == ("USDJPY", datetime(1970, 1, 1) + timedelta(seconds=300 * 24), 24.5, 1)
    assert numbers(history.unbroken(read(spark, count=100, page=6))) == list(range(25))  # no further back


def test_failed_page(spark, fake):
    fake.set(25, broken=15)  # pages of 24-19, 18-13 (fails), 12-7, 6-1
    df = read(spark, count=24, page=6)
    assert numbers(history.unbroken(df)) == list(range(19, 25))
    assert df.filter("not fine").count() == 1
    fake.set(25, broken=24)
    assert history.unbroken(read(spark, count=24, page=6)).collect() == []


@pytest.mark.parametrize("arrived", [1, 2, 5, 13])
def test_pages_keep_their_bars(spark, fake, arrived):
    """Bars that arrive after planning, and while a page is read, move no page."""
    fake.set(30)
    pages = history._pages(300 * 29, 20, 6)
    before = [history.bars_of(fake, "x", p) for p in pages]
    fake.set(30 + arrived)
    assert [history.bars_of(fake, "x", p) for p in pages] == before
    fake.set(30 + arrived, moving=True)
    assert [history.bars_of(fake, "x", p) for p in pages] == before
    assert sorted(r[0] // 300 for b in before for r in b) == list(range(10, 30))


def test_position(fake):
    fake.set(1000)
    assert [history.newer(fake, "x", e) for e in (-1, 0, 299, 300, 300 * 998, 300 * 999, 10**9)] == [1000, 999, 999, 998, 1, 0, 0]


def test_stream(spark, fake, tmp_path):
    """Every bar once, over growth, a restart and a page that fails; the open bar waits."""

    def run():
        source = spark.readStream.format("fake_history").options(page=4, open="true", since=300 * 9).load()
        query = source.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()

    held = lambda: numbers(spark.read.schema(history.SCHEMA).parquet(f"{tmp_path}/out"))
    fake.set(20)
    run()
    assert held() == list(range(10, 19))
    run()
    assert held() == list(range(10, 19))
    fake.set(31, broken=24)
    with pytest.raises(Exception, match="no answer"):
        run()
    fake.set(40)  # the batch that failed runs again with its own bars, then the rest follows
    run()
    run()
    assert held() == list(range(10, 39))
