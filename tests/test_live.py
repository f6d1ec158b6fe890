"""The live loop over file streams: duplicates, corrections, restarts, holding limit, gates."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from volclock.config import Training
from volclock.operators import trading
from volclock.plans import pipeline
from volclock.sources import candles
from volclock.streaming import live, loop

BEGIN = datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp, open double, high double, low double, close double, tick_volume long, spread long"


def bar(i, close, ticks=10, symbol="EURUSD"):
    return (symbol, BEGIN + timedelta(minutes=5 * i), close, close, close, close, ticks, 1)


def model(df):
    """Buys above 1, sells below, with more confidence than the threshold unless close is 1."""
    up = F.when(F.col("close") > 1, 0.8).when(F.col("close") < 1, 0.1).otherwise(0.55)
    return df.select("symbol", "time", F.array(F.lit(0.9) - up, F.lit(0.1), up).alias("probabilities"), F.lit(0.01).alias("width"))


def quotes(spark, bid=1.1, ask=1.1001):
    return lambda: spark.createDataFrame([("EURUSD", bid, ask, 2)], "symbol string, bid double, ask double, fill_mask int")


def fed(spark, folder, live_loop, *batches):
    """Each batch is a file that one run of the stream reads."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live_loop.start(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/checkpoint", None).awaitTermination()


def test_live_loop(spark, tmp_path):
    broker = live.SimulatedBroker()
    new = lambda: loop.LiveLoop(loop.Versions(spark, f"{tmp_path}/tables"), model, quotes(spark), broker, Training(cooldown_minutes=10))
    first = new()
    fed(spark, tmp_path, first, [bar(i, 2.0) for i in range(3)])
    assert broker.connected and broker.orders == {}  # the first bar only starts the state
    fed(spark, tmp_path, first, [bar(2, 2.0), bar(2, 2.0), bar(3, 2.0)])
    (order,) = broker.orders.values()
    assert (order["side"], order["price"], order["fill"], order["deviation"], order["lots"]) == (1, 1.1001, "ioc", 20, 4.0)
    assert order["take_profit"] == pytest.approx(1.1071) and order["stop_loss"] == pytest.approx(1.0961)

    again = new()  # a restart goes on from the checkpoint
    fed(spark, tmp_path, again, [bar(4, 2.0)])
    assert len(broker.orders) == 1  # the pause
    fed(spark, tmp_path, again, [bar(4, 0.5, ticks=99), bar(5, 2.0)])
    assert [o["side"] for o in broker.orders.values()] == [1, -1]  # the corrected candle counts
    fed(spark, tmp_path, again, [bar(5, 1.0, ticks=99), bar(6, 1.0)], [bar(6, 1.0)], [bar(40, 1.0)])
    assert len(broker.orders) == 2 and all(o["closed"] for o in broker.orders.values())  # past the holding limit
    held = spark.read.parquet(f"{tmp_path}/tables/candles/{6 % 2}")
    assert held.count() == held.select("symbol", "time").distinct().count() == 8


def test_batch_runs_again(spark, tmp_path):
    broker = live.SimulatedBroker()
    one = loop.LiveLoop(loop.Versions(spark, str(tmp_path)), model, quotes(spark), broker)
    batches = [spark.createDataFrame(rows, SCHEMA) for rows in ([bar(0, 2.0), bar(1, 2.0)], [bar(2, 2.0)])]
    for epoch in (0, 0, 1, 1):
        one(batches[epoch], epoch)
    assert len(broker.orders) == 1 and spark.read.parquet(f"{tmp_path}/positions/1").count() == 1


def test_batch_runs_again_with_other_quotes(spark, tmp_path):
    """The broker holds the order of the first run, and so do the positions after the second."""
    broker, spread = live.SimulatedBroker(), [1.1001]
    one = loop.LiveLoop(loop.Versions(spark, str(tmp_path)), model, lambda: quotes(spark, ask=spread[0])(), broker)
    one(spark.createDataFrame([bar(0, 2.0), bar(1, 2.0)], SCHEMA), 0)
    one(spark.createDataFrame([bar(2, 2.0)], SCHEMA), 1)
    spread[0] = 1.2  # too wide for any order
    one(spark.createDataFrame([bar(2, 2.0)], SCHEMA), 1)
    assert len(broker.orders) == 1 and spark.read.parquet(f"{tmp_path}/positions/1").count() == 1
    # a symbol without new candles expires by the candles of others
    one(spark.createDataFrame([bar(100, 1.0, symbol="USDJPY")], SCHEMA), 2)
    assert all(o["closed"] for o in broker.orders.values()) and spark.read.parquet(f"{tmp_path}/positions/0").count() == 0
    again = loop.LiveLoop(loop.Versions(spark, str(tmp_path)), model, quotes(spark), live.SimulatedBroker(), now=lambda: BEGIN)
    again(spark.createDataFrame([bar(0, 2.0)], SCHEMA), 0)  # another life in the same folder
    again(spark.createDataFrame([bar(1, 2.0)], SCHEMA), 1)
    assert again.broker.orders == {}


def test_gates(spark):
    cfg = Training(max_open_trades=2)
    now, ago = BEGIN + timedelta(hours=2), BEGIN + timedelta(hours=1)
    signals = spark.createDataFrame([("EURUSD", ago, 1, 0.7, 0.01)], "symbol string, time timestamp, side int, confidence double, width double")
    clock = spark.createDataFrame([("EURUSD", now)], "symbol string, now timestamp")
    none = spark.createDataFrame([], loop.POSITIONS)

    def n(seen=BEGIN, entered=None, held=0, ask=1.1001):
        state = spark.createDataFrame([("EURUSD", seen, entered)], loop.STATE)
        positions = spark.createDataFrame([("EURUSD", str(i), 1, ago) for i in range(held)], loop.POSITIONS) if held else none
        return loop.accepted(signals, state, positions, quotes(spark, ask=ask)(), clock, cfg).count()

    assert n() == 1 and n(held=1) == 1 and n(held=2) == 0
    assert n(seen=ago) == 0 and n(entered=now - timedelta(minutes=29)) == 0 and n(entered=now - timedelta(minutes=30)) == 1
    assert n(ask=1.1002) == 0
    p = spark.createDataFrame([([0.55, 0.2, 0.25],), ([0.56, 0.2, 0.24],), ([0.1, 0.3, 0.6],), ([0.1, 0.8, 0.1],), (None,)], "p array<double>")
    assert [r[0] for r in p.select(trading.live_signal(F.col("p"))).collect()] == [0, -1, 1, 0, 0]
    old = spark.createDataFrame([("EURUSD", "a", 1, now - timedelta(minutes=120)), ("EURUSD", "b", 1, now - timedelta(minutes=121))], loop.POSITIONS)
    assert {r["order_id"]: r["expired"] for r in loop.expired(old, now).collect()} == {"a": False, "b": True}


def test_keep_running():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("lost")

    class Working(Query):
        lastProgress = {"batchId": 1}

    often = [Working(True) for _ in range(5)] + [Query(False)]
    assert loop.keep_running(lambda: often.pop(0), 2) == 5  # each had ended a batch
    left = [True, True, False]
    assert loop.keep_running(lambda: Query(left.pop(0))) == 2
    with pytest.raises(RuntimeError):
        loop.keep_running(lambda: Query(True), 2)


def test_gated_signals(spark, tmp_path):
    """Places come free after the holding limit; no end of a trade is needed."""
    rows = [("EURUSD", BEGIN + timedelta(minutes=30 * i), 1) for i in range(8)]
    schema = "symbol string, time timestamp, signal int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = live.gated_signals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["time"] - BEGIN).seconds // 60 for r in spark.table("gated").collect()) == [30, 60, 90, 180, 210]


def test_sources_and_guards(spark, tmp_path):
    text = "time,open,high,low,close,tick_volume,spread,real_volume\n" + "".join(f"2024-01-0{d} 00:00:00,1.1,1.2,1.0,1.1,{v},9,0\n" for d, v in ((1, 9), (2, 1), (3, 9)))
    (tmp_path / "a.csv").write_text(text)
    assert candles.load_bars(spark, f"{tmp_path}/a.csv").count() == 2
    with pytest.warns(UserWarning, match="90 days"):
        a, _ = candles.load_dual(spark, f"{tmp_path}/a.csv", f"{tmp_path}/a.csv")
    with pytest.raises(ValueError, match="fewer than 500 bars: EURUSD 2"):
        pipeline.require_bars(a)
    assert pipeline.require_bars(a, 2) is a
    paged = candles.PagedHistory(lambda offset, size: [(1000 - i, 1.0, 1.0, 1.0, 1.0, 1, 1) for i in range(offset, offset + size)], 4).load(spark, 10)
    assert paged.count() == 10 and "real_volume" not in a.columns
