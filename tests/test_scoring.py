"""The live loop with both timeframes, the whole feature pipeline and a model that was read again."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_live import quotes
from volclock.config import Cleaning, Features, Labels, Training
from volclock.operators import labels, training
from volclock.operators.training import Trained, Trees
from volclock.plans import pipeline
from volclock.plans.pipeline import build_features
from volclock.sources import models
from volclock.streaming import live, loop, scoring

CFG = Features(rolling_window=40, vol_fast=12, vol_slow=60, micro=24, vpin=24)
WINDOWS = (48, 24)
BARRIERS = Labels(vol_lookback=48, vol_fast=12, vol_slow=60)
NAMES = ["rsi", "returns_1_h1", "frac_diff_close"]


@pytest.fixture(scope="module")
def fast(spark):
    i = F.col("id")
    close = F.round(1.1 + F.sin(i / 40.0) / 100 + F.cos(i * 1.7) / 1000 + F.pmod(i * 37, F.lit(11)) / 20_000.0, 5)
    wide = F.pmod(i * 13, F.lit(7)) / 10_000.0 + 0.0002
    df = spark.range(1400).select(F.lit("EURUSD").alias("symbol"), F.timestamp_seconds(F.lit(1_704_067_200) + i * 300).alias("time"), F.lag(close, 1, 1.1).over(live.Window.orderBy("id")).alias("open"), close.alias("close"), wide.alias("_w"), (F.pmod(i * 29, F.lit(50)) + 60).alias("tick_volume"), (F.pmod(i, F.lit(4)) + 1).alias("spread"))
    return df.select("symbol", "time", "open", (F.greatest("open", "close") + F.col("_w")).alias("high"), (F.least("open", "close") - F.col("_w")).alias("low"), "close", "tick_volume", "spread").cache()


def test_loop_with_everything(spark, fast, tmp_path):
    closed = live.closed(fast)
    wanted = build_features(closed, scoring.slow_candles(fast), CFG, 0.9, False, WINDOWS).cache()
    assert wanted.count() > 100
    rows = wanted.select("symbol", "time", *NAMES).withColumns({"class": F.pmod(F.hour("time"), F.lit(3)).cast("double"), "weight": F.lit(1.0)})
    empty = spark.createDataFrame([], "feature string")
    model = training.fitted(rows, NAMES, Trees(n_trees=3, max_depth=3, min_rows=1, subsample=1.0, columns=1.0))
    models.export_model(spark, Trained(model, NAMES, empty, empty, empty, Trees()), f"file://{tmp_path}/model", {"frac_d": 0.9})
    saved = models.load_model(spark, f"file://{tmp_path}/model")

    scorer = scoring.Scorer(saved, lambda: scoring.slow_candles(fast), CFG, BARRIERS, Cleaning(), False, WINDOWS)
    got = scorer(closed).cache()
    batch = training.predict(model, wanted.select("symbol", "time", *NAMES)).select("symbol", "time", "probabilities")
    assert sorted(map(repr, got.drop("width").collect())) == sorted(map(repr, batch.collect()))

    # widths come from the closes at the bars that have features
    closes = [r["close"] for r in labels.closes_of(closed, wanted).orderBy("time").collect()]
    widths = [r["width"] for r in got.orderBy("time").collect()]
    assert widths[:29] == [None] * 29 and None not in widths[29:]
    changes = [b / a - 1 for a, b in zip(closes[-49:], closes[-48:], strict=False)]
    mean = sum(changes) / 48
    vol = math.sqrt(sum((c - mean) ** 2 for c in changes) / 47) * closes[-1] * math.sqrt(48)
    assert 0.5 * vol - 1e-12 <= widths[-1] <= 2 * vol + 1e-12

    broker = live.SimulatedBroker()
    whole = loop.LiveLoop(loop.Versions(spark, f"{tmp_path}/tables"), scorer, quotes(spark), broker, Training(confidence=0.0, cooldown_minutes=0))
    before = fast.filter(F.col("time") < F.timestamp_seconds(F.lit(1_704_067_200 + 1398 * 300)))
    whole(before, 0)
    assert broker.orders == {}
    whole(fast.join(before, ["symbol", "time"], "left_anti").select(fast.columns), 1)
    last = max(got.collect(), key=lambda r: r["time"])
    side = last["probabilities"].index(max(last["probabilities"])) - 1
    assert [o["side"] for o in broker.orders.values()] == ([side] if side else [])


def test_missing_feature(spark, fast):
    scorer = scoring.Scorer(models.Saved(None, ["rsi", "nowhere"], {"frac_d": 0.9}), lambda: scoring.slow_candles(fast), CFG, BARRIERS, Cleaning(), False, WINDOWS)
    with pytest.raises(ValueError, match="nowhere"):
        scorer(fast)


def test_too_few_bars(spark, fast):
    scorer = scoring.Scorer(models.Saved(None, ["rsi"], {"frac_d": 0.9}), lambda: scoring.slow_candles(fast), CFG, BARRIERS, Cleaning(), False, WINDOWS, least_bars=pipeline.LEAST_BARS)
    with pytest.raises(ValueError, match="fewer than 500 bars: EURUSD 499"):
        scorer(fast.orderBy("time").limit(499))


def test_slow_candles(spark, fast):
    first, *rest = scoring.slow_candles(fast).orderBy("time").collect()
    twelve = fast.orderBy("time").limit(12).collect()
    assert first["time"] == datetime(2024, 1, 1) or first["time"].minute == 0
    assert (first["open"], first["close"], first["high"]) == (twelve[0]["open"], twelve[-1]["close"], max(r["high"] for r in twelve))
    assert first["tick_volume"] == sum(r["tick_volume"] for r in twelve) and len(rest) == math.ceil(1400 / 12) - 1


def test_backfill(spark, fast):
    asked = []

    def load(count):
        asked.append(count)
        if count == 25_000:
            raise OSError("too many at once")
        return (fast.limit(0) if count == 10_000 else fast.limit(3)), fast.limit(2)

    got, slow = scoring.backfill(load)
    assert asked == [25_000, 10_000, 5_000] and got.count() == 3 and slow.count() == 2
    with pytest.raises(ValueError):
        scoring.backfill(load, (10_000,))
