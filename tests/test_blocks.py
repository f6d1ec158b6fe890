"""Whatever the size of blocks, results are the same: one row, seven, or a whole symbol in each."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_bars import plain as plain_bars
from volclock.config import Features, Labels, Training
from volclock.functions import blocks, means
from volclock.operators import asof, bars, features, fracdiff, labels, trading

BEGIN = datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp, open double, high double, low double, close double, tick_volume long, spread long"
CFG = Features(rolling_window=40, vol_fast=5, vol_slow=60, micro=30, vpin=25, horizons=(1, 3), h1_horizons=(1, 4))


def rows():
    rng, out = random.Random(7), []
    for symbol in ("a", "b", None):
        x, at = 1.1, BEGIN
        for i in range(150 if symbol else 30):
            before, x = x, x * (1 + rng.gauss(0, 0.001)) if i % 9 else x
            at += timedelta(minutes=5 if i % 40 else 5000)
            out.append((symbol, at, before, max(before, x) * 1.0002, min(before, x) * 0.9998, x, rng.randint(0, 90), rng.randint(1, 9)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def candles(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def compared(run, monkeypatch, sizes=(7, 1)):
    """``run`` with blocks of each size against whole symbols in one block."""

    def got(size, seconds):
        monkeypatch.setattr(blocks, "ROWS", size)
        monkeypatch.setattr(means, "ROWS", size)
        monkeypatch.setattr(blocks, "BUCKET", seconds)
        return {(r["symbol"], r["time"]): r.asDict() for r in run().collect()}

    whole = got(1 << 40, 1 << 40)
    assert whole
    for size in sizes:
        other = got(size, 1000 * size)
        assert other.keys() == whole.keys()
        for key, row in whole.items():
            assert row.keys() == other[key].keys() and "_pos" not in row
            for c, v in row.items():
                assert other[key][c] == v or other[key][c] == pytest.approx(v, rel=1e-9, abs=1e-9), (size, key, c)
    return whole


CHAINS = {
    "exponential": features.exponential,
    "microstructure": lambda df: features.microstructure(df, CFG),
    "momentum and run lengths": lambda df: features.momentum(features.consecutive(df)),
    "sessions": lambda df: features.sessions(df, CFG, 30, 20),
    "hurst and regime": lambda df: features.hurst(features.vol_regime(df, 5, 3, 60, 20), 12, 5),
    "bands": lambda df: features.normalised(features.volatility(features.returns(features.bollinger(df), (1, 3)), 20), ["returns_1", "bb_width_pct"], 40),
    "differencing": lambda df: fracdiff.frac_diff(df, 0.9, threshold=1e-3),
    "volatility of labels": lambda df: labels.barrier_multiplier(labels.daily_volatility(df, 30), 5, 60),
}


def test_orders_in_blocks(candles, monkeypatch):
    def run():
        tests = fracdiff.adf_tests(candles, [0.0, 0.4, 1.0], threshold=1e-2)
        return tests.withColumnRenamed("d", "time").orderBy("symbol", "time")

    compared(run, monkeypatch)


@pytest.mark.parametrize("name", CHAINS)
def test_any_size(candles, monkeypatch, name):
    compared(lambda: CHAINS[name](candles), monkeypatch)


def test_means_as_in_pandas(spark, monkeypatch):
    rng = random.Random(1)
    values = [("a", BEGIN + timedelta(minutes=i), None if i < 2 or i in (17, 18, 40) else rng.gauss(5, 2)) for i in range(60)] + [("b", BEGIN, None), ("c", BEGIN, 3.0)]
    df = spark.createDataFrame(values, "symbol string, time timestamp, x double")
    for alpha in (0.05, 0.5, 0.97):
        found = compared(lambda alpha=alpha: means.with_means(blocks.with_halo(df, 0, means.block_rows([alpha])), [("y", "x", alpha, 3)]).drop("_pos", "_block"), monkeypatch)
        expected = pd.Series([v[2] for v in values[:60]]).ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=3).mean()
        for (symbol, time, _), y in zip(values, expected, strict=False):
            assert found[symbol, time]["y"] == pytest.approx(y) if y == y else found[symbol, time]["y"] is None
        assert found["b", BEGIN]["y"] is None and found["c", BEGIN]["y"] is None


def test_runs_of_direction(candles, monkeypatch):
    found = compared(lambda: features.consecutive(candles), monkeypatch, ())
    for symbol in ("a", "b", None):
        run, before, last = 0.0, None, None
        for _, _, _, _, _, close, *_ in sorted((r for r in rows() if r[0] == symbol), key=lambda r: r[1]):
            sign = 0.0 if before is None or close == before else 1.0 if close > before else -1.0
            run = run + sign if sign == last else sign
            before, last = close, sign
        assert found[symbol, max(r[1] for r in rows() if r[0] == symbol)]["consecutive_direction"] == run


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 40])
@pytest.mark.parametrize("most", [3, 60])
def test_bars(spark, size, most):
    rng = random.Random(most)
    made = [(rng.choice(["a", "b", None]), BEGIN + timedelta(seconds=i), float(i), rng.choice([0, 1, most, None, 130])) for i in range(1500)]
    df = spark.createDataFrame(rng.sample(made, len(made)), "symbol string, time timestamp, price double, tick_volume long")
    df = df.select("symbol", "time", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "tick_volume", F.lit(1).cast("long").alias("spread"))
    out = bars.volume_bars(df, 120, rows=size)
    assert {(r["symbol"], r["bar_id"]): (r["bar_count"], r["tick_volume"], r["open"], r["close"]) for r in out.collect()} == plain_bars(made, 120)


def test_block_of_any_open_bar():
    """A block's summary gives what going through its rows gives, whatever it begins with."""
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 400):
        volume = rng.integers(0, 20, n)
        sums, following, left, total = bars.block_summary(volume, 50)
        for held in range(50):
            _, _, open_, number = bars._bar_numbers(volume, 50, held, 0)
            at = int(np.searchsorted(sums, 50 - held, "left"))
            assert (open_, number) == ((left[at], 1 + following[at]) if at < len(sums) else (held + total, 0))


@pytest.mark.parametrize("seconds", [60, 3600, 1 << 40])
def test_asof(spark, seconds):
    rng = random.Random(5)
    fast = [(s, BEGIN + timedelta(minutes=rng.randrange(3000)), i) for i, s in enumerate(["a", "b", None, "c"] * 60)]
    slow = [(s, BEGIN + timedelta(minutes=m), x, None if m % 3 else x) for s in ("a", "b", None, "d") for m, x in {rng.randrange(2500): rng.random() for _ in range(25)}.items()]
    joined = asof.asof(spark.createDataFrame(fast, "symbol string, time timestamp, i int"), spark.createDataFrame(slow, "symbol string, time timestamp, x double, y double"), ["x", "y"], seconds)
    newest = lambda s, t: max(((m, x, y) for k, m, x, y in slow if k == s and m <= t), default=(None, None, None))[1:]
    assert sorted((r["i"], r["x"], r["y"]) for r in joined.collect()) == sorted((i, *newest(s, t)) for s, t, i in fast)


@pytest.mark.parametrize("gap", [0, 600])
@pytest.mark.parametrize("size", [1, 7, 1 << 40])
def test_simulation_in_segments(spark, gap, size):
    """With gaps a symbol is several segments, without them it is one; trades are the same."""
    rng, made = random.Random(gap), []
    for symbol in ("a", "b"):
        at = BEGIN
        for i in range(120):
            at += timedelta(minutes=5 + (gap if i % 20 == 0 else 0))
            n = rng.choice([None, 1, 6, 24])
            made.append((symbol, at, rng.choice([-1, 0, 1, 1]), None if n is None or n == 6 else at + timedelta(minutes=5 * n), n))
    cfg = Training(max_open_trades=2, cooldown_minutes=15)
    df = spark.createDataFrame(made, "symbol string, time timestamp, predicted int, t1 timestamp, holding_period int")
    taken = set()
    for symbol in ("a", "b"):
        held, last = [], None
        for _, now, signal, t1, n in [r for r in made if r[0] == symbol]:
            held = [x for x in held if x > now]
            if signal and len(held) < 2 and (last is None or now - last >= timedelta(minutes=15)):
                last = now
                held.append(t1 or now + timedelta(minutes=5 * (n or 0)))
                taken.add((symbol, now))
    done = trading.simulated(df, cfg, size)
    assert done.columns == [*df.columns, "traded"]
    assert {(r["symbol"], r["time"]) for r in done.filter("traded").collect()} == taken
    pieces = trading.segments(df, cfg, size).select("symbol", "_segment").distinct().count()
    assert pieces > 8 if gap and size < 20 else pieces == 2 if size > 1000 else pieces >= 2
