"""What must hold for any candles: no look-ahead, scales, whole differences, weights."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.compare import same
from volclock.operators import features, fracdiff, labels, weights
from volclock.config import Labels
from volclock.plans import oracles, queries

BEGIN = datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp, open double, high double, low double, close double, tick_volume long, spread long"


@pytest.fixture(scope="module")
def walk(spark):
    rng, out, x = random.Random(7), [], 1.1
    for i in range(260):
        before, x = x, x * (1 + rng.gauss(0, 0.001))
        out.append(("EURUSD", BEGIN + timedelta(minutes=5 * i), before, max(before, x) * 1.0002, min(before, x) * 0.9998, x, rng.randint(5, 90), rng.randint(1, 9)))
    out.append(("ONE", BEGIN, 1.0, 1.0, 1.0, 1.0, 5, 1))  # a symbol of one candle without a range
    return spark.createDataFrame(out, SCHEMA)


def indicators(df):
    df = features.candle_shape(features.returns(features.bollinger(features.exponential(df)), (1, 12)))
    return {(r["symbol"], r["time"]): r.asDict() for r in df.collect()}


def test_no_look_ahead(walk):
    whole, part = indicators(walk), indicators(walk.filter(F.col("time") < BEGIN + timedelta(minutes=5 * 180)))
    assert len(part) == 181 and all(whole[k] == v for k, v in part.items())


def test_scale(walk):
    prices = {c: F.col(c) * 100 for c in ("open", "high", "low", "close")}
    one, hundred = indicators(walk), indicators(walk.withColumns(prices))
    for k, r in one.items():
        for c in ("rsi", "macd_pct", "atr_pct", "bb_position", "bb_width_pct", "returns_1", "body_ratio"):
            assert r[c] == hundred[k][c] or r[c] == pytest.approx(hundred[k][c], rel=1e-6, abs=1e-9)
    assert one["ONE", BEGIN]["rsi"] is None and one["ONE", BEGIN]["bb_position"] == 0.5


def test_directions_at_odd_closes(spark, tmp_path):
    """A close of 0, or a negative one, in either timeframe has the directions that the SQL gives it."""
    rng, odd = random.Random(3), {31, 32, 59, 120, 121, 122, 123, 300}
    made = [(i, BEGIN + timedelta(minutes=15 * i, seconds=7), rng.choice(["a", "b"]), rng.choice([0.0, -3.5]) if i in odd else 100 + rng.gauss(0, 9), '{"k": 4}') for i in range(400)]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, event_type string, value double, props string")
    df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    same(queries.QUERIES["cross_tf"](spark, str(tmp_path)), oracles.ORACLE_SQL["cross_tf"], str(tmp_path))


def test_whole_orders(walk):
    assert fracdiff.weights(1.0)[:2] == [1.0, -1.0] and fracdiff.weights(0.0)[0] == 1.0
    rows = fracdiff.frac_diff(walk.filter("symbol = 'EURUSD'"), 1.0).orderBy("time").collect()
    assert all(b["frac_diff_close"] == pytest.approx(b["close"] - a["close"], abs=1e-12) for a, b in zip(rows, rows[1:]))


def test_p_values(spark):
    """Against the error function; the fixed points are MacKinnon's critical values of 1, 5 and 10 %."""
    ts = [-30.0, -18.8, -7.3, -3.43, -2.86, -2.57, -1.61, -1.6, 0.0, 1.3, 2.74, 2.75, None]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in ts], "t double").select(fracdiff.p_value(F.col("t")).alias("p")).collect()]
    assert got[-1] is None and got[0] == 0.0 and got[-2] == 1.0
    for t, p in list(zip(ts, got))[1:-2]:
        z = 2.1659 + 1.4412 * t + 0.038269 * t**2 if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t**2 - 0.010368 * t**3
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-13)
    assert [round(p, 2) for p in got[3:6]] == [0.01, 0.05, 0.1]


def test_all_orders_at_once(spark, walk):
    """Each order against its own differencing and regression; rows without a value don't count."""
    holes = [("EURUSD", BEGIN + timedelta(seconds=7), None), ("EURUSD", BEGIN + timedelta(seconds=9), float("nan")), ("NONE", BEGIN, None)]
    df = walk.select("symbol", "time", "close").unionByName(spark.createDataFrame(holes, "symbol string, time timestamp, close double"))
    orders, least = [0.0, 0.3, 0.6, 1.0], 30
    got = {r["d"]: r for r in fracdiff.adf_summary(df, orders, threshold=1e-2, least=least).collect()}
    assert list(sorted(got)) == orders and {r["symbol"] for r in got.values()} == {"EURUSD"}
    for d in orders:
        one = fracdiff.frac_diff(walk.select("symbol", "time", "close"), d, "close", "z", 1e-2) if d else walk.withColumn("z", F.col("close"))
        wanted = fracdiff.with_adf(fracdiff.adf_sums(one, "z")).filter("symbol = 'EURUSD'").first()
        assert got[d]["n"] == wanted["n"] and got[d]["adf_stat"] == pytest.approx(wanted["adf_stat"], rel=1e-6)
        assert got[d]["corr"] == pytest.approx(one.filter("symbol = 'EURUSD' and z is not null").agg(F.corr("close", "z")).first()[0], rel=1e-9)
    found = fracdiff.find_min_d(df, step=0.5, threshold=1e-2, least=least)
    assert {r["symbol"]: r["d"] is None for r in found.collect()} == {"EURUSD": False, "ONE": True}
    with pytest.raises(ValueError, match="ONE"):
        fracdiff.require_min_d(found)
    plan = fracdiff.adf_summary(df, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_weights_sum_to_their_number(walk):
    spans = labels.triple_barrier(walk.select("symbol", "time", "close"), Labels(vol_lookback=48, vol_fast=12, vol_slow=96), 0.0001).dropna(subset=["label"])
    one = weights.sample_weights(spans.select("symbol", "time", "t1")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("weight").alias("least")).first()
    assert one["n"] > 100 and one["w"] == pytest.approx(one["n"]) and one["least"] > 0
    assert spans.filter("t1 <= time or holding_period < 6 or holding_period > 24").isEmpty()
