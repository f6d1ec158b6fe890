"""Training, search and export on made-up features that tell the label."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from volclock.config import Costs, Labels, Training
from volclock.operators import training
from volclock.operators.training import Trees
from volclock.plans.pipeline import aligned
from volclock.sources import models

NAMES = ["tells", "noise"]
CFG = Training(n_splits=2, max_hold=4, confidence=0.4, max_open_trades=100, cooldown_minutes=0)
SMALL_TREES = Trees(n_trees=5, max_depth=3, min_rows=1, subsample=1.0, columns=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    k = F.pmod(F.col("id") * 7 + F.floor(F.col("id") / 5), F.lit(3)).cast("int")
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 300)
    df = spark.range(600).select(
        F.lit("A").alias("symbol"), time.alias("time"), (k - 1).alias("label"), F.timestamp_seconds(F.unix_seconds(time) + 600).alias("t1"),
        ((k - 1) * 5.0).alias("ret_pips"), F.lit(2).alias("holding_period"), (k + F.pmod("id", F.lit(4)) / 8.0).alias("tells"), F.pmod(F.col("id") * 13, F.lit(17)).cast("double").alias("noise"),
    )
    features, labels = df.select("symbol", "time", *NAMES), df.drop(*NAMES)
    return training.aligned_rows(features, labels, None, NAMES).cache()


@pytest.mark.parametrize("boosted", [False, True])
def test_train_and_export(spark, rows, tmp_path, boosted):
    done = training.train(rows, NAMES, replace(SMALL_TREES, boosted=boosted, learning_rate=0.3), CFG)
    assert done.average["accuracy"] > 0.95
    assert done.average["win_rate"] > 0.95
    assert {r["fold"] for r in done.fold_metrics.select("fold").distinct().collect()} == {0, 1}
    assert training.ranked(done.importances).first()["feature"] == "tells"
    assert "accuracy" in done.summary()
    p = training.predict(done.model, rows).select("probabilities", "class_predicted").collect()
    assert all(abs(sum(r[0]) - 1) < 1e-9 and len(r[0]) == 3 and r[0][r[1]] == max(r[0]) for r in p)

    paths = models.export_model(spark, done, f"file://{tmp_path}", {"frac_d": 0.4, "list": [1]}, "m")
    saved = models.load_model(spark, f"file://{tmp_path}", "m")
    assert saved.features == NAMES and saved.frac_d == 0.4 and "list" not in saved.metadata
    again = training.predict(saved.model, aligned(rows, saved.features)).orderBy("time").select("class_predicted").collect()
    assert again == training.predict(done.model, rows).orderBy("time").select("class_predicted").collect()
    assert spark.read.option("header", True).csv(paths["importances"]).first()["feature"] == "tells"


def test_missing_class_and_weights(spark, rows):
    two = rows.filter("label < 1")
    p = training.predict(training.fitted(two, NAMES, SMALL_TREES), rows).select("probabilities").collect()
    assert all(len(r[0]) == 3 and r[0][2] == 0 for r in p)
    weights = rows.limit(1).select("symbol", "time", F.lit(3.0).alias("weight"))
    joined = training.aligned_rows(rows.select("symbol", "time", *NAMES), rows.select("symbol", "time", "label"), weights, NAMES)
    assert {r["weight"] for r in joined.select("weight").distinct().collect()} == {1.0, 3.0}
    with pytest.raises(ValueError):
        training.train(rows.limit(2), NAMES, SMALL_TREES, CFG)


def few(rng: random.Random, base: Trees) -> Trees:
    return replace(base, max_depth=rng.randint(1, 3))


def test_search(spark, rows):
    done = training.tune(rows, NAMES, n_trials=2, base=SMALL_TREES, cfg=CFG, sample=few)
    assert done.average["expected_return_pips"] > 4


def test_joint_search(spark, rows):
    prices = rows.select("symbol", "time", (F.lit(1.1) + F.sin(F.unix_seconds("time") / 3000.0) / 100).alias("close"))
    features = prices.join(rows.select("symbol", "time", *NAMES), ["symbol", "time"]).drop("close")
    done = training.tune_jointly(features, prices, NAMES, n_trials=1, base=SMALL_TREES, barriers=Labels(), cfg=replace(CFG, max_hold=48), costs=Costs(), least=1, sample=few)
    assert done.barriers.max_hold in (24, 36, 48) and done.barriers.min_hold in (6, 12, 18)
    assert done.average["n"] > 0


def test_score():
    good = {"n_trades": 200, "sharpe_ratio": 2.0, "total_pnl_after_costs_pips": 10.0, "profit_factor": 1.5, "win_rate": 0.6}
    assert training.score(good) == 2.0
    assert training.score(good | {"n_trades": 99}) == training.REJECTED
    assert training.score(good | {"total_pnl_after_costs_pips": 0.0}) == -8.0
    assert training.score(good | {"win_rate": 0.4}) == -3.0


def test_drawn_settings():
    rng = random.Random(1)
    for _ in range(50):
        t, b = training.sampled_trees(rng, Trees()), training.sampled_barriers(rng, Labels())
        assert 100 <= t.n_trees <= 1000 and 0.01 <= t.learning_rate <= 0.2 and 3 <= t.max_depth <= 10
        assert 0.1 <= b.pt <= 1.5 and b.vol_lookback % 24 == 0 and b.min_hold < b.max_hold
