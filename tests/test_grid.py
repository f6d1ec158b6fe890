"""Labels of many settings from one forward pass, and importances by exchanged values."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from volclock.config import Labels, Training
from volclock.functions import blocks
from volclock.operators import importance, labels, training
from volclock.operators.training import Trees

SETTINGS = [
    Labels(pt, sl, max_hold=longest, min_hold=least, vol_lookback=n, vol_fast=12, vol_slow=60, dynamic=dynamic)
    for pt, sl, least, longest, n, dynamic in [(0.7, 0.4, 3, 12, 24, True), (0.1, 0.1, 3, 6, 36, True), (0.3, 1.5, 6, 18, 24, False), (1.5, 0.2, 1, 12, 36, True)]
]


def walk(spark, n=400, seed=3):
    rng, close, rows = random.Random(seed), 1.1, []
    for i in range(n):
        close = round(close + rng.choice([-2, -1, 0, 0, 1, 2]) / 5000, 5)  # steps of one size: ties
        rows += [("A", i, close), ("B", i, None if i % 97 == 5 else float("nan") if i % 89 == 7 else close)]
    rows.append(("C", 0, 1.0))
    return spark.createDataFrame(rows, "symbol string, i int, close double").select("symbol", F.timestamp_seconds(F.col("i") * 300).alias("time"), "close")


def sorted_rows(df):
    return sorted(map(repr, df.select("symbol", "time", "label", "t1", "ret", "barrier_type", "holding_period").collect()))


def first_touch(closes, widths, cfg, i):
    """label and holding period by walking on from row i."""
    if i + cfg.max_hold >= len(closes) or not widths[i]:
        return None
    for j in range(cfg.min_hold, cfg.max_hold + 1):
        if closes[i + j] >= closes[i] + cfg.pt * widths[i]:
            return 1, j
        if closes[i + j] <= closes[i] - cfg.sl * widths[i]:
            return -1, j
    moved = closes[i + cfg.max_hold] - closes[i]
    return 0 if abs(moved / 0.0001) < cfg.min_return_pips else 1 if moved > 0 else -1, cfg.max_hold


@pytest.mark.parametrize("size", [7, 20_000])
def test_grid_is_labelling_anew(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "ROWS", size)
    df = walk(spark)
    paths = labels.forward_paths(df, SETTINGS).cache()
    grid = labels.grid_labels(paths, SETTINGS).cache()
    assert grid.count() == 4 * df.count()
    for i, cfg in enumerate(SETTINGS):
        wanted = sorted_rows(labels.triple_barrier(df, cfg))
        assert sorted_rows(grid.filter(F.col("setting") == i)) == sorted_rows(labels.labels_of(paths, cfg)) == wanted


def test_against_walking_on(spark):
    df = walk(spark).filter("symbol = 'A'")
    for cfg in SETTINGS[:3]:
        found = labels.barrier_multiplier(labels.daily_volatility(df, cfg.vol_lookback), 12, 60).orderBy("time").collect()
        closes, widths = [r["close"] for r in found], [r["daily_vol"] and r["daily_vol"] * (r["barrier_mult"] if cfg.dynamic else 1) for r in found]
        got = labels.labels_of(labels.forward_paths(df, SETTINGS), cfg).orderBy("time").collect()
        assert [r["label"] is not None and (r["label"], r["holding_period"]) or None for r in got] == [first_touch(closes, widths, cfg, i) for i in range(len(closes))]


def test_empty_and_other_columns(spark):
    df = walk(spark).withColumns({"daily_vol": F.lit(1), "_up": F.lit("x"), "label_": F.lit(2)})
    out = labels.grid_labels(labels.forward_paths(df, SETTINGS[:1]), SETTINGS[:1])
    assert {(r["daily_vol"], r["_up"]) for r in out.select("daily_vol", "_up").distinct().collect()} == {(1, "x")}
    assert labels.grid_labels(labels.forward_paths(df.limit(0), SETTINGS), SETTINGS).count() == 0


def made_up(spark):
    k = F.pmod(F.col("id") * 7 + F.floor(F.col("id") / 5), F.lit(3)).cast("int")
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 300)
    noise = F.pmod(F.xxhash64("id"), F.lit(97)).cast("double")
    rows = spark.range(900).select(F.lit("A").alias("symbol"), time.alias("time"), F.timestamp_seconds(F.unix_seconds(time) + 600).alias("t1"), (k + F.pmod("id", F.lit(4)) / 8.0).alias("tells"), noise.alias("noise"), k.cast("double").alias("class"))
    return rows.withColumns({"weight": F.lit(1.0), "still": F.lit(1.0)})


def test_values_only_move(spark):
    rows = made_up(spark).withColumn("fold", F.when(F.col("time") < "2024-01-02", 0).when(F.col("time") < "2024-01-04 02:55:00", 1).otherwise(2))
    names = ["tells", "noise"]
    out = importance.permuted(rows, names).collect()
    sizes = Counter(r["fold"] for r in out if r["permuted"] is None)
    assert sizes[2] == 1 and sum(sizes.values()) == 900 and len(out) == 2700  # a fold of one row keeps its values
    own = {r["time"]: r for r in out if r["permuted"] is None}
    for f, other in (names, names[::-1]):
        moved = [r for r in out if r["permuted"] == f]
        assert Counter((r["fold"], r[f]) for r in moved) == Counter((r["fold"], r[f]) for r in own.values())
        assert all(r[other] == own[r["time"]][other] and r["class"] == own[r["time"]]["class"] for r in moved)
        assert sum(r[f] != own[r["time"]][f] for r in moved) > 500
    again = importance.permuted(rows.repartition(5), names).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert sorted(map(repr, importance.permuted(rows, names, seed=1).collect())) != sorted(map(repr, out))


def test_telling_feature_ranks_first(spark):
    names = ["noise", "still", "tells"]
    found = importance.permutation_importance(made_up(spark), names, Trees(n_trees=5, max_depth=3, min_rows=1, subsample=1.0, columns=1.0), Training(n_splits=2, max_hold=4))
    each = {(r["fold"], r["feature"]): r["importance"] for r in found.collect()}
    assert len(each) == 6 and all(each[k, "tells"] > 0.4 and each[k, "still"] == 0 and abs(each[k, "noise"]) < 0.1 for k in (0, 1))
    assert training.ranked(found).first()["feature"] == "tells"


def test_no_fold(spark):
    with pytest.raises(ValueError):
        importance.permutation_importance(made_up(spark).limit(2), ["noise"])


def test_search_takes_the_first_best():
    scores = {"a": 1.0, "b": 3.0, "c": 3.0, "d": None}

    def run(trial):
        if scores[trial] is None:
            raise ValueError("a trial that fails")
        return scores[trial]

    for parallel in (1, 3):
        assert training._search(list("abcd"), run, 100, parallel) == "b"
    assert training._search(list("ab"), run, -1) == "a"
    rng = random.Random(2)
    for _ in range(50):
        t = training.joint_trees(rng, Trees())
        assert t.n_trees % 100 == 0 and t.n_trees <= 800 and 0.01 <= t.learning_rate <= 0.1 and 3 <= t.max_depth <= 6 and 50 <= t.min_rows <= 300
