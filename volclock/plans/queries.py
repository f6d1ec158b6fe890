"""The registered queries: operators applied to candles of the events table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volclock.config import Cleaning, Costs, Features, Labels, Training
from volclock.functions import blocks
from volclock.functions.windows import zscore
from volclock.operators import asof, bars, features, folds, fracdiff, importance, labels, trading, training, weights
from volclock.sources import candles
from volclock.sources.stored import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Short windows, as a month of hourly candles has 720 rows for each symbol.
SHORT = Features(rolling_window=100, vol_fast=12, vol_slow=96, micro=48, vpin=24)
BARRIERS = Labels(vol_lookback=48, vol_fast=12, vol_slow=96, min_return_pips=3.0)
PIP = 0.01
COSTS = Costs(pip_value=PIP)


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, for sums that engines add up in different orders."""
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.event_candles(events(spark, sf_dir))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.event_ticks(events(spark, sf_dir))


def only(df: DataFrame, *names: str) -> DataFrame:
    return df.select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), *names)


@query
def candles_h1(spark, sf_dir):
    return only(h1(spark, sf_dir), "open", "high", "low", "close", "tick_volume", "spread")


@query
def clean_bars(spark, sf_dir):
    return only(candles.clean(h1(spark, sf_dir), Cleaning(3, 9.0)), "open", "high", "low", "close", "tick_volume", "spread")


@query
def bar_problems(spark, sf_dir):
    return candles.problems(h1(spark, sf_dir))


@query
def source_stats(spark, sf_dir):
    return candles.summary(h1(spark, sf_dir)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})


@query
def gap_report(spark, sf_dir):
    return candles.gaps(h1(spark, sf_dir))


@query
def overlap_report(spark, sf_dir):
    df = h1(spark, sf_dir)
    out = candles.overlap(df.filter("symbol < 'm'"), df.filter("symbol >= 'm'"), 20)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})


@query
def volume_bars(spark, sf_dir):
    return bars.volume_bars(ticks(spark, sf_dir), 1500).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def tick_bars(spark, sf_dir):
    return bars.tick_bars(ticks(spark, sf_dir), 1000).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query
def suggest_threshold(spark, sf_dir):
    return bars.suggested_threshold(ticks(spark, sf_dir), 50)


@query
def log_returns(spark, sf_dir):
    return only(h1(spark, sf_dir).withColumn("log_return_1", features.log_return()), "log_return_1")


@query
def returns_multi(spark, sf_dir):
    return only(features.returns(h1(spark, sf_dir), SHORT.horizons), *[f"returns_{h}" for h in SHORT.horizons])


@query
def rsi(spark, sf_dir):
    return only(features.exponential(h1(spark, sf_dir)), "rsi")


@query
def macd(spark, sf_dir):
    return only(features.exponential(h1(spark, sf_dir)), "macd_pct", "macd_signal_pct", "macd_hist_pct", "ema_cross_pct")


@query
def atr(spark, sf_dir):
    return only(features.exponential(h1(spark, sf_dir)), "atr_pct")


@query
def bollinger(spark, sf_dir):
    return only(features.bollinger(h1(spark, sf_dir)), "bb_position", "bb_width_pct")


@query
def realized_vol(spark, sf_dir):
    return only(features.volatility(h1(spark, sf_dir)), "realized_vol_96")


@query
def rolling_zscore(spark, sf_dir):
    scores = {"volume_zscore": zscore(F.col("tick_volume").cast("double"), 48), "spread_zscore": zscore(F.col("spread").cast("double"), 48)}
    return only(blocks.in_blocks(h1(spark, sf_dir), lambda df: df.withColumns(scores), 48), *scores)


@query
def order_flow(spark, sf_dir):
    return only(features.flow(h1(spark, sf_dir), 48), "volume_ratio", "kyle_lambda", "kyle_lambda_smooth", "amihud", "amihud_smooth")


@query
def vpin(spark, sf_dir):
    return only(features.vpin(h1(spark, sf_dir), 24), "vpin")


@query
def bar_shape(spark, sf_dir):
    return only(features.candle_shape(h1(spark, sf_dir)), "body_ratio", "upper_shadow_ratio", "lower_shadow_ratio")


@query
def cyclical_time(spark, sf_dir):
    return only(features.cyclic_time(h1(spark, sf_dir)), "hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query
def vol_regime(spark, sf_dir):
    return only(features.vol_regime(h1(spark, sf_dir), 12, 10, 96, 50), "vol_regime")


@query
def momentum(spark, sf_dir):
    return only(features.momentum(h1(spark, sf_dir)), "momentum_quality", "return_acceleration", "return_acceleration_smooth")


@query
def consecutive_dir(spark, sf_dir):
    return only(features.consecutive(h1(spark, sf_dir)), "consecutive_direction")


@query
def vol_of_vol(spark, sf_dir):
    return only(features.regime(h1(spark, sf_dir), SHORT), "vol_of_vol")


@query
def sessions(spark, sf_dir):
    return only(features.sessions(h1(spark, sf_dir), SHORT, 48, 20), "session_id", "is_london_ny_overlap", "session_elapsed_pct", "session_range_pct", "session_volume_pct")


@query
def hurst(spark, sf_dir):
    return only(features.hurst(h1(spark, sf_dir)), "hurst_h1")


@query
def frac_diff(spark, sf_dir):
    return only(fracdiff.frac_diff(h1(spark, sf_dir), 0.5), "frac_diff_close")


@query
def adf_stat(spark, sf_dir):
    return fracdiff.with_adf(fracdiff.adf_sums(h1(spark, sf_dir), "close"))


@query
def adf_summary(spark, sf_dir):
    return fracdiff.adf_summary(h1(spark, sf_dir), [0.0, 0.5, 1.0])


@query
def min_d(spark, sf_dir):
    return fracdiff.find_min_d(h1(spark, sf_dir), step=0.25)


@query
def h1_asof(spark, sf_dir):
    m5 = candles.event_candles(events(spark, sf_dir), 5)
    bands = lambda df: features.returns(features.bollinger(df, suffix="_h1"), (1,), "_h1")
    slow = blocks.in_blocks(blocks.positioned(h1(spark, sf_dir)), bands, 20).select("symbol", "time", "_pos", "bb_position_h1", "returns_1_h1")
    names = ["bb_position_h1", "returns_1_h1"]
    return only(asof.asof(m5.select("symbol", "time", "close"), asof.shifted(slow, names), names), "close", *names)


@query
def cross_tf(spark, sf_dir):
    m5 = features.exponential(candles.event_candles(events(spark, sf_dir), 15))
    names = [*features.H1, *features.SIDES]
    joined = asof.asof(m5, asof.shifted(features.h1_features(h1(spark, sf_dir)), names), names)
    return only(features.cross_timeframe(joined), "trend_alignment", "m5_vs_h1_rsi_divergence", "macd_alignment")


@query
def normalise(spark, sf_dir):
    names = ["returns_1", "returns_3", "bb_width_pct", "bb_position"]
    bands = lambda df: features.normalised(features.returns(features.bollinger(df), (1, 3)), names, 100)
    df = blocks.in_blocks(h1(spark, sf_dir), bands, 120)
    return only(df, *names).dropna()


@query
def feature_matrix(spark, sf_dir):
    from volclock.plans.pipeline import build_features

    short = Features(volume_bar_size=60, rolling_window=60, vol_fast=12, vol_slow=60, micro=24, vpin=24)
    return build_features(candles.event_candles(events(spark, sf_dir), 15), h1(spark, sf_dir), short, d=0.9, session_window=(48, 20))


@query
def daily_vol(spark, sf_dir):
    return only(labels.daily_volatility(h1(spark, sf_dir), 48), "daily_vol")


@query
def barrier_multiplier(spark, sf_dir):
    return only(labels.barrier_multiplier(h1(spark, sf_dir), 12, 96), "barrier_mult")


def labelled(spark, sf_dir):
    return labels.triple_barrier(h1(spark, sf_dir).select("symbol", "time", "close"), BARRIERS, PIP)


@query
def triple_barrier(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("t1", F.col("t1").cast("timestamp_ntz"))
    return only(df, "label", "t1", "ret", "ret_pips", "barrier_type", "holding_period")


#: Settings labelled at once: (pt, sl, least and longest holding period, lookback).
GRID = [(0.7, 0.4, 6, 24, 48), (0.3, 0.3, 6, 24, 24), (1.2, 0.5, 12, 36, 48), (0.2, 1.1, 18, 48, 24)]


@query
def barrier_grid(spark, sf_dir):
    settings = [replace(BARRIERS, pt=pt, sl=sl, min_hold=least, max_hold=longest, vol_lookback=n) for pt, sl, least, longest, n in GRID]
    paths = stored(labels.forward_paths(h1(spark, sf_dir).select("symbol", "time", "close"), settings), "paths")
    df = labels.grid_labels(paths, settings, PIP).withColumn("t1", F.col("t1").cast("timestamp_ntz"))
    return only(df, "setting", "label", "t1", "ret_pips", "barrier_type", "holding_period")


@query
def label_dist(spark, sf_dir):
    return labels.distribution(labelled(spark, sf_dir), "label")


@query
def barrier_dist(spark, sf_dir):
    return labels.distribution(labelled(spark, sf_dir), "barrier_type")


def spans(spark, sf_dir):
    return labelled(spark, sf_dir).dropna(subset=["label"]).select("symbol", "time", "t1")


@query
def concurrency(spark, sf_dir):
    return weights.concurrency(spans(spark, sf_dir)).withColumn("t", F.col("t").cast("timestamp_ntz"))


@query
def sample_weights(spark, sf_dir):
    return only(weights.sample_weights(spans(spark, sf_dir)), "weight")


@query
def effective_number(spark, sf_dir):
    return weights.effective_number(weights.sample_weights(spans(spark, sf_dir)))


@query
def cv_folds(spark, sf_dir):
    out = folds.purged_folds(spans(spark, sf_dir))
    return out.groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


@query
def leakage_check(spark, sf_dir):
    return folds.leakage(folds.purged_folds(spans(spark, sf_dir)))


def scored(spark, sf_dir):
    """Labels with a made-up prediction and probabilities, from columns only."""
    k = F.pmod(F.col("holding_period") * 7 + F.hour("time") * 3 + F.dayofmonth("time"), F.lit(10))
    p = F.array((k + 1) / 20.0, F.lit(0.3), F.lit(0.65) - k / 20.0)
    df = labelled(spark, sf_dir).dropna(subset=["label"]).withColumn("probabilities", p)
    return df.withColumn("class", F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1)


@query
def confidence_filter(spark, sf_dir):
    return trading.confidence_report(scored(spark, sf_dir).withColumnRenamed("class", "predicted"), 0.55)


@query
def live_gate(spark, sf_dir):
    signal = trading.live_signal(F.col("probabilities"), 0.5)
    mask = F.pmod(F.hour("time"), F.lit(4)).cast("int")
    return only(scored(spark, sf_dir).withColumns({"signal": signal, "fill": trading.fill_mode(mask)}), "signal", "fill")


@query
def latest_quotes(spark, sf_dir):
    from volclock.streaming.live import latest_quotes, tradable

    q = h1(spark, sf_dir).select("symbol", "time", F.col("low").alias("bid"), (F.col("low") + F.col("spread") / 1000).alias("ask"))
    out = latest_quotes(q).withColumn("tradable", tradable(F.col("bid"), F.col("ask"), F.lit(PIP), 0.35))
    return only(out, "bid", "ask", "tradable")


@query
def null_rows(spark, sf_dir):
    return trading.null_rows(features.returns(h1(spark, sf_dir), (1, 12, 48)), ["returns_1", "returns_12", "returns_48"])


@query
def class_report(spark, sf_dir):
    return trading.class_report(scored(spark, sf_dir).withColumn("predicted", F.col("class") - 1))


@query
def position_size(spark, sf_dir):
    best = F.array_max("probabilities")
    return only(scored(spark, sf_dir).withColumns({"size": trading.position_size(best), "lots": trading.lot_size(best)}), "size", "lots")


@query
def tpsl_prices(spark, sf_dir):
    df = labels.barrier_multiplier(labels.daily_volatility(h1(spark, sf_dir), 48), 12, 96).filter("daily_vol is not null")
    side = F.when(F.pmod(F.hour("time"), F.lit(2)) == 0, 1).otherwise(-1)
    tp, sl = trading.exit_prices(side, F.col("low"), F.col("high"), F.col("daily_vol") * F.col("barrier_mult"), digits=4)
    return only(df.withColumns({"tp": tp, "sl": sl, "pip": trading.pip_size(F.col("symbol"))}), "tp", "sl", "pip")


def traded(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("predicted", F.col("class") - 1)
    return trading.with_pnl(trading.simulated(df.drop("probabilities"), Training(cooldown_minutes=120)))


@query
def trade_sim(spark, sf_dir):
    return only(traded(spark, sf_dir), "predicted", "traded", "pnl")


@query
def trading_metrics(spark, sf_dir):
    return trading.trading_metrics(traded(spark, sf_dir), COSTS)


@query
def daily_sharpe(spark, sf_dir):
    return trading.daily_sharpe(traded(spark, sf_dir), COSTS)


@query
def drawdown(spark, sf_dir):
    return trading.drawdown(traded(spark, sf_dir))


@query
def classification_metrics(spark, sf_dir):
    return trading.classification_metrics(scored(spark, sf_dir).withColumn("predicted", F.col("class") - 1))


@query
def dedupe_latest(spark, sf_dir):
    """The newest version of each (symbol, hour) of the event stream."""
    from volclock.streaming.live import latest_versions

    t = events(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("time"), "event_id", "value")
    return only(latest_versions(t, "event_id"), "event_id", "value")


@query
def keep_last_n(spark, sf_dir):
    from volclock.streaming.live import newest

    return only(newest(h1(spark, sf_dir), 50), "close")


@query
def drop_open_candle(spark, sf_dir):
    from volclock.streaming.live import closed

    return only(closed(h1(spark, sf_dir)), "close")


@query
def fold_metrics(spark, sf_dir):
    f = folds.purged_folds(scored(spark, sf_dir).withColumn("predicted", F.col("class") - 1)).filter("role = 'test'")
    long = f.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg("ret_pips").alias("mean_ret"))
    return trading.averaged(long.unpivot("fold", ["accuracy", "mean_ret"], "metric", "value"))


@query
def feature_importance_topk(spark, sf_dir):
    """Features ranked by their absolute correlation with the label, as importances are."""
    df = features.candle_shape(features.returns(labelled(spark, sf_dir).join(h1(spark, sf_dir).drop("close"), ["symbol", "time"]), (1, 3))).dropna(subset=["label"])
    names = ["body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "returns_1", "returns_3"]
    one = df.agg(*[F.abs(F.corr("label", n)).alias(n) for n in names])
    return one.unpivot([], names, "feature", "importance").orderBy(F.desc("importance"), "feature").limit(3)


@query
def importance_by_fold(spark, sf_dir):
    """Mean over folds of the absolute correlation of a feature with the label."""
    df = features.returns(labelled(spark, sf_dir), (1, 3)).dropna(subset=["label"])
    f = folds.purged_folds(df).filter("role = 'train'").groupBy("fold").agg(*[F.abs(F.corr("label", n)).alias(n) for n in ("returns_1", "returns_3")])
    return f.unpivot("fold", ["returns_1", "returns_3"], "feature", "value").groupBy("feature").agg(F.avg("value").alias("mean"))


def told(spark, sf_dir, df):
    """``df`` with what its candle tells: the change of the close, ticks and spread."""
    told = features.returns(h1(spark, sf_dir), (1,)).select("symbol", "time", "returns_1", *[F.col(n).cast("double").alias(n) for n in ("tick_volume", "spread")])
    return df.join(told, ["symbol", "time"])


TOLD = ["returns_1", "tick_volume", "spread"]


@query
def permuted_accuracy(spark, sf_dir):
    """Importances for a fixed rule that goes by the change and the ticks, but not by the spread."""
    test = folds.purged_folds(labelled(spark, sf_dir).dropna(subset=["label"])).filter("role = 'test'")
    rows = importance.permuted(told(spark, sf_dir, test.select("fold", "symbol", "time", F.col("label").alias("class"))), TOLD)
    rule = F.when((F.col("returns_1") > 0) & (F.pmod("tick_volume", F.lit(2)) == 0), 1).when(F.col("returns_1") < 0, -1).otherwise(0)
    return importance.lost_accuracy(rows.withColumn("class_predicted", rule))


@query
def permutation_importance(spark, sf_dir):
    """Mean over folds of what a forest's accuracy loses without a feature; the most important first."""
    df = told(spark, sf_dir, labelled(spark, sf_dir).dropna(subset=["label"])).dropna(subset=TOLD)
    rows = df.withColumns({"class": (F.col("label") + 1).cast("double"), "weight": F.lit(1.0)}).select("symbol", "time", "t1", "class", "weight", *TOLD)
    found = importance.permutation_importance(rows, TOLD, training.Trees(n_trees=20, min_rows=20), Training(n_splits=3))
    return training.ranked(found)
