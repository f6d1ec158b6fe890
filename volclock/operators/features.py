"""Features of candles. Each function adds columns by trailing windows of one symbol in time
order, in blocks of rows with a halo before them; functions that call others share their blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volclock.config import Features
from volclock.functions import blocks
from volclock.functions.blocks import blocked, numbered
from volclock.functions.means import block_rows, span, with_means
from volclock.functions.windows import change, lag, median, rolled, safe, series, trailing, zscore


def c(name: str) -> Column:
    return F.col(name)


@numbered
def exponential(df: DataFrame, suffix: str = "", fast: int = 12, slow: int = 26, signal: int = 9, period: int = 14, rows: int | None = None) -> DataFrame:
    """rsi, macd_pct, macd_signal_pct, macd_hist_pct, ema_cross_pct and atr_pct, and the signs of the
    line and the histogram as ema_side and macd_side, which a close of 0 has as well.

    The signal is the mean of a difference of means. A mean of a mean is a sum of two plain means
    of the same prices, so that one scan gives all.
    """
    keep = [x for x in df.columns if not x.startswith("_") or x == "_pos"]
    wilder, of_fast, of_slow, of_signal = 1 / period, span(fast), span(slow), span(signal)
    cut = blocks.with_halo(df, 1, block_rows([wilder, of_fast, of_slow, of_signal], rows))
    inside = Window.partitionBy("symbol", "_block").orderBy("_pos")
    step, before = c("close") - F.lag("close").over(inside), F.lag("close").over(inside)
    true_range = F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))
    cut = cut.withColumns({"_gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))), "_tr": true_range})
    means = [
        ("_avg_gain", "_gain", wilder, period), ("_avg_loss", "_loss", wilder, period), ("_atr", "_tr", wilder, period),
        ("_fast", "close", of_fast, 1), ("_slow", "close", of_slow, 1), ("_smooth", "close", of_signal, 1),
    ]
    df = with_means(cut, means)

    def smoothed(name: str, alpha: float) -> Column:
        q, r = 1 - alpha, 1 - of_signal
        if abs(q - r) < 1e-9:
            raise ValueError("the signal's span must differ from both others")
        return (of_signal * q * c(name) - alpha * r * c("_smooth")) / (q - r)

    line = c("_fast") - c("_slow")
    df = df.withColumns({"_line": line, "_signal": F.when(c("_pos") == 0, line).otherwise(smoothed("_fast", of_fast) - smoothed("_slow", of_slow))})
    pct = F.lit(10_000) / F.nullif(c("close"), F.lit(0.0))
    out = {
        "rsi": 100 - 100 / (1 + safe(c("_avg_gain"), c("_avg_loss"))),
        "macd_pct": c("_line") * pct,
        "macd_signal_pct": c("_signal") * pct,
        "macd_hist_pct": (c("_line") - c("_signal")) * pct,
        "ema_cross_pct": c("_line") * pct,
        "atr_pct": safe(c("_atr"), c("close")),
        "ema_side": F.sign(c("_line")),
        "macd_side": F.sign(c("_line") - c("_signal")),
    }
    return df.select(*keep, *[v.alias(k + suffix) for k, v in out.items()])


@blocked(lambda n, **_: n)
def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, suffix: str = "") -> DataFrame:
    """bb_position, 0.5 where the bands have no width or aren't known yet, and bb_width_pct."""
    mean, dev = rolled(F.avg, c("close"), n), rolled(F.stddev_samp, c("close"), n)
    low, width = mean - k * dev, 2 * k * dev
    position = F.when(width > 0, (c("close") - low) / F.nullif(width, F.lit(0.0))).otherwise(0.5)
    return df.withColumns({f"bb_position{suffix}": position, f"bb_width_pct{suffix}": safe(width, c("close"))})


@blocked(lambda horizons, **_: max(horizons))
def returns(df: DataFrame, horizons: tuple[int, ...], suffix: str = "") -> DataFrame:
    return df.withColumns({f"returns_{h}{suffix}": change(c("close"), h) for h in horizons})


def log_return() -> Column:
    ratio = safe(c("close"), lag("close"))
    return F.when(ratio > 0, F.ln(F.greatest(ratio, F.lit(1e-300))))


@blocked(lambda n, **_: n)
def volatility(df: DataFrame, n: int = 96, least: int | None = None, name: str = "realized_vol_96") -> DataFrame:
    df = df.withColumn("_lr", log_return())
    return df.withColumn(name, rolled(F.stddev_samp, c("_lr"), n, least) * math.sqrt(n)).drop("_lr")


@numbered
def indicators(df: DataFrame, cfg: Features = Features()) -> DataFrame:
    trailing_ones = lambda df: volatility(returns(bollinger(df), cfg.horizons).withColumn("log_return_1", log_return()))
    return blocks.in_blocks(exponential(df), trailing_ones, max(96, 20, *cfg.horizons))


def candle_shape(df: DataFrame) -> DataFrame:
    size = c("high") - c("low")
    return df.withColumns(
        {
            "body_ratio": safe(c("close") - c("open"), size),
            "upper_shadow_ratio": safe(c("high") - F.greatest("open", "close"), size),
            "lower_shadow_ratio": safe(F.least("open", "close") - c("low"), size),
        }
    )


def fractional_hour() -> Column:
    return F.hour("time") + F.minute("time") / 60


def cyclic_time(df: DataFrame) -> DataFrame:
    """Hour of 24 and day of a week of five days, on the unit circle."""
    hour, day = 2 * math.pi * fractional_hour() / 24, 2 * math.pi * F.weekday("time") / 5
    return df.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "dow_sin": F.sin(day), "dow_cos": F.cos(day)})


@blocked(lambda n, **_: n)
def flow(df: DataFrame, n: int = 288, least: int = 20) -> DataFrame:
    """volume_ratio, kyle_lambda, amihud and their rolling medians."""
    volume = c("tick_volume").cast("double")
    df = df.withColumns({"_r": F.abs(change(c("close"))), "_v": F.nullif(volume, F.lit(0.0))})
    df = df.withColumns({"volume_ratio": safe(volume, rolled(F.avg, volume, n, least)), "kyle_lambda": safe(c("_r"), c("_v")), "amihud": safe(c("_r"), c("_v") * c("close"))})
    return df.withColumns({f"{x}_smooth": rolled(median, c(x), n, least) for x in ("kyle_lambda", "amihud")}).drop("_r", "_v")


@blocked(lambda n, **_: n)
def vpin(df: DataFrame, n: int = 48, least: int = 20) -> DataFrame:
    volume = c("tick_volume").cast("double")
    bought = F.coalesce(safe(c("close") - c("low"), c("high") - c("low")), F.lit(0.5))
    df = df.withColumn("_i", F.abs(volume * bought - volume * (1 - bought)))
    return df.withColumn("vpin", safe(rolled(F.avg, c("_i"), n, least), rolled(F.avg, volume, n, least))).drop("_i")


@blocked(lambda cfg: max(cfg.micro, cfg.vpin))
def microstructure(df: DataFrame, cfg: Features = Features()) -> DataFrame:
    df = df.withColumns({"volume_zscore": zscore(c("tick_volume").cast("double"), cfg.micro), "spread_zscore": zscore(c("spread").cast("double"), cfg.micro)})
    return cyclic_time(candle_shape(vpin(flow(df, cfg.micro), cfg.vpin)))


@blocked(lambda fast, slow, **_: max(fast, slow))
def vol_regime(df: DataFrame, fast: int, fast_least: int, slow: int, slow_least: int, name: str = "vol_regime") -> DataFrame:
    df = df.withColumn("_r", change(c("close")))
    return df.withColumn(name, safe(rolled(F.stddev_samp, c("_r"), fast, fast_least), rolled(F.stddev_samp, c("_r"), slow, slow_least))).drop("_r")


def run_length(direction: Column) -> Column:
    """Sign times the length of the run so far; null counts as 0."""
    return F.coalesce(F.sign(direction), F.lit(0.0))


@numbered
def consecutive(df: DataFrame) -> DataFrame:
    """consecutive_direction. A run that began before its block is known by where the newest of
    all runs so far began, which is carried from block to block."""
    kept = df.columns
    df = blocks.in_blocks(df, lambda x: x.withColumn("_d", run_length(c("close") - lag("close"))), 1)
    df = blocks.in_blocks(df, lambda x: x.withColumn("_start", F.when(~F.lag("_d").over(series()).eqNullSafe(c("_d")), c("_pos"))), 1)
    df = blocks.carried(df.withColumn("_block", F.floor(c("_pos") / blocks.ROWS)), "_block", _newest=(F.max("_start"), F.max))
    inside = Window.partitionBy("symbol", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    began = F.coalesce(F.max("_start").over(inside), "_newest")
    return df.withColumn("consecutive_direction", c("_d") * (c("_pos") - began + 1)).select(*kept, "consecutive_direction")


@blocked(lambda n: max(n, 8))
def momentum(df: DataFrame, n: int = 12) -> DataFrame:
    """momentum_quality, return_acceleration and its mean over six rows."""
    df = df.withColumn("_r", change(c("close")))
    df = df.withColumn("_a", F.abs(c("_r")))
    df = df.withColumns({"momentum_quality": safe(F.abs(change(c("close"), n)), rolled(F.sum, c("_a"), n)), "return_acceleration": c("_r") - lag("_r")})
    return df.withColumn("return_acceleration_smooth", rolled(F.avg, c("return_acceleration"), 6, 3)).drop("_r", "_a")


@numbered
def regime(df: DataFrame, cfg: Features = Features()) -> DataFrame:
    """Adds the regime columns; atr_pct and consecutive_direction only where they are missing."""
    if "atr_pct" not in df.columns:
        keep = df.columns
        df = exponential(df).select(*keep, "atr_pct")

    def trailing_ones(df: DataFrame) -> DataFrame:
        df = vol_regime(df, cfg.vol_fast, 10, cfg.vol_slow, 50)
        return momentum(df.withColumn("vol_of_vol", rolled(F.stddev_samp, c("atr_pct"), cfg.vol_slow, 50)), cfg.momentum)

    df = blocks.in_blocks(df, trailing_ones, max(cfg.vol_fast, cfg.vol_slow, cfg.momentum, 8))
    return df if "consecutive_direction" in df.columns else consecutive(df)


def _within(hours: tuple[int, int]) -> Column:
    return (fractional_hour() >= hours[0]) & (fractional_hour() < hours[1])


def sessions(df: DataFrame, cfg: Features = Features(), mean_over: int = 1440, least: int = 288) -> DataFrame:
    """session_id (0 Asian, 1 London, 2 New York, which wins where both are open, 3 none),
    overlap, share of the session gone, range of the session so far and share of the volume."""
    asian, london, york = _within(cfg.asian), _within(cfg.london), _within(cfg.new_york)
    gone = lambda h: F.least(F.greatest((fractional_hour() - h[0]) / (h[1] - h[0]), F.lit(0.0)), F.lit(1.0))
    df = df.withColumns(
        {
            "session_id": F.when(york, 2).when(london, 1).when(asian, 0).otherwise(3),
            "is_london_ny_overlap": (london & york).cast("int"),
            "session_elapsed_pct": F.when(york, gone(cfg.new_york)).when(london, gone(cfg.london)).when(asian, gone(cfg.asian)).otherwise(0.5),
            "_day": F.to_date("time"),
        }
    )
    so_far = Window.partitionBy("symbol", "_day").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    width = lambda open_now: F.when(open_now, F.max(F.when(open_now, c("high"))).over(so_far) - F.min(F.when(open_now, c("low"))).over(so_far))
    df = df.withColumn("_range", safe(F.coalesce(width(york), width(london), width(asian)), c("close")))
    volume = c("tick_volume").cast("double")
    shares = {"session_range_pct": safe(c("_range"), rolled(F.avg, c("_range"), mean_over, least)), "session_volume_pct": safe(volume, rolled(F.avg, volume, mean_over, least))}
    return blocks.in_blocks(df, lambda x: x.withColumns(shares), mean_over).drop("_day", "_range")


@blocked(lambda n, **_: n)
def hurst(df: DataFrame, n: int = 24, least: int = 10, name: str = "hurst_h1") -> DataFrame:
    """Rescaled range of the last n log returns: ln(R / S) / ln n, a missing return as 0."""
    df = df.withColumn("_lr", log_return())
    df = df.withColumn("_w", F.collect_list(F.struct(c("_lr").alias("r"))).over(trailing(n)))
    values = F.transform("_w", lambda x: x["r"])
    df = df.withColumns({"_v": values, "_m": F.count("_lr").over(trailing(n)), "_mean": F.avg("_lr").over(trailing(n)), "_sd": F.stddev_samp("_lr").over(trailing(n))})
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a, x):
        s = a["s"] + F.coalesce(x - c("_mean"), F.lit(0.0))
        return F.struct(s.alias("s"), F.least(a["lo"], s).alias("lo"), F.greatest(a["hi"], s).alias("hi"))

    df = df.withColumn("_f", F.aggregate("_v", start, step))
    spread = c("_f.hi") - c("_f.lo")
    fine = (F.size("_w") == n) & (c("_m") >= least) & (c("_sd") > 0) & (spread > 0)
    value = F.ln(F.when(fine, safe(spread, c("_sd")))) / math.log(n)
    return df.withColumn(name, value).drop("_lr", "_w", "_v", "_m", "_mean", "_sd", "_f")


H1 = (
    "rsi_h1", "macd_pct_h1", "macd_signal_pct_h1", "macd_hist_pct_h1", "ema_cross_h1", "atr_pct_h1", "bb_position_h1",
    "realized_vol_h1", "vol_regime_h1", "hurst_h1", "returns_1_h1", "returns_4_h1", "returns_24_h1",
)
#: Not features by themselves: what ``cross_timeframe`` needs of the slower timeframe besides.
SIDES = ("ema_side_h1", "macd_side_h1")


@numbered
def h1_features(df: DataFrame, cfg: Features = Features()) -> DataFrame:
    """symbol, time, the thirteen features of the slower timeframe and its ``SIDES``."""
    df = exponential(df, "_h1").withColumnRenamed("ema_cross_pct_h1", "ema_cross_h1")

    def trailing_ones(df: DataFrame) -> DataFrame:
        df = volatility(returns(bollinger(df, suffix="_h1"), cfg.h1_horizons, "_h1"), 24, 10, "realized_vol_h1")
        return hurst(vol_regime(df, 4, 2, 48, 10, "vol_regime_h1"))

    return blocks.in_blocks(df, trailing_ones, max(48, *cfg.h1_horizons)).select("symbol", "time", *H1, *SIDES)


def cross_timeframe(df: DataFrame) -> DataFrame:
    """Adds what its inputs allow: trend_alignment, m5_vs_h1_rsi_divergence, macd_alignment.

    Directions are those of price differences where these are given; a percentage of the close,
    which else does, has none where that is 0, and the opposite one where it is negative.
    """
    both = lambda a, b: F.sign(a) * F.sign(b)
    wanted = [
        ("trend_alignment", ("ema_cross_pct", "ema_cross_h1"), both),
        ("trend_alignment", ("ema_side", "ema_side_h1"), both),
        ("m5_vs_h1_rsi_divergence", ("rsi", "rsi_h1"), lambda a, b: a - b),
        ("macd_alignment", ("macd_hist_pct", "macd_hist_pct_h1"), both),
        ("macd_alignment", ("macd_side", "macd_side_h1"), both),
    ]
    return df.withColumns({k: f(*map(F.col, names)) for k, names, f in wanted if set(names) <= set(df.columns)})


BOUNDED = frozenset(
    "rsi rsi_h1 bb_position bb_position_h1 vol_regime vol_regime_h1 hurst_h1 volume_zscore spread_zscore vpin body_ratio upper_shadow_ratio lower_shadow_ratio "
    "hour_sin hour_cos dow_sin dow_cos trend_alignment m5_vs_h1_rsi_divergence macd_alignment session_id is_london_ny_overlap session_elapsed_pct "
    "momentum_quality consecutive_direction".split()
)


@blocked(lambda window, **_: window)
def normalised(df: DataFrame, features: list[str], window: int = 1440, least: int = 20) -> DataFrame:
    """Features that have no bounds of their own as z-scores; all share one window."""
    return df.withColumns({f: zscore(c(f), window, least) for f in features if f not in BOUNDED})
