"""The whole feature pipelines: volume bars with a slower timeframe, or plain candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volclock.config import Features
from volclock.functions import blocks
from volclock.operators import asof, bars, features, fracdiff
from volclock.sources.stored import stored

INDICATORS = [
    "rsi", "macd_pct", "macd_signal_pct", "macd_hist_pct", "bb_position", "bb_width_pct", "atr_pct", "ema_cross_pct",
    "returns_1", "returns_3", "returns_6", "returns_12", "returns_48", "log_return_1", "realized_vol_96",
]
MICRO = [
    "volume_zscore", "volume_ratio", "spread_zscore", "kyle_lambda", "kyle_lambda_smooth", "amihud", "amihud_smooth", "vpin",
    "body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
]
CROSS = ["trend_alignment", "m5_vs_h1_rsi_divergence", "macd_alignment"]
SESSIONS = ["session_id", "is_london_ny_overlap", "session_elapsed_pct", "session_range_pct", "session_volume_pct"]
REGIME = ["vol_regime", "vol_of_vol", "momentum_quality", "return_acceleration", "return_acceleration_smooth", "consecutive_direction"]
FEATURES = [*features.H1, "frac_diff_close", *INDICATORS, *MICRO, *CROSS, *SESSIONS, *REGIME]
LEGACY = ["frac_diff_close", *INDICATORS, *MICRO]


LEAST_BARS = 500
LEAST_LEGACY_BARS = 200


def require_bars(df: DataFrame, least: int = LEAST_BARS) -> DataFrame:
    """``df``; a symbol with fewer rows is an error. This counts at once, so it is a step of its own."""
    few = df.groupBy("symbol").count().filter(F.col("count") < least).orderBy("symbol").take(3)
    if few or df.isEmpty():
        raise ValueError(f"fewer than {least} bars: " + (", ".join(f"{r['symbol']} {r['count']}" for r in few) or "none at all"))
    return df


def build_features(fast: DataFrame, slow: DataFrame, cfg: Features = Features(), d: float = 0.4, use_bars: bool = True, session_window: tuple[int, int] = (1440, 288), least: int | None = None) -> DataFrame:
    """symbol, time and the 58 features, without rows that miss any. Fewer than ``least`` bars of a
    symbol are an error, if it is given.

    Each step works on blocks of rows, not on whole symbols. What several blocks' summaries are
    taken from is written once in the shared folder instead of being computed for each of them:
    the bars, the joined rows, and the indicators.
    """
    df = stored(bars.volume_bars(fast, cfg.volume_bar_size).drop("bar_id"), "bars") if use_bars else fast
    df = df if least is None else require_bars(df, least)
    names = [*features.H1, *features.SIDES]
    slower = stored(asof.shifted(features.h1_features(stored(slow, "slow"), cfg), names), "slow-features")
    df = stored(blocks.positioned(asof.asof(df, slower, names)), "joined")
    df = stored(features.indicators(fracdiff.frac_diff(df, d), cfg), "indicators")
    df = features.cross_timeframe(features.consecutive(df))
    df = features.regime(features.sessions(features.microstructure(df, cfg), cfg, *session_window), cfg)
    return features.normalised(df, FEATURES, cfg.rolling_window).select("symbol", "time", *FEATURES).dropna(subset=FEATURES)


def build_legacy_features(df: DataFrame, cfg: Features = Features(), d: float = 0.4) -> DataFrame:
    """symbol, time and the 31 features of one timeframe."""
    df = stored(blocks.positioned(df), "candles")
    df = features.microstructure(stored(features.indicators(fracdiff.frac_diff(df, d), cfg), "indicators"), cfg)
    return features.normalised(df, LEGACY, cfg.rolling_window).select("symbol", "time", *LEGACY).dropna(subset=LEGACY)


def aligned(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The columns that a model was trained with, in its order; a missing one is an error."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"features are missing: {', '.join(missing)}")
    return df.select("symbol", "time", *wanted)
