"""What scores the live loop's candles: the features of both timeframes, and a model read again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volclock.config import Cleaning, Features, Labels
from volclock.functions.windows import trailing
from volclock.operators import labels
from volclock.operators.training import predict
from volclock.plans.pipeline import aligned, build_features
from volclock.sources import candles
from volclock.sources.models import Saved
from volclock.sources.stored import stored


def barrier_widths(closes: DataFrame, cfg: Labels = Labels(), least: int = 30) -> DataFrame:
    """symbol, time and ``width``, what barriers are a multiple of, from the closes at the bars that
    the model sees: null where a symbol has fewer than ``least`` of them up to there."""
    df = labels.daily_volatility(closes.select("symbol", "time", "close"), cfg.vol_lookback)
    multiplier = F.lit(1.0)
    if cfg.dynamic:
        df, multiplier = labels.barrier_multiplier(df, cfg.vol_fast, cfg.vol_slow), F.col("barrier_mult")
    df = labels.blocks.in_blocks(df, lambda d: d.withColumn("_seen", F.count("*").over(trailing(least))), least)
    return df.select("symbol", "time", F.when(F.col("_seen") >= least, F.col("daily_vol") * multiplier).alias("width"))


@dataclass
class Scorer:
    """The ``model`` of a ``LiveLoop``.

    ``slow`` returns the candles of the slower timeframe held, its open one included: features are
    taken one candle later, so that a bar sees the newest closed one. Both are cleaned as for
    training. A feature that the model was trained with and that is missing is an error; others are
    left out. Widths are those of the closes at the bars. Candles too few for a feature give no row,
    or an error where a symbol has fewer than ``least_bars`` bars.
    """

    saved: Saved
    slow: Callable[[], DataFrame]
    features: Features = field(default_factory=Features)
    barriers: Labels = field(default_factory=Labels)
    cleaning: Cleaning = field(default_factory=Cleaning)
    use_bars: bool = True
    session_window: tuple[int, int] = (1440, 288)
    least: int = 30
    least_bars: int | None = None

    def __call__(self, fast: DataFrame) -> DataFrame:
        fast = stored(candles.clean(fast, self.cleaning), "live-fast")
        slow = candles.clean(self.slow(), self.cleaning)
        rows = build_features(fast, slow, self.features, self.saved.frac_d, self.use_bars, self.session_window, self.least_bars)
        rows = stored(aligned(rows, self.saved.features), "live-features")
        widths = barrier_widths(labels.closes_of(fast, rows), self.barriers, self.least)
        return predict(self.saved.model, rows).join(widths, ["symbol", "time"], "left").select("symbol", "time", "probabilities", "width")


def slow_candles(fast: DataFrame, minutes: int = 60) -> DataFrame:
    """Candles of ``minutes`` made of faster ones, for a broker that only sends these; the last one is open."""
    start = F.window("time", f"{minutes} minutes").getField("start")
    names = {"open": F.min_by("open", "time"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "time"), "tick_volume": F.sum("tick_volume"), "spread": F.max("spread")}
    return fast.groupBy("symbol", start.alias("time")).agg(*[v.alias(k) for k, v in names.items()])


def backfill(load: Callable[[int], tuple[DataFrame, DataFrame]], counts: tuple[int, ...] = (25_000, 10_000, 5_000)) -> tuple[DataFrame, DataFrame]:
    """The fast and slow candles that the loop begins with: ``load`` is asked for fewer of them while it
    raises an OSError or one of both is empty. Nothing at the last count is an error."""
    why = None
    for count in counts:
        try:
            fast, slow = load(count)
            if not fast.isEmpty() and not slow.isEmpty():
                return fast, slow
        except OSError as failed:
            why = failed
    raise ValueError(f"no candles of both timeframes, not even {counts[-1]}") from why
