"""Labels by the first barrier that the price hits."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.config import Labels
from volclock.functions import blocks
from volclock.functions.blocks import blocked
from volclock.functions.windows import change, rolled, safe, series


@blocked(lambda lookback, **_: lookback)
def daily_volatility(df: DataFrame, lookback: int = 264, least: int = 20) -> DataFrame:
    df = df.withColumn("_r", change(F.col("close")))
    return df.withColumn("daily_vol", rolled(F.stddev_samp, F.col("_r"), lookback, least) * F.col("close") * math.sqrt(lookback)).drop("_r")


@blocked(lambda fast, slow, **_: max(fast, slow))
def barrier_multiplier(df: DataFrame, fast: int = 48, slow: int = 576, fast_least: int = 10, slow_least: int = 50) -> DataFrame:
    """1 + 0.3 (ratio of fast to slow volatility - 1), within [0.5, 2]; 1 where unknown."""
    df = df.withColumn("_r", change(F.col("close")))
    ratio = safe(rolled(F.stddev_samp, F.col("_r"), fast, fast_least), rolled(F.stddev_samp, F.col("_r"), slow, slow_least))
    df = df.withColumn("_m", 1 + 0.3 * (ratio - 1))
    clipped = F.when(F.col("_m").isNotNull(), F.least(F.greatest("_m", F.lit(0.5)), F.lit(2.0)))
    return df.withColumn("barrier_mult", F.coalesce(clipped, F.lit(1.0))).drop("_r", "_m")


def _followed(df: DataFrame, settings: list[Labels]) -> DataFrame:
    """The rows of ``df`` as ``_row``, with the closes that follow (``_ahead``) and the volatility and
    multiplier of each setting that occurs. Blocks of rows hold what lies before and after them, so
    that no symbol is sorted as a whole."""
    lookbacks, speeds = {c.vol_lookback for c in settings}, {(c.vol_fast, c.vol_slow) for c in settings if c.dynamic}
    longest = max(c.max_hold for c in settings)

    def widths(df: DataFrame) -> DataFrame:
        for n in sorted(lookbacks):
            df = daily_volatility(df, n).withColumnRenamed("daily_vol", f"_vol_{n}")
        for fast, slow in sorted(speeds):
            df = barrier_multiplier(df, fast, slow).withColumnRenamed("barrier_mult", f"_mult_{fast}_{slow}")
        return df.withColumn("_ahead", F.collect_list(F.struct("time", "close")).over(series().rowsBetween(1, longest)))

    numbers = [c for c in ("_pos",) if c in df.columns]
    rows = df.select("symbol", "time", "close", *numbers, F.struct(*df.columns).alias("_row"))
    return blocks.in_blocks(rows, widths, max(lookbacks | {n for pair in speeds for n in pair}), ahead=longest)


def _width(cfg: Labels) -> Column:
    multiplier = F.col(f"_mult_{cfg.vol_fast}_{cfg.vol_slow}") if cfg.dynamic else F.lit(1.0)
    return multiplier * F.col(f"_vol_{cfg.vol_lookback}")


def _places() -> Column:
    return F.transform("_ahead", lambda x, i: F.struct((i + 1).alias("j"), x["close"].alias("close")))


def _outcome(hit: Column, up: Column, hold: Column, least: Column, known: Column, pip: float) -> dict[str, Column]:
    """What a row's first hit (j, close; null for none) means; all null unless ``known``."""
    end = F.get("_ahead", F.coalesce(hit["j"], hold) - 1)
    ret = end["close"] - F.col("close")
    pips = ret / pip
    by_time = F.when(F.abs(pips) < least, 0).when(ret > 0, 1).otherwise(-1)
    upper = hit["close"] >= up
    kind = F.when(hit.isNull(), "time").when(upper, "upper").otherwise("lower")
    label = F.when(hit.isNull(), by_time).when(upper, 1).otherwise(-1)
    out = {"label": label, "t1": end["time"], "ret": ret, "ret_pips": pips, "barrier_type": kind, "holding_period": F.coalesce(hit["j"], hold)}
    return {k: F.when(known, v) for k, v in out.items()}


def triple_barrier(df: DataFrame, cfg: Labels = Labels(), pip: float = 0.0001) -> DataFrame:
    """``df`` (symbol, time, close) with label, t1, ret, ret_pips, barrier_type and
    holding_period: null where the future is too short or the volatility unknown."""
    rows = _followed(df, [cfg])
    rows = rows.withColumns({"_up": F.col("close") + cfg.pt * _width(cfg), "_down": F.col("close") - cfg.sl * _width(cfg)})
    hits = F.filter(_places(), lambda x: (x["j"] >= cfg.min_hold) & ((x["close"] >= F.col("_up")) | (x["close"] <= F.col("_down"))))
    known = (F.size("_ahead") == cfg.max_hold) & (F.col(f"_vol_{cfg.vol_lookback}") > 0)
    out = _outcome(F.col("_hit"), F.col("_up"), F.lit(cfg.max_hold), F.lit(cfg.min_return_pips), known, pip)
    return rows.withColumn("_hit", F.get(hits, 0)).select("_row.*", *[v.alias(k) for k, v in out.items()])


def _records(kind: str, least: int, better: Callable[[Column, Column], Column]) -> Column:
    """Those closes ahead, from ``least`` rows on, that are better than all before them. The first of
    them to pass a barrier is the first close to pass it, and there are only a few of them."""

    def step(found: Column, x: Column) -> Column:
        best = F.get(found, F.size(found) - 1)["close"]
        new = (x["j"] >= least) & x["close"].isNotNull() & (best.isNull() | better(x["close"], best))
        return F.when(new, F.array_append(found, x)).otherwise(found)

    return F.aggregate(_places(), F.array().cast(f"array<struct<j:int,close:{kind}>>"), step)


def forward_paths(df: DataFrame, settings: list[Labels]) -> DataFrame:
    """All that labels of any of ``settings`` depend on, one row for each of ``df`` (symbol, time, close):
    for each least holding period the running extremes of the closes ahead. Written once, it gives
    the labels of each setting row by row (``labels_of``), without windows."""
    kind = dict(df.dtypes)["close"]
    rows = _followed(df, settings)
    extremes = {}
    for least in sorted({c.min_hold for c in settings}):
        extremes[f"_highs_{least}"] = _records(kind, least, lambda x, best: x > best)
        extremes[f"_lows_{least}"] = _records(kind, least, lambda x, best: x < best)
    return rows.withColumns(extremes)


def _first_hit(cfg: Labels, up: Column, down: Column) -> Column:
    high = F.get(F.filter(f"_highs_{cfg.min_hold}", lambda x: x["close"] >= up), 0)
    low = F.get(F.filter(f"_lows_{cfg.min_hold}", lambda x: x["close"] <= down), 0)
    hit = F.when(high.isNull() | F.coalesce(low["j"] < high["j"], F.lit(False)), low).otherwise(high)
    return F.when(hit["j"] <= cfg.max_hold, hit)


def _setting(cfg: Labels) -> list[Column]:
    up, down = F.col("close") + cfg.pt * _width(cfg), F.col("close") - cfg.sl * _width(cfg)
    known = (F.size("_ahead") >= cfg.max_hold) & (F.col(f"_vol_{cfg.vol_lookback}") > 0)
    return [_first_hit(cfg, up, down).alias("hit"), up.alias("up"), F.lit(cfg.max_hold).alias("hold"), F.lit(cfg.min_return_pips).alias("least"), known.alias("known")]


def labels_of(paths: DataFrame, cfg: Labels, pip: float = 0.0001) -> DataFrame:
    """As ``triple_barrier``, from ``forward_paths`` made for this setting among others."""
    return grid_labels(paths, [cfg], pip).drop("setting")


def grid_labels(paths: DataFrame, settings: list[Labels], pip: float = 0.0001) -> DataFrame:
    """The rows of ``forward_paths`` once for each of ``settings``, with its number (``setting``, from 0)
    and its labels."""
    each = F.array(*[F.struct(F.lit(i).alias("setting"), *_setting(c)) for i, c in enumerate(settings)])
    rows = paths.withColumn("_s", F.explode(each))
    out = _outcome(F.col("_s.hit"), F.col("_s.up"), F.col("_s.hold"), F.col("_s.least"), F.col("_s.known"), pip)
    return rows.select("_row.*", "_s.setting", *[v.alias(k) for k, v in out.items()])


def closes_of(prices: DataFrame, features: DataFrame) -> DataFrame:
    """The closes at the rows of ``features``; rows without one are left out."""
    return features.select("symbol", "time").join(prices.select("symbol", "time", "close"), ["symbol", "time"]).dropna(subset=["close"])


def labels_for(prices: DataFrame, features: DataFrame, cfg: Labels = Labels(), pip: float = 0.0001) -> DataFrame:
    """Labels over the rows of ``features`` only: barriers count surviving rows."""
    return triple_barrier(closes_of(prices, features), cfg, pip).dropna(subset=["label"])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_total")).alias("share"))
