"""Fractional differencing, and the Dickey-Fuller test that picks its order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.functions import blocks
from volclock.functions.windows import lag

#: Of weights, and of the series of the normal distribution, which has converged by then.
LONGEST, TERMS = 10_000, 120
PAIRS = {"yy": ("change", "change"), "ll": ("level", "level"), "bb": ("before", "before"), "ly": ("level", "change"), "by": ("before", "change"), "lb": ("level", "before")}


def weights(d: float, threshold: float = 1e-4) -> list[float]:
    """Binomial weights of (1 - L)^d, up to the first below the threshold."""
    found = [1.0]
    while len(found) < LONGEST:
        w = -found[-1] * (d - len(found) + 1) / len(found)
        if abs(w) < threshold:
            break
        found.append(w)
    return found


def frac_diff(df: DataFrame, d: float, column: str = "close", name: str = "frac_diff_close", threshold: float = 1e-4) -> DataFrame:
    """Weighted sum of the last rows of each symbol; null until there are as many as weights. A
    symbol is cut into blocks, each of which overlaps the one before by the weights' length."""
    w = np.array(weights(d, threshold))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        x = pdf[column].to_numpy(dtype=float)
        out = np.full(len(x), np.nan)
        if len(x) >= len(w):
            out[len(w) - 1 :] = np.convolve(x, w, "valid")
        pdf[name] = out
        return pdf

    rest = [c for c in df.columns if c != name]
    cut = blocks.with_halo(df.select(*rest), len(w) - 1)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields] + [f"`{name}` double"])
    done = cut.groupBy("symbol", "_block").applyInPandas(run, schema).filter("not _halo")
    return done.select(*rest, F.nanvl(name, F.lit(None)).alias(name))


def adf_sums(df: DataFrame, column: str) -> DataFrame:
    """Per symbol: n and centred cross-products of the regression of the change on the level
    before, the change before and a constant."""
    x = F.col(column)
    df = df.filter(x.isNotNull()).select("symbol", "time", x.alias("y"))
    df = df.withColumns({"level": lag("y"), "change": F.col("y") - lag("y")}).withColumn("before", lag("change")).dropna(subset=["before"])
    return df.groupBy("symbol").agg(F.count("*").alias("n"), *[(F.covar_pop(a, b) * F.count("*")).alias(k) for k, (a, b) in PAIRS.items()])


def adf_t() -> Column:
    """t of the level's coefficient (two regressors and a constant), from n and the sums of ``PAIRS``."""
    det = F.col("ll") * F.col("bb") - F.col("lb") * F.col("lb")
    d = F.nullif(det, F.lit(0.0))
    a, b = (F.col("bb") * F.col("ly") - F.col("lb") * F.col("by")) / d, (F.col("ll") * F.col("by") - F.col("lb") * F.col("ly")) / d
    rest = F.col("yy") - a * F.col("ly") - b * F.col("by")
    error = F.sqrt(F.when((rest > 0) & (F.col("n") > 3), rest / F.nullif(F.col("n") - 3.0, F.lit(0.0)) * F.col("bb") / d))
    return a / F.nullif(error, F.lit(0.0))


def with_adf(sums: DataFrame) -> DataFrame:
    """symbol, n, adf_stat."""
    return sums.select("symbol", "n", adf_t().alias("adf_stat"))


def normal_cdf(z: Column) -> Column:
    """Of the standard normal, by the series of odd powers, which all have one sign; beyond 8 it is 0 or 1."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    series = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda inner, k: inner * z * z / (2 * k + 1) + 1)
    return F.least(F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * z * series + 0.5, F.lit(0.0)), F.lit(1.0))


def p_value(t: Column) -> Column:
    """MacKinnon's response surface for a regression with a constant (fixed values)."""
    low = t * t * 0.038269 + t * 1.4412 + 2.1659
    high = t * t * t * -0.010368 - t * t * 0.12745 + t * 0.93202 + 1.7339
    return F.when(t > 2.74, 1.0).when(t < -18.83, 0.0).when(t.isNotNull(), normal_cdf(F.when(t <= -1.61, low).otherwise(high)))


def all_orders(df: DataFrame, orders: list[float], column: str = "close", threshold: float = 1e-4) -> DataFrame:
    """symbol, raw and ``orders``: for each order, in turn, the differenced value ``z`` and, where the two
    before it are there as well, ``level``, ``change`` and ``before`` of the Dickey-Fuller regression.

    One scan and one shuffle, whatever the number of orders: a block holds the rows before it that
    the longest weights and the two lags reach. Rows without a value are left out first, as lags go
    from value to value.
    """
    ws = [np.array(weights(d, threshold)) if d > 0 else np.ones(1) for d in orders]
    names = ("z", "level", "change", "before")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        x = pdf["raw"].to_numpy(dtype=float)
        z = np.full((len(x) + 2, len(ws)), np.nan)  # two rows of nothing come first
        for i, w in enumerate(ws):
            if len(x) >= len(w):
                z[len(w) + 1 :, i] = np.convolve(x, w, "valid")
        now, last, oldest = z[2:], z[1:-1], z[:-2]
        gone = np.where(np.isnan(oldest), np.nan, 0.0)
        own = ~pdf["_halo"].to_numpy(dtype=bool)
        found = dict(zip(names, (now, last + gone, now - last + gone, last - oldest)))
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy()[own], "raw": x[own]} | {n: pd.Series(list(v[own]), dtype=object) for n, v in found.items()})

    raw = df.select("symbol", "time", F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("raw")).filter("raw is not null")
    cut = blocks.with_halo(raw, max(map(len, ws)) + 1)
    kind = cut.schema["symbol"].dataType.simpleString()
    done = cut.groupBy("symbol", "_block").applyInPandas(run, f"symbol {kind}, raw double, " + ", ".join(f"{n} array<double>" for n in names))
    return done.select("symbol", "raw", F.arrays_zip(*names).alias("orders"))


def adf_tests(df: DataFrame, orders: list[float], column: str = "close", threshold: float = 1e-4) -> DataFrame:
    """symbol, d, n_values, n (rows of the regression), adf_stat, p_value and corr (with the raw series) for
    each symbol with a value and each order. Sums are gathered before anything is shuffled again."""
    each = all_orders(df, orders, column, threshold).select("symbol", "raw", F.posexplode("orders"))
    each = each.select("symbol", "raw", "pos", *[F.nanvl(f"col.{c}", F.lit(None)).alias(c) for c in ("z", "level", "change", "before")])
    sums = [(F.covar_pop(a, b) * F.count("before")).alias(k) for k, (a, b) in PAIRS.items()]
    sums = each.groupBy("symbol", "pos").agg(F.count("before").alias("n"), F.count("z").alias("n_values"), F.corr("raw", "z").alias("corr"), *sums)
    d = F.element_at(F.array(*[F.lit(float(d)) for d in orders]), F.col("pos") + 1)
    return sums.select("symbol", d.alias("d"), "n_values", "n", adf_t().alias("adf_stat"), "corr").withColumn("p_value", p_value(F.col("adf_stat")))


def adf_summary(df: DataFrame, orders: list[float], column: str = "close", threshold: float = 1e-4, least: int = 100) -> DataFrame:
    """symbol, d, n, adf_stat, p_value and corr for each order that leaves at least ``least`` values."""
    return adf_tests(df, orders, column, threshold).filter(F.col("n_values") >= least).select("symbol", "d", "n", "adf_stat", "p_value", "corr")


def find_min_d(df: DataFrame, column: str = "close", low: float = 0.0, high: float = 1.0, step: float = 0.05, threshold: float = 1e-4, p_value: float = 0.05, least: int = 100) -> DataFrame:
    """Per symbol with a value: the smallest order on the grid whose series is stationary, null if none is."""
    grid = [round(low + i * step, 3) for i in range(int(round((high - low) / step)) + 1)]
    fine = (F.col("n_values") >= least) & (F.col("p_value") < p_value)
    return adf_tests(df, grid, column, threshold).groupBy("symbol").agg(F.min(F.when(fine, F.col("d"))).alias("d"))


def require_min_d(found: DataFrame) -> DataFrame:
    """``found`` from ``find_min_d``; a symbol without a stationary order is an error."""
    missing = found.filter("d is null").limit(10).collect()
    if missing:
        raise ValueError(f"no order makes these stationary: {', '.join(str(r['symbol']) for r in missing)}")
    return found
