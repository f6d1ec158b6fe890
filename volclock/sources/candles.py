"""Candles from files, from a broker and from event tables; cleaning and validation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volclock.config import Cleaning
from volclock.functions.windows import lag

SCHEMA = "time timestamp, open double, high double, low double, close double, tick_volume long, spread long, real_volume long"
REQUIRED = ("time", "open", "high", "low", "close", "tick_volume", "spread")
PRICES = ("open", "high", "low", "close")


def read_csv(spark: SparkSession, path: str, symbol: str = "EURUSD") -> DataFrame:
    """Candles with a header row; a missing file or a malformed row is an error."""
    df = spark.read.schema(SCHEMA).options(header=True, mode="FAILFAST").csv(path)
    return require(df.withColumn("symbol", F.lit(symbol)))


def require(df: DataFrame) -> DataFrame:
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null, which all operators here take as missing."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in PRICES})


def clean(df: DataFrame, cfg: Cleaning = Cleaning()) -> DataFrame:
    """Drops real_volume, rows without prices, inverted candles, thin ones and wide spreads."""
    return (
        require(df)
        .drop("real_volume")
        .dropna(subset=list(PRICES))
        .filter((F.col("high") >= F.col("low")) & (F.col("tick_volume") >= cfg.min_tick_volume) & (F.col("spread") <= cfg.max_spread_pips * 10))
    )


def problems(df: DataFrame) -> DataFrame:
    """Per symbol: rows, nulls of each price, inverted candles."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in PRICES]
    return df.groupBy("symbol").agg(F.count("*").alias("n_rows"), *nulls, F.count_if(F.col("high") < F.col("low")).alias("inverted"))


def summary(df: DataFrame) -> DataFrame:
    """Per symbol: rows, first and last time, price range, mean volume and spread."""
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.min("low").alias("lowest"),
        F.max("high").alias("highest"),
        F.avg("tick_volume").alias("mean_volume"),
        F.avg("spread").alias("mean_spread"),
    )


def gaps(df: DataFrame, longest: timedelta = timedelta(hours=3)) -> DataFrame:
    """Per symbol: number of gaps that exceed ``longest``, and the longest in seconds."""
    step = F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(lag("time").cast("timestamp"))
    return df.select("symbol", (step / 1e6).alias("s")).groupBy("symbol").agg(
        F.count_if(F.col("s") > longest.total_seconds()).alias("n_gaps"), F.max("s").alias("longest_s")
    )


def overlap(a: DataFrame, b: DataFrame, least_days: int = 90) -> DataFrame:
    """One row: first and last common time, days in common, and whether that is enough.
    ``check_overlap`` raises if there is none."""
    x = a.agg(F.min("time").alias("_a0"), F.max("time").alias("_a1"))
    y = b.agg(F.min("time").alias("_b0"), F.max("time").alias("_b1"))
    both = x.crossJoin(y).select(F.greatest("_a0", "_b0").alias("first_time"), F.least("_a1", "_b1").alias("last_time"))
    days = F.date_diff("last_time", "first_time")
    return both.select("first_time", "last_time", days.alias("days"), (days >= least_days).alias("enough"))


def check_overlap(a: DataFrame, b: DataFrame, least_days: int = 90) -> bool:
    row = overlap(a, b, least_days).first()
    if row["first_time"] is None or row["first_time"] > row["last_time"]:
        raise ValueError("the two tables have no time in common")
    return row["enough"]


def load_bars(spark: SparkSession, path: str, symbol: str = "EURUSD", cfg: Cleaning = Cleaning()) -> DataFrame:
    return clean(without_nan(read_csv(spark, path, symbol)), cfg)


def load_dual(spark: SparkSession, m5: str, h1: str, symbol: str = "EURUSD", cfg: Cleaning = Cleaning()) -> tuple[DataFrame, DataFrame]:
    a, b = load_bars(spark, m5, symbol, cfg), load_bars(spark, h1, symbol, cfg)
    if not check_overlap(a, b):
        warnings.warn("the two tables have less than 90 days in common", stacklevel=2)
    return a, b


def event_ticks(events: DataFrame) -> DataFrame:
    """Every event as one candle of the symbol that its type names."""
    k = F.get_json_object("props", "$.k").cast("long")
    value = [F.col("value").alias(c) for c in PRICES]
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), *value, (k + 1).alias("tick_volume"), k.alias("spread"))


def event_candles(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Candles of ``minutes`` for each event type; volume is the number of events."""
    t = event_ticks(events).groupBy("symbol", F.window("time", f"{minutes} minutes").alias("w")).agg(
        F.min_by("close", "time").alias("open"),
        F.max("close").alias("high"),
        F.min("close").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.count("*").alias("tick_volume"),
        F.max("spread").alias("spread"),
    )
    return t.select("symbol", F.col("w.start").alias("time"), *PRICES, "tick_volume", "spread")


@dataclass
class PagedHistory:
    """The last ``count`` bars from ``fetch(offset, size)``, which counts back from the newest bar
    and returns tuples (epoch seconds, open, high, low, close, tick_volume, spread).

    Pages are tasks of one Spark job. Where a page fails, what is newer than it is kept.
    """

    fetch: object
    page: int = 5000

    def load(self, spark: SparkSession, count: int, symbol: str = "EURUSD") -> DataFrame:
        fetch, page = self.fetch, self.page
        offsets = spark.range(0, max(0, -(-count // page)), 1, max(1, -(-count // page)))

        def pages(batches):
            for pdf in batches:
                import pandas as pd

                for i in pdf["id"]:
                    try:
                        rows = fetch(int(i) * page, min(page, count - int(i) * page))
                        yield pd.DataFrame([(int(i), True, *r) for r in rows] or [(int(i), True, *[None] * 7)], columns=names)
                    except ConnectionError:
                        yield pd.DataFrame([(int(i), False, *[None] * 7)], columns=names)

        names = ["page", "fine", "epoch", "open", "high", "low", "close", "tick_volume", "spread"]
        schema = "page long, fine boolean, epoch long, open double, high double, low double, close double, tick_volume long, spread long"
        got = offsets.mapInPandas(pages, schema)
        broken = got.filter("not fine").agg(F.coalesce(F.min("page"), F.lit(1 << 62)).alias("_broken"))
        whole = got.join(F.broadcast(broken), F.col("page") < F.col("_broken")).filter("epoch is not null")
        return whole.select(F.lit(symbol).alias("symbol"), F.timestamp_seconds("epoch").alias("time"), *PRICES, "tick_volume", "spread")
