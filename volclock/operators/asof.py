"""Backward as-of join of features of a slower timeframe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.functions import blocks
from volclock.functions.windows import lag
from volclock.sources.stored import stored


@blocks.blocked(lambda **_: 1)
def _one_later(slow: DataFrame, features: list[str]) -> DataFrame:
    return slow.withColumns({f: lag(f) for f in features})


def shifted(slow: DataFrame, features: list[str]) -> DataFrame:
    """Features one row later, so that only closed candles are seen; empty rows go."""
    numbers = [c for c in ("_pos",) if c in slow.columns]
    return _one_later(slow.select("symbol", "time", *numbers, *features), features).dropna(how="all", subset=features).drop("_pos")


def asof(fast: DataFrame, slow: DataFrame, features: list[str], seconds: int | None = None) -> DataFrame:
    """``fast`` with the features of the newest row of ``slow`` at or before its time.

    Both sides are dealt to ranges of time of each symbol. Inside of a range they are merged by one
    sort, and the newest row of ``slow`` is carried along as one struct, so that its nulls aren't
    filled from older rows; the last such row before a range comes from the ranges before it, of
    which one row each is looked at. No symbol is sorted as a whole. ``slow`` is written once in the
    shared folder, as both are taken from it.
    """
    names = fast.columns
    slow = stored(slow.select("symbol", "time", *features), "slower")
    left = fast.select("symbol", "time", F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).alias("_slow"))
    right = slow.select("symbol", "time", F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*features).alias("_slow"))
    newest = slow.select("symbol", "time", F.struct(*features).alias("_slow")).withColumn("_bucket", blocks.bucket_of(seconds))
    newest = newest.groupBy("symbol", "_bucket").agg(F.max_by("_slow", "time").alias("_last"))
    ranges = fast.select("symbol", blocks.bucket_of(seconds).alias("_bucket")).distinct()
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = ranges.withColumn("_last", F.lit(None)).unionByName(newest).groupBy("symbol", "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
    carried = both.select("symbol", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("symbol", "_bucket").orderBy("time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("_bucket", blocks.bucket_of(seconds)).withColumn("_slow", F.last("_slow", ignorenulls=True).over(inside)).filter("_side = 1")
    merged = blocks.joined(merged, carried, "symbol", "_bucket")
    found = F.coalesce("_slow", "_carried")
    return merged.select(*[F.col(f"_row.{n}").alias(n) for n in names], *[found[f].alias(f) for f in features])
