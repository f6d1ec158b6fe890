"""Weights of overlapping events by their average uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.functions import blocks
from volclock.sources.stored import stored


def _points(events: DataFrame) -> DataFrame:
    """Per symbol and time (of starts and ends): how many events start and end there, and how many
    are open, both ends included. Running sums go on from one range of time to the next."""
    starts = events.select("symbol", "time", F.lit(1).alias("s"), F.lit(0).alias("e"))
    ends = events.select("symbol", F.col("t1").alias("time"), F.lit(0).alias("s"), F.lit(1).alias("e"))
    points = starts.unionByName(ends).groupBy("symbol", "time").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    points = stored(points.withColumn("_bucket", blocks.bucket_of()), "points")
    points = blocks.carried(points, "_bucket", _open=(F.sum(F.col("s") - F.col("e")), F.sum))
    upto = Window.partitionBy("symbol", "_bucket").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("concurrent", F.coalesce("_open", F.lit(0)) + F.sum(F.col("s") - F.col("e")).over(upto) + F.col("e")).drop("_open")


def concurrency(events: DataFrame) -> DataFrame:
    """Per symbol and point t (starts and ends of events): number of events open at t, both
    ends included. ``events``: symbol, time, t1."""
    return _points(events).select("symbol", F.col("time").alias("t"), "concurrent")


def uniqueness(events: DataFrame) -> DataFrame:
    """``events`` with uniqueness: the mean of 1 / concurrency over the points they span.

    Running sums of it are written once; an event asks them at its start and its end.
    """
    line = _points(events).withColumn("_i", 1 / F.greatest("concurrent", F.lit(1)))
    line = stored(line.select("symbol", "time", "_bucket", "_i"), "inverse")
    line = blocks.carried(line, "_bucket", _u0=(F.sum("_i"), F.sum), _n0=(F.count("*"), F.sum))
    upto = Window.partitionBy("symbol", "_bucket").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"_u": F.coalesce("_u0", F.lit(0.0)) + F.sum("_i").over(upto), "_n": F.coalesce("_n0", F.lit(0)) + F.count("*").over(upto)})
    line = stored(line.select("symbol", "time", F.struct("_u", "_n", "_i").alias("_at")), "sums")
    start, end = (line.select("symbol", F.col("time").alias(k), F.col("_at").alias(name)) for k, name in (("time", "_a"), ("t1", "_b")))
    joined = events.join(start, ["symbol", "time"]).join(end, ["symbol", "t1"])
    mean = (F.col("_b._u") - F.col("_a._u") + F.col("_a._i")) / (F.col("_b._n") - F.col("_a._n") + 1)
    return joined.select(*events.columns, mean.alias("uniqueness"))


def sample_weights(events: DataFrame) -> DataFrame:
    """``events`` with weight: uniqueness scaled to the number of events; 1 without t1. They are
    written once in the shared folder, so that their labels aren't made again for each use."""
    events = stored(events, "events")
    known = stored(uniqueness(events.select("symbol", "time", "t1").dropna(subset=["t1"])), "uniqueness")
    scale = known.groupBy("symbol").agg((F.count("*") / F.sum("uniqueness")).alias("_scale"))
    found = known.join(scale, "symbol").select(F.col("symbol"), F.col("time"), (F.col("uniqueness") * F.col("_scale")).alias("weight"))
    return events.join(found, ["symbol", "time"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def effective_number(weighted: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weighted.groupBy("symbol").agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"), F.count("*").alias("n"))
