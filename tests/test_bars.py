from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from volclock.operators import bars


def plain(rows, threshold):
    """(symbol, bar) -> (rows, volume, open, close) of whole bars, row by row."""
    out, held, bar = {}, {}, {}
    for symbol, time, price, volume in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        held.setdefault(symbol, []).append((price, volume or 0))
        if sum(v for _, v in held[symbol]) >= threshold:
            now = held.pop(symbol)
            k = bar[symbol] = bar.get(symbol, -1) + 1
            out[symbol, k] = (len(now), sum(v for _, v in now), now[0][0], now[-1][0])
    return out


def test_bars_over_batches(spark):
    """A symbol passes in batches, none of which holds it whole, and no frame gathers it."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), datetime(2024, 1, 1) + timedelta(seconds=i), float(i), rng.choice([0, 1, 3, 50, None, 200])) for i in range(3000)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "symbol string, time timestamp, price double, tick_volume long").select(
        "symbol", "time", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "tick_volume", F.lit(1).cast("long").alias("spread")
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = bars.volume_bars(df, 120)
        got = {(r["symbol"], r["bar_id"]): (r["bar_count"], r["tick_volume"], r["open"], r["close"]) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 120)
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    assert bars.volume_bars(df.limit(0), 120).collect() == []
