"""The live loop: what happens to each batch of candles, as DataFrames over small keyed tables.

A batch is upserted into the candles held, the newest candle of each symbol is left out as it is
still open, features and model score the rest, and the last closed bar of each symbol passes the
gates: strictly more confidence than the threshold, a bar not seen before, few enough open
positions, the pause since the last entry, a narrow spread. Positions past the holding limit are
closed first. The clock of an order is the start of its symbol's newest candle. Orders are written
before they are sent and read again if their batch runs again, so that it gives the same ones
whatever quotes have become.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from volclock.config import Training
from volclock.operators import trading
from volclock.streaming import live

log = logging.getLogger(__name__)
STATE = "symbol string, seen timestamp, entered timestamp"
POSITIONS = "symbol string, order_id string, side int, opened timestamp"


@dataclass
class Versions:
    """Tables under ``folder``, of which the last two versions are kept: a batch reads the one
    before it and writes its own, so that it can run again."""

    spark: SparkSession
    folder: str

    def before(self, name: str, epoch: int, schema: str) -> DataFrame:
        if epoch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{(epoch - 1) % 2}")

    def once(self, name: str, epoch: int, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gave when this epoch first came here, also if it runs again. Epoch 0
        begins anew, whatever an earlier life of the folder left."""
        context = self.spark.sparkContext
        path = lambda e: context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" + ("" if e is None else f"/{e}"))
        fs = path(None).getFileSystem(context._jsc.hadoopConfiguration())
        fs.delete(path(None if epoch == 0 else epoch - 2), True)
        if not fs.exists(path(f"{epoch}/_SUCCESS")):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}/{epoch}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{epoch}")

    def write(self, name: str, epoch: int, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/{epoch % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def upserted(held: DataFrame, batch: DataFrame, keep: int) -> DataFrame:
    """Candles of ``batch`` replace those held of the same symbol and time; the last ``keep`` of
    each symbol stay. Within a batch the one with the most ticks counts."""
    both = held.withColumn("_new", F.lit(0)).unionByName(batch.select(*held.columns).withColumn("_new", F.lit(1)))
    version = both.withColumn("_version", F.struct("_new", "tick_volume"))
    return live.newest(live.latest_versions(version, "_version").drop("_new", "_version"), keep)


def expired(positions: DataFrame, now: datetime, cfg: Training = Training()) -> DataFrame:
    """``positions`` with whether they have been open for longer than the holding limit."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("opened")
    return positions.withColumn("expired", F.coalesce(age > cfg.max_hold * cfg.bar_minutes * 60, F.lit(False)))


def accepted(signals: DataFrame, state: DataFrame, positions: DataFrame, quotes: DataFrame, clock: DataFrame, cfg: Training = Training(), spread: float = 1.5) -> DataFrame:
    """Orders out of ``signals`` (symbol, time, side, width), one row at most for each symbol.

    A symbol that has no ``state`` yet only starts it. ``quotes``: symbol, bid, ask, fill_mask.
    """
    held = positions.groupBy("symbol").agg(F.count("*").alias("_held"))
    rows = signals.join(clock, "symbol").join(state, "symbol").join(quotes, "symbol").join(held, "symbol", "left")
    rested = F.col("entered").isNull() | (F.unix_timestamp("now") - F.unix_timestamp("entered") >= cfg.cooldown_minutes * 60)
    pip = trading.pip_size(F.col("symbol"))
    fine = (F.col("side") != 0) & (F.col("time") > F.col("seen")) & (F.coalesce("_held", F.lit(0)) < cfg.max_open_trades) & rested & F.col("width").isNotNull()
    rows = rows.filter(fine & live.tradable(F.col("bid"), F.col("ask"), pip, spread))
    take, stop = trading.exit_prices(F.col("side"), F.col("bid"), F.col("ask"), F.col("width"))
    return rows.select(
        "symbol", F.concat_ws("-", "symbol", F.unix_timestamp("time")).alias("order_id"), F.col("side").cast("int").alias("side"), F.col("now").alias("opened"),
        F.when(F.col("side") > 0, F.col("ask")).otherwise(F.col("bid")).alias("price"), take.alias("take_profit"), stop.alias("stop_loss"),
        trading.fill_mode(F.col("fill_mask")).alias("fill"), F.lit(trading.DEVIATION).alias("deviation"), trading.lot_size(F.col("confidence")).alias("lots"),
    )


@dataclass
class LiveLoop:
    """For ``foreachBatch``. ``model`` takes closed candles (symbol, time, prices, ...) and returns
    symbol, time, probabilities and width (of the barriers); ``quotes`` returns the latest quotes."""

    tables: Versions
    model: Callable[[DataFrame], DataFrame]
    quotes: Callable[[], DataFrame]
    broker: live.SimulatedBroker
    cfg: Training = Training()
    keep: int = 25_000
    #: The time that positions expire by; by default that of the newest candle of all symbols, so
    #: that positions of a symbol without new candles expire as well.
    now: Callable[[], datetime] | None = None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if not self.broker.connected:
            self.broker.connect()
        t = self.tables
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        candles = t.write("candles", epoch, upserted(t.before("candles", epoch, schema), batch, self.keep))
        clock = candles.groupBy("symbol").agg(F.max("time").alias("now"))

        now = self.now() if self.now else candles.agg(F.max("time")).first()[0]
        held = expired(t.before("positions", epoch, POSITIONS), now, self.cfg)
        for r in held.filter("expired").select("order_id").toLocalIterator():
            self.broker.close(r["order_id"])
        positions = held.filter("not expired").drop("expired")

        p = F.col("probabilities")
        last = live.newest(self.model(live.closed(candles)), 1)
        signals = t.write("signals", epoch, last.select("symbol", "time", trading.live_signal(p, self.cfg.confidence).alias("side"), F.array_max(p).alias("confidence"), "width"))
        state = t.before("state", epoch, STATE)
        # sent orders are what positions are made of: quotes may have changed when a batch runs again
        orders = t.once("orders", epoch, lambda: accepted(signals, state, positions, self.quotes(), clock, self.cfg))
        done = [r["order_id"] for r in orders.toLocalIterator() if self.broker.send(**r.asDict())]  # at most one for each symbol

        filled = orders.filter(F.col("order_id").isin(done)) if done else orders.limit(0)
        t.write("positions", epoch, positions.unionByName(filled.select(*positions.columns)))
        bars = signals.select("symbol", F.col("time").alias("_seen")).join(filled.select("symbol", F.col("opened").alias("_entered")), "symbol", "left")
        merged = state.join(bars, "symbol", "full").select("symbol", F.greatest("seen", "_seen").alias("seen"), F.coalesce("_entered", "entered").alias("entered"))
        t.write("state", epoch, merged)

    def start(self, candles: DataFrame, checkpoint: str, every: str | None = "5 minutes") -> StreamingQuery:
        """Every five minutes, or once through what is there if ``every`` is None."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return candles.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def keep_running(start: Callable[[], StreamingQuery], attempts: int = 10) -> int:
    """Starts the stream again after a failure, from its checkpoint; returns the failures. It gives
    up after so many in a row, none of which ended a batch; a life has any number of others."""
    failures = in_a_row = 0
    while in_a_row < attempts:
        query = start()
        try:
            query.awaitTermination()
            return failures
        except Exception:  # whatever a batch raised; it runs again
            failures += 1
            in_a_row = 1 if getattr(query, "lastProgress", None) else in_a_row + 1
            log.exception("the live stream failed and starts again")
    raise RuntimeError(f"the live stream failed {attempts} times in a row")
