"""The live loop as Structured Streaming: candles come in, gates decide, orders go out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from volclock.config import Training


def latest_versions(df: DataFrame, version: str) -> DataFrame:
    """One row for each (symbol, time): the one with the largest version."""
    rows = df.groupBy("symbol", "time").agg(F.max_by(F.struct(*df.columns), version).alias("_r"))
    return rows.select("_r.*")


def newest(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("time"))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def closed(df: DataFrame) -> DataFrame:
    """Without the newest candle of each symbol, which is still open."""
    last = df.groupBy("symbol").agg(F.max("time").alias("_last"))
    return df.join(last, "symbol").filter(F.col("time") < F.col("_last")).drop("_last")


def tradable(bid: Column, ask: Column, pip: Column, most: float = 1.5) -> Column:
    return (ask - bid) / pip <= most


def streamed_candles(ticks: DataFrame, minutes: int = 5, lateness: str = "50 minutes") -> DataFrame:
    """Candles of a stream (symbol, time, price), each once the watermark has passed its end."""
    return (
        ticks.withWatermark("time", lateness)
        .groupBy("symbol", F.window("time", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", "time").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "time").alias("close"), F.count("*").alias("tick_volume"))
        .select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "tick_volume")
    )


def streamed_bars(candles: DataFrame, threshold: float = 1500) -> DataFrame:
    """Volume bars of a stream of candles. The unfinished bar is the state, so that bars don't
    depend on where a batch begins."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, volume, first, high, low = state.get if state.exists else (0, 0, 0.0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values("time", kind="stable").itertuples(index=False):
            first, high, low = (r.open, r.high, r.low) if n == 0 else (first, max(high, r.high), min(low, r.low))
            n, volume = n + 1, volume + int(r.tick_volume)
            if volume >= threshold:
                out.append((key[0], r.time, first, high, low, r.close, volume, n))
                n = volume = 0
        state.update((n, volume, float(first), float(high), float(low)))
        yield pd.DataFrame(out, columns=["symbol", "time", "open", "high", "low", "close", "tick_volume", "bar_count"])

    return candles.groupBy("symbol").applyInPandasWithState(
        run,
        "symbol string, time timestamp, open double, high double, low double, close double, tick_volume long, bar_count long",
        "n long, volume long, first double, high double, low double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def gated_signals(signals: DataFrame, cfg: Training = Training()) -> DataFrame:
    """Accepted signals of a stream (symbol, time, signal).

    The state of a symbol holds the time of the last bar seen, of the last entry, and the ends
    of open trades (their holding limit), in microseconds. The first bar of a symbol only starts the state; older
    bars than the last one are stale.
    """
    pause, longest = cfg.cooldown_minutes * 60_000_000, cfg.max_hold * cfg.bar_minutes * 60_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, entered, ends = state.get if state.exists else (None, None, [])
        ends, out = list(ends), []
        for r in pd.concat(list(batches)).sort_values("time", kind="stable").itertuples(index=False):
            now = r.time.value // 1000
            started, fresh = seen is not None, seen is None or now > seen
            seen = now if fresh else seen
            ends = [e for e in ends if e >= now]
            if started and fresh and r.signal != 0 and len(ends) < cfg.max_open_trades and (entered is None or now - entered >= pause):
                entered = now
                ends.append(now + longest)
                out.append((key[0], r.time, int(r.signal)))
        state.update((seen, entered, ends))
        yield pd.DataFrame(out, columns=["symbol", "time", "signal"])

    return signals.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, time timestamp, signal int", "seen long, entered long, ends array<long>", "append", GroupStateTimeout.NoTimeout
    )


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The newest quote (bid, ask, ...) of each symbol."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct(*[n for n in quotes.columns if n != "symbol"]), "time").alias("_q")).select("symbol", "_q.*")


class SimulatedBroker:
    """Keeps orders by an idempotent id, so that a batch that runs again changes nothing."""

    def __init__(self) -> None:
        self.orders: dict[str, dict] = {}
        self.connected = False

    def connect(self) -> None:
        self.connected = True

    def disconnect(self) -> None:
        self.connected = False

    def send(self, order_id: str, **order) -> bool:
        """Whether the order is held, now or from an earlier run."""
        self.orders.setdefault(order_id, order)
        return True

    def open_positions(self, now, longest_minutes: float | None = None) -> list[str]:
        late = lambda o: longest_minutes is not None and (now - o["time"]).total_seconds() > longest_minutes * 60
        return [k for k, o in self.orders.items() if not o.get("closed") and (longest_minutes is None or late(o))]

    def close(self, order_id: str) -> bool:
        found = order_id in self.orders and not self.orders[order_id].get("closed")
        if found:
            self.orders[order_id]["closed"] = True
        return found


def order_sink(broker: SimulatedBroker) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: accepted signals, of which a batch has a few for each symbol."""

    def send(batch: DataFrame, epoch: int) -> None:
        for r in batch.toLocalIterator():
            broker.send(f"{r['symbol']}-{r['time'].isoformat()}", symbol=r["symbol"], time=r["time"], side=r["signal"])

    return send
