"""Bars on an activity clock: a bar closes when its volume reaches a threshold.

Where a bar ends depends on where it began, so bars look sequential; but from its first row a bar's
end is found by one search in the running sum of volumes. That makes pointers from each row to the
first row of the next bar. Inside of a block they are composed by doubling, so that each row knows
how many bars follow it there and which volume is left open at the block's end. A block's first
bar may have begun before it, with any volume: its end is among the block's first rows, those that
together reach the threshold. What follows from each of these is the block's summary. Summaries are
applied in order, which gives every block the number and the volume of its open bar; then all
blocks number their rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volclock.functions import blocks


def _bar_numbers(volume: np.ndarray, threshold: float, held: float = 0, bar: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Number of each row's bar, whether the row closes it, and the volume and number of the bar
    that stays open; ``held`` and ``bar`` are those of the rows before. What exceeds the threshold
    is dropped, so each bar's end is found from its start by one search in the running sum."""
    total = np.concatenate([[0], np.cumsum(volume)])
    number = np.full(len(volume), bar, np.int64)
    closes = np.zeros(len(volume), bool)
    start = 0
    while start < len(volume):
        end = int(np.searchsorted(total, total[start] + threshold - held, "left"))
        end = max(end, start + 1)
        if end > len(volume):
            number[start:] = bar
            held += (total[-1] - total[start]).item()
            break
        number[start:end] = bar
        closes[end - 1] = True
        start, bar, held = end, bar + 1, 0
    return number, closes, held, bar


def block_summary(volume: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of a block: the running sum of the rows that may end the bar it begins in; for each of them
    the bars that follow it in the block and the volume open at its end; the volume of all rows."""
    n = len(volume)
    total = np.concatenate([[0], np.cumsum(volume)])
    after = np.maximum(np.searchsorted(total, total[:n] + threshold, "left"), np.arange(1, n + 1))
    # row n is the end; a bar that doesn't close in the block points at itself
    to = np.append(np.where(after > n, np.arange(n), after), n)
    bars = np.append((after <= n).astype(np.int64), 0)
    while True:
        further = to[to]
        if (further == to).all():
            break
        bars, to = bars + bars[to], further
    ends = min(n, int(np.searchsorted(total[1:], threshold, "left")) + 1)
    following = np.arange(1, ends + 1)
    return total[1 : ends + 1], bars[following], total[n] - total[to[following]], total[n].item()


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[object, int, int, int]]:
    """Runs of rows with the same symbol and block: symbol, block, first row and the row after."""
    block = batch.column(1).to_numpy(zero_copy_only=False)
    symbols = pc.run_end_encode(batch.column(0))
    edges = np.union1d(np.flatnonzero(np.diff(block)) + 1, np.asarray(symbols.run_ends)).tolist()
    start = 0
    for end in edges:
        yield batch.column(0)[start].as_py(), int(block[start]), start, end
        start = end


def _volumes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.nan_to_num(pc.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False))


def _open_bars(rows: DataFrame, volume: str, threshold: float) -> DataFrame:
    """symbol, _block, _held and _bar: volume and number of the bar that is open where the block begins."""
    kind, amount = (rows.schema[c].dataType.simpleString() for c in ("symbol", volume))
    amount = "double" if amount in ("double", "float") else "long"
    numbers = pa.float64() if amount == "double" else pa.int64()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            sums, bars, left, total = block_summary(np.concatenate(held), threshold)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], symbol_type), pa.array([now[1]]), *[pa.array([x.tolist()], pa.list_(t)) for x, t in ((sums, numbers), (bars, pa.int64()), (left, numbers))], pa.array([total], numbers)], ["symbol", "_block", "sums", "bars", "left", "total"])

        for batch in batches:
            symbol_type = batch.column(0).type
            for symbol, block, start, end in _keyed(batch):
                if now != (symbol, block):
                    if now:
                        yield out()
                    now, held = (symbol, block), []
                held.append(_volumes(batch, 2)[start:end])
        if now:
            yield out()

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, held, bar = object(), 0, 0
        for batch in batches:
            before: tuple[list, list] = ([], [])
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if row[0] != symbol:
                    symbol, held, bar = row[0], 0, 0
                before[0].append(held)
                before[1].append(bar)
                _, _, sums, bars, left, total = row
                at = int(np.searchsorted(np.array(sums), threshold - held, "left"))
                held, bar = (left[at], bar + 1 + bars[at]) if at < len(sums) else (held + total, bar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before[0], numbers), pa.array(before[1], pa.int64())], ["symbol", "_block", "_held", "_bar"])

    in_blocks = rows.select("symbol", "_block", volume, "_pos").repartition("symbol", "_block").sortWithinPartitions("symbol", "_block", "_pos")
    each = in_blocks.mapInArrow(summaries, f"symbol {kind}, _block long, sums array<{amount}>, bars array<long>, left array<{amount}>, total {amount}")
    in_order = each.repartition("symbol").sortWithinPartitions("symbol", "_block")
    return in_order.mapInArrow(applied, f"symbol {kind}, _block long, _held {amount}, _bar long")


def volume_bars(df: DataFrame, threshold: float = 1500, volume: str = "tick_volume", rows: int | None = None) -> DataFrame:
    """symbol, bar_id, time (of the last candle), open, high, low, close, volume, spread
    (weighed by volume) and bar_count.

    A symbol is as many tasks as it has blocks of ``rows`` rows; one task for each symbol sees one
    summary for each block, with an entry for each row of the block's first bar. A null volume
    counts 0. Sums of volumes that aren't whole numbers are rounded as blocks are cut.
    """
    names = df.columns
    cut = blocks.positioned(df).withColumn("_block", F.floor(F.col("_pos") / (rows or blocks.ROWS)))
    ready = blocks.joined(cut, _open_bars(cut, volume, threshold), "symbol", "_block")
    kept = ["symbol", "_block", *[n for n in names if n != "symbol"]]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, bar = None, 0, 0
        for batch in batches:
            volumes = _volumes(batch, kept.index(volume))
            numbers, closed = [], []
            for symbol, block, start, end in _keyed(batch):
                if now != (symbol, block):
                    now, held, bar = (symbol, block), batch.column(len(kept))[start].as_py(), batch.column(len(kept) + 1)[start].as_py()
                n, c, held, bar = _bar_numbers(volumes[start:end], threshold, held, bar)
                numbers.append(n)
                closed.append(c)
            if numbers:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate(numbers)), pa.array(np.concatenate(closed))], [*kept, "bar_id", "_closes"])

    schema = ", ".join([f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in kept] + ["bar_id long", "_closes boolean"])
    in_order = ready.repartition("symbol", "_block").sortWithinPartitions("symbol", "_block", "_pos")
    numbered = in_order.select(*kept, "_held", "_bar").mapInArrow(number, schema)
    v = F.col(volume)
    bars = numbered.groupBy("symbol", "bar_id").agg(
        F.max("time").alias("time"),
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum(v).alias("tick_volume"),
        (F.sum(F.col("spread") * v) / F.nullif(F.sum(v).cast("double"), F.lit(0.0))).alias("spread"),
        F.count("*").alias("bar_count"),
        F.max("_closes").alias("_closes"),
    )
    return bars.filter("_closes").drop("_closes")


def tick_bars(df: DataFrame, threshold: float = 1000) -> DataFrame:
    return volume_bars(df, threshold)


def suggested_threshold(df: DataFrame, target: int = 5000, volume: str = "tick_volume") -> DataFrame:
    """Per symbol: the threshold that gives about ``target`` bars."""
    return df.groupBy("symbol").agg(F.floor(F.sum(volume) / target).cast("long").alias("threshold"))
