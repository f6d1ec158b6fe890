"""Confidence filter, trade simulation, and metrics of classification and trading."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volclock.config import Costs, Training
from volclock.functions import blocks
from volclock.sources.stored import stored


def confident(probabilities: Column, predicted: Column, threshold: float = 0.55) -> Column:
    """Classes 0 and 2 become 1 (no trade) if the largest probability is below the threshold."""
    return F.when(predicted.isin(0, 2) & (F.array_max(probabilities) < threshold), 1).otherwise(predicted)


def confidence_report(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """From symbol, probabilities, predicted: trades before and after, and per cent removed."""
    after = confident(F.col("probabilities"), F.col("predicted"), threshold)
    agg = df.groupBy("symbol").agg(F.count_if(F.col("predicted") != 1).alias("before"), F.count_if(after != 1).alias("after"))
    return agg.withColumn("filtered_pct", F.coalesce(100 * (F.col("before") - F.col("after")) / F.nullif(F.col("before").cast("double"), F.lit(0.0)), F.lit(0.0)))


def position_size(probability: Column) -> Column:
    return F.when(probability >= 0.75, 1.0).when(probability >= 0.60, 0.5).when(probability >= 0.45, 0.25).otherwise(0.0)


def lot_size(probability: Column) -> Column:
    return F.when(probability >= 0.75, 4.0).when(probability >= 0.60, 2.0).when(probability >= 0.45, 1.0).otherwise(0.5)


def live_signal(probabilities: Column, threshold: float = 0.55) -> Column:
    """1 or -1 if class 2 or 0 is the first of the largest and lies strictly above the threshold."""
    best = F.array_max(probabilities)
    first = F.array_position(probabilities, best)
    return F.when((best > threshold) & (first != 2), F.when(first == 3, 1).otherwise(-1)).otherwise(0)


#: Points that the price of a market order may move.
DEVIATION = 20


def fill_mode(mask: Column) -> Column:
    """From the bits of what a symbol allows: 1 fill or kill, 2 immediate or cancel."""
    bit = lambda n: F.coalesce(mask.bitwiseAND(F.lit(n)) != 0, F.lit(False))
    return F.when(bit(1), "fok").when(bit(2), "ioc").otherwise("return")


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per symbol: rows, and rows in which any of ``columns`` is null."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("n_null_rows"))


def class_report(df: DataFrame, classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """symbol, class, precision, recall, f1, support; 0 where nothing was predicted or true."""
    y, p = F.col("label"), F.col("predicted")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (p == k).alias("said"), (y == k).alias("true")) for k in classes])).alias("c")
    n = df.select("symbol", each).select("symbol", "c.*").groupBy("symbol", "class").agg(F.count_if(F.col("said") & F.col("true")).alias("hit"), F.count_if("said").alias("said"), F.count_if("true").alias("support"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    hit, said, true = F.col("hit"), F.col("said"), F.col("support")
    return n.select("symbol", "class", ratio(hit, said).alias("precision"), ratio(hit, true).alias("recall"), ratio(2 * hit, said + true).alias("f1"), "support")


def report_text(report: DataFrame) -> str:
    """``class_report`` as text; a few rows for each symbol."""
    lines = [f"{'symbol':<12}{'class':>6}{'precision':>11}{'recall':>9}{'f1':>9}{'support':>9}"]
    for r in report.orderBy("symbol", "class").toLocalIterator():
        lines.append(f"{r['symbol']:<12}{r['class']:>6}{r['precision']:>11.4f}{r['recall']:>9.4f}{r['f1']:>9.4f}{r['support']:>9}")
    return "\n".join(lines)


def pip_size(symbol: Column) -> Column:
    return F.when(F.contains(symbol, F.lit("JPY")), 0.01).otherwise(0.0001)


def exit_prices(side: Column, bid: Column, ask: Column, width: Column, pt: float = 0.70, sl: float = 0.40, digits: int = 5) -> tuple[Column, Column]:
    """Take-profit and stop-loss prices of a trade (side 1 buys at ask, -1 sells at bid)."""
    entry = F.when(side > 0, ask).otherwise(bid)
    return F.bround(entry + side * pt * width, digits), F.bround(entry - side * sl * width, digits)


def segments(df: DataFrame, cfg: Training = Training(), rows: int | None = None) -> DataFrame:
    """``df`` with ``_segment``: pieces of a symbol that can be simulated by themselves.

    Where every trade that may have been opened has ended and the pause since the last signal is
    over, the simulator holds nothing, whatever it took before. The first such row of each block
    begins a segment, so that segments are about as long as blocks; a block without one goes on
    with the segment before. Which signals are taken plays no part, so no row waits for another.
    Rows are written once in the shared folder, as summaries of blocks are taken from them twice.
    """
    kept = "_pos" in df.columns
    cut = stored(blocks.positioned(df), "simulated").withColumn("_block", F.floor(F.col("_pos") / (rows or blocks.ROWS)))
    signal, now = F.col("predicted") != 0, F.unix_micros(F.col("time").cast("timestamp"))
    end = F.coalesce(F.unix_micros(F.col("t1").cast("timestamp")), now + F.coalesce(F.col("holding_period"), F.lit(0)) * cfg.bar_minutes * 60_000_000)
    busy = F.when(signal, F.greatest(end, now + cfg.cooldown_minutes * 60_000_000))
    cut = blocks.carried(cut.withColumn("_busy", busy), "_block", _until=(F.max("_busy"), F.max))
    inside = Window.partitionBy("symbol", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    until = F.greatest("_until", F.max("_busy").over(inside))
    cut = cut.withColumn("_free", F.when(until.isNull() | (until <= now), F.col("_pos")))
    whole = Window.partitionBy("symbol", "_block")
    cut = cut.withColumn("_first", F.min("_free").over(whole))
    cut = blocks.carried(cut, "_block", _began=(F.min("_free"), F.max))
    segment = F.coalesce(F.when(F.col("_pos") >= F.col("_first"), F.col("_first")), "_began", F.lit(0))
    return cut.withColumn("_segment", segment).drop("_block", "_busy", "_until", "_free", "_first", "_began", *([] if kept else ["_pos"]))


def simulated(df: DataFrame, cfg: Training = Training(), rows: int | None = None) -> DataFrame:
    """``df`` (symbol, time, predicted, t1, holding_period, ...) with traded.

    A signal is taken if fewer than the most allowed trades are open and the last entry lies
    at least the cooldown back. This is sequential within a segment only; a symbol that never
    rests is one segment.
    """
    most, pause, bar = cfg.max_open_trades, pd.Timedelta(minutes=cfg.cooldown_minutes), pd.Timedelta(minutes=cfg.bar_minutes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        held, last, taken = [], None, []
        for now, signal, t1, n in zip(pdf["time"], pdf["predicted"], pdf["t1"], pdf["holding_period"], strict=True):
            held = [x for x in held if x > now]
            take = bool(signal != 0 and len(held) < most and (last is None or now - last >= pause))
            if take:
                last = now
                held.append(t1 if pd.notna(t1) else now + (0 if pd.isna(n) else n) * bar)
            taken.append(take)
        pdf["traded"] = taken
        return pdf

    cut = segments(df, cfg, rows)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields] + ["traded boolean"])
    return cut.groupBy("symbol", "_segment").applyInPandas(run, schema).drop("_segment")


def with_pnl(df: DataFrame) -> DataFrame:
    pips = F.coalesce("ret_pips", F.lit(0.0))
    return df.withColumn("pnl", F.when(F.col("traded"), F.sign("predicted") * pips).otherwise(0.0))


def trading_metrics(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per symbol, from traded, predicted, pnl and holding_period."""
    t, p = F.col("traded"), F.col("pnl")
    won, lost = t & (p > 0), t & (p < 0)
    base = df.groupBy("symbol").agg(
        F.count_if(t).alias("n_trades"),
        F.count_if(F.col("predicted") != 0).alias("n_signals"),
        F.coalesce(F.sum(F.when(t, p)), F.lit(0.0)).alias("total_pnl_pips"),
        F.count_if(won).alias("_wins"),
        F.coalesce(F.avg(F.when(won, p)), F.lit(0.0)).alias("avg_win_pips"),
        F.coalesce(F.avg(F.when(lost, p)), F.lit(0.0)).alias("avg_loss_pips"),
        F.coalesce(F.sum(F.when(won, p)), F.lit(0.0)).alias("_gain"),
        F.coalesce(F.abs(F.sum(F.when(lost, p))), F.lit(0.0)).alias("_loss"),
        F.coalesce(F.avg(F.when(t, F.coalesce(F.col("holding_period").cast("double"), F.lit(0.0)))), F.lit(0.0)).alias("avg_holding_period"),
    )
    n = F.nullif(F.col("n_trades").cast("double"), F.lit(0.0))
    mean = F.coalesce(F.col("total_pnl_pips") / n, F.lit(0.0))
    return base.select(
        "symbol", "n_trades",
        F.coalesce((F.col("n_signals") - F.col("n_trades")) / F.nullif(F.col("n_signals").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("signals_filtered"),
        mean.alias("expected_return_pips"),
        F.when(F.col("n_trades") > 0, mean - costs.total).otherwise(0.0).alias("expected_return_after_costs_pips"),
        "total_pnl_pips",
        (F.col("total_pnl_pips") - F.col("n_trades") * costs.total).alias("total_pnl_after_costs_pips"),
        F.coalesce(F.col("_wins") / n, F.lit(0.0)).alias("win_rate"),
        "avg_win_pips", "avg_loss_pips",
        F.when(F.col("n_trades") == 0, 0.0).when(F.col("_loss") > 0, F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        "avg_holding_period",
        F.when(F.col("n_trades") > 0, costs.total).alias("total_cost_per_trade_pips"),
        F.when(F.col("n_trades") > 0, F.coalesce(costs.total / F.nullif(F.abs(mean), F.lit(0.0)), F.lit(float("inf")))).alias("cost_as_pct_of_avg_return"),
    )


def business_day(time: Column) -> Column:
    """Saturday and Sunday belong to the Friday before."""
    return F.date_sub(F.to_date(time), F.greatest(F.weekday(time) - 4, F.lit(0)))


def daily_sharpe(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per symbol: net result of business days (days without rows count 0), by the year."""
    net = F.col("pnl") - F.when(F.col("traded"), costs.total).otherwise(0.0)
    daily = df.groupBy("symbol", business_day(F.col("time")).alias("day")).agg(F.sum(net).alias("net"))
    span = daily.groupBy("symbol").agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = span.select("symbol", F.explode(F.sequence("_a", "_b")).alias("day")).filter(F.weekday("day") < 5)
    whole = days.join(daily, ["symbol", "day"], "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    out = whole.groupBy("symbol").agg(F.avg("net").alias("_m"), F.stddev_samp("net").alias("_s"), F.count("*").alias("n_days"))
    return out.select("symbol", "n_days", F.when(F.col("_s") > 0, F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0)) * math.sqrt(250)).otherwise(0.0).alias("sharpe_ratio"))


def drawdown(df: DataFrame) -> DataFrame:
    """Per symbol: the deepest fall of the running result below its peak so far."""
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum("pnl").over(w))
    df = df.withColumn("_down", F.col("_sum") - F.max("_sum").over(w))
    return df.groupBy("symbol").agg(F.min("_down").alias("max_drawdown_pips"))


def classification_metrics(df: DataFrame, classes: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """Per symbol: accuracy, weighted F1, precision, recall and share of each class, in one
    pass; precision and recall are null for classes that don't occur."""
    y, p = F.col("label"), F.col("predicted")
    sums = [F.count("*").alias("n"), F.avg((y == p).cast("double")).alias("accuracy")]
    for i, k in enumerate(classes):
        sums += [F.count_if((y == k) & (p == k)).alias(f"_hit{i}"), F.count_if(y == k).alias(f"_true{i}"), F.count_if(p == k).alias(f"_said{i}")]
    out = df.groupBy("symbol").agg(*sums)
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    names = {-1: "sell", 0: "hold", 1: "buy"}
    columns, f1 = [], F.lit(0.0)
    for i, k in enumerate(classes):
        name, there = names.get(k, f"class{k}"), F.col(f"_true{i}") > 0
        columns += [F.when(there, ratio(f"_hit{i}", f"_said{i}")).alias(f"precision_{name}"), F.when(there, ratio(f"_hit{i}", f"_true{i}")).alias(f"recall_{name}"), (F.col(f"_said{i}") / F.col("n")).alias(f"share_{name}")]
        both = F.col(f"_true{i}") + F.col(f"_said{i}")
        f1 = f1 + F.coalesce(2.0 * F.col(f"_hit{i}") / F.nullif(both.cast("double"), F.lit(0.0)), F.lit(0.0)) * F.col(f"_true{i}")
    return out.select("symbol", "n", "accuracy", (f1 / F.col("n")).alias("f1_weighted"), *columns)


def averaged(fold_metrics: DataFrame) -> DataFrame:
    """(fold, metric, value): mean and population deviation of the metrics of the first fold."""
    first = fold_metrics.filter("fold = 0").select("metric").distinct()
    return fold_metrics.join(first, "metric", "left_semi").groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
