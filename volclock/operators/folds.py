"""Purged walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.config import Training
from volclock.sources.stored import stored


def fold_table(rows: DataFrame, cfg: Training = Training()) -> DataFrame:
    """Per symbol and fold: test_start, test_end and train_end as row numbers. The embargo
    is clamped so that training never ends before it starts."""
    size = rows.groupBy("symbol").agg(F.count("*").alias("_n"))
    ts = F.floor(F.col("_n") / (cfg.n_splits + 1)).cast("long")
    embargo = F.greatest(F.lit(cfg.max_hold), F.floor(ts * cfg.embargo_pct))
    folds = size.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_splits - 1))))
    start = ts * (F.col("fold") + 1)
    return folds.select("symbol", "fold", start.alias("test_start"), (start + ts).alias("test_end"), F.greatest(start - embargo, F.lit(0)).alias("train_end"))


def purged_folds(rows: DataFrame, cfg: Training = Training()) -> DataFrame:
    """``rows`` (symbol, time, t1, ...) once for each fold and role (train, test) it has.

    Training rows lie before the embargo and end (t1) before the test starts. The fold table
    has a row for each symbol and fold.
    """
    rows = stored(rows, "fold-rows")  # read four times
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1)
    table = fold_table(rows, cfg)
    joined = numbered.join(table, "symbol")
    begin = numbered.select(F.col("symbol").alias("_s"), F.col("rn").alias("_rn"), F.col("time").alias("test_time"))
    bounds = table.join(begin, (F.col("symbol") == F.col("_s")) & (F.col("test_start") == F.col("_rn"))).select("symbol", "fold", "test_time")
    joined = joined.join(bounds, ["symbol", "fold"])
    test = (F.col("rn") >= F.col("test_start")) & (F.col("rn") < F.col("test_end"))
    train = (F.col("rn") < F.col("train_end")) & (F.col("t1").isNull() | (F.col("t1") < F.col("test_time")))
    return joined.withColumn("role", F.when(test, "test").when(train, "train")).filter("role is not null").select(*rows.columns, "fold", "rn", "role", "test_time")


def leakage(folds: DataFrame) -> DataFrame:
    """Per symbol and fold: training rows that end at or after the start of the test."""
    bad = (F.col("role") == "train") & (F.col("t1") >= F.col("test_time"))
    return folds.groupBy("symbol", "fold").agg(F.count_if(bad).alias("n_leaking"), F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))


def check_no_leakage(folds: DataFrame) -> None:
    if leakage(folds).filter("n_leaking > 0").limit(1).count():
        raise ValueError("training rows overlap the test period")
