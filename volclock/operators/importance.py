"""Importance of a feature: what accuracy is lost where its values are exchanged among the rows.

All features of all folds are one job. Rows of a fold are numbered in a seeded order, and the value a
row gets for a feature is that of the row so many places on, another number of places for each
feature. So values move by one shuffle of (fold, number), whose keys are all of one size, and no
fold is sorted as a whole: rows are counted in 4,096 buckets of their hash first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volclock.config import Training
from volclock.operators import folds as cv
from volclock.operators.training import Trees, fitted, predict
from volclock.sources.stored import stored


def in_random_order(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``rows`` (fold, symbol, time, ...) with ``_rank``, from 0, and the fold's size ``_n``. The order is that of
    a hash of seed, symbol and time; rows equal in these have any order among themselves."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", F.unix_micros(F.col("time").cast("timestamp"))))
    rows = rows.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    each = rows.groupBy("fold", "_bucket").agg(F.count("*").alias("_rows"))
    fold = Window.partitionBy("fold")
    before = F.sum("_rows").over(fold.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("fold", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(fold).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("fold", "_bucket").orderBy("_key"))
    return rows.join(each, ["fold", "_bucket"]).withColumn("_rank", F.col("_before") + inside - 1).drop("_key", "_bucket", "_before")


def permuted(rows: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """``rows`` once as they are (``permuted`` is null) and once for each feature, named in ``permuted``, whose
    values are those of other rows of the fold. A fold of one row keeps its values."""
    rows = stored(in_random_order(rows, seed), "ranked")
    places = lambda i: F.greatest(F.lit(1), F.floor(F.col("_n") * (i + 1) / (len(names) + 1)))
    given = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.pmod(F.col("_rank") - places(i), "_n").alias("to")) for i, f in enumerate(names)])
    values = rows.select("fold", F.explode(given).alias("_g")).groupBy("fold", F.col("_g.to").alias("_rank"))
    values = values.agg(*[F.max(F.when(F.col("_g.feature") == f, F.col("_g.value"))).alias(f"_given_{i}") for i, f in enumerate(names)])
    every = rows.join(values, ["fold", "_rank"]).withColumn("permuted", F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in names])))
    every = every.withColumns({f: F.when(F.col("permuted") == f, F.col(f"_given_{i}")).otherwise(F.col(f)) for i, f in enumerate(names)})
    return every.drop("_rank", "_n", *[f"_given_{i}" for i in range(len(names))])


def lost_accuracy(scored: DataFrame) -> DataFrame:
    """fold, feature, accuracy without its values, and what that is below the accuracy with all.

    ``scored`` holds rows of :func:`permuted` with class and class_predicted."""
    right = F.avg((F.col("class") == F.col("class_predicted")).cast("double"))
    each = scored.groupBy("fold", "permuted").agg(right.alias("accuracy"))
    whole = each.filter("permuted is null").select("fold", F.col("accuracy").alias("_whole"))
    return each.filter("permuted is not null").join(whole, "fold").select("fold", F.col("permuted").alias("feature"), "accuracy", (F.col("_whole") - F.col("accuracy")).alias("importance"))


def permutation_importance(rows: DataFrame, names: list[str], trees: Trees = Trees(), cfg: Training = Training(), seed: int = 42) -> DataFrame:
    """fold, feature, accuracy and importance of a model of each fold, on the fold's test rows.

    ``rows`` come from ``aligned_rows``. Folds without rows to train on or to test are left out.
    """
    parts = stored(cv.purged_folds(rows, cfg), "folds")
    cv.check_no_leakage(parts)
    sizes = {(r["fold"], r["role"]) for r in parts.select("fold", "role").distinct().collect()}
    whole = [k for k in range(cfg.n_splits) if {(k, "train"), (k, "test")} <= sizes]
    if not whole:
        raise ValueError("no fold has rows to train on and to test")
    test = stored(permuted(parts.filter("role = 'test'").select("fold", "symbol", "time", "class", *names), names, seed), "permuted")
    scored = None
    for k in whole:
        of_fold = predict(fitted(parts.filter((F.col("fold") == k) & (F.col("role") == "train")), names, trees), test.filter(F.col("fold") == k))
        of_fold = of_fold.select("fold", "permuted", "class", "class_predicted")
        scored = of_fold if scored is None else scored.unionByName(of_fold)
    return lost_accuracy(scored)
