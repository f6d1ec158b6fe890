"""Training of three-class models over purged folds, and the search for their settings.

Spark's tree ensembles train on the executors; the driver only walks through folds and trials.
A forest knows three classes by itself. Boosted trees are binary, so there is one model for
each class, whose probabilities are scaled to add up to 1.
"""

from __future__ import annotations

import logging
import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volclock.config import Costs, Labels, Training
from volclock.operators import folds as cv
from volclock.operators import trading
from volclock.operators.labels import closes_of, distribution, forward_paths, labels_of
from volclock.operators.weights import sample_weights
from volclock.sources.stored import stored

CLASSES = (0, 1, 2)
#: The score of a trial that can't be judged.
REJECTED = -999.0

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Trees:
    """Settings of the ensemble. ``boosted`` chooses boosting instead of a forest."""

    boosted: bool = False
    n_trees: int = 100
    learning_rate: float = 0.0258
    max_depth: int = 4
    min_rows: int = 250
    subsample: float = 0.72
    columns: float = 0.72
    seed: int = 42


@dataclass
class Trained:
    """A model of all rows, and what its folds have shown.

    ``fold_metrics`` (fold, metric, value), ``importances`` (feature, fold, importance) and
    ``predictions`` (test rows of all folds) are DataFrames.
    """

    model: PipelineModel
    features: list[str]
    fold_metrics: DataFrame
    importances: DataFrame
    predictions: DataFrame
    settings: Trees
    barriers: Labels | None = None
    average: dict[str, float] = field(default_factory=dict)

    def summary(self) -> str:
        lines = [f"{name:35s} {value:12.4f}" for name, value in sorted(self.average.items())]
        return "\n".join(lines) if lines else "no metrics"


def aligned_rows(features: DataFrame, labels: DataFrame, weights: DataFrame | None, names: list[str]) -> DataFrame:
    """Rows that have both features and a label, with class (0, 1, 2) and weight (1 if
    unknown)."""
    rows = features.select("symbol", "time", *names).join(labels.dropna(subset=["label"]), ["symbol", "time"])
    if weights is not None:
        rows = rows.join(weights.select("symbol", "time", "weight"), ["symbol", "time"], "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    return rows.withColumns({"class": (F.col("label") + 1).cast("double"), "weight": F.coalesce("weight", F.lit(1.0))})


def fitted(rows: DataFrame, names: list[str], trees: Trees = Trees()) -> PipelineModel:
    """A model of ``rows`` (the features ``names``, class, weight)."""
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    vectors = assembler.transform(rows).select("features", "class", "weight")
    common = {"featuresCol": "features", "weightCol": "weight", "maxDepth": trees.max_depth, "minInstancesPerNode": trees.min_rows, "subsamplingRate": trees.subsample, "seed": trees.seed}
    common["featureSubsetStrategy"] = str(trees.columns) if trees.columns < 1 else "all"
    if not trees.boosted:
        forest = RandomForestClassifier(labelCol="class", numTrees=trees.n_trees, probabilityCol="probability", **common)
        return PipelineModel([assembler, forest.fit(vectors)])
    stages = [assembler]
    for k in CLASSES:
        boosting = GBTClassifier(labelCol="_is", maxIter=trees.n_trees, stepSize=trees.learning_rate, predictionCol=f"_prediction{k}", **common)
        boosting.setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_probability{k}")
        stages.append(boosting.fit(vectors.withColumn("_is", (F.col("class") == k).cast("double"))))
    return PipelineModel(stages)


def first_largest(probabilities: Column) -> Column:
    """The class of the largest probability, of several the first."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with probabilities (an array of three) and class_predicted."""
    scored, keep = model.transform(rows), rows.columns
    if "probability" in scored.columns:
        # a forest that never saw the last classes has a shorter vector
        p = vector_to_array("probability")
        p = F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda k: F.coalesce(F.get(p, k), F.lit(0.0)))
    else:
        each = [vector_to_array(f"_probability{k}")[1] for k in CLASSES]
        total = F.nullif(each[0] + each[1] + each[2], F.lit(0.0))
        p = F.array(*[F.coalesce(x / total, F.lit(1.0 / len(CLASSES))) for x in each])
    scored = scored.select(*keep, p.alias("probabilities"))
    return scored.withColumn("class_predicted", first_largest(F.col("probabilities")))


def importances_of(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """The importance of each feature; boosted models of three classes are averaged."""
    trees = model.stages[1:]
    return [(name, float(sum(t.featureImportances[i] for t in trees) / len(trees))) for i, name in enumerate(names)]


def judged(predictions: DataFrame, cfg: Training, costs: Costs, threshold: float | None) -> dict[str, float]:
    """Metrics of test rows with probabilities and class_predicted, as means over symbols."""
    said = F.col("class_predicted")
    after = trading.confident(F.col("probabilities"), said, threshold) if threshold is not None else said
    rows = predictions.withColumn("predicted", (after - 1).cast("int"))
    report = trading.confidence_report(predictions.withColumn("predicted", said), threshold if threshold is not None else 0.0).select("symbol", "filtered_pct")
    done = trading.with_pnl(trading.simulated(rows.select("symbol", "time", "label", "predicted", "t1", "holding_period", "ret_pips"), cfg)).persist()
    tables = [trading.classification_metrics(done), trading.trading_metrics(done, costs), trading.daily_sharpe(done, costs), trading.drawdown(done), report]
    long = None
    for t in tables:
        metrics = [c for c in t.columns if c != "symbol"]
        one = t.select("symbol", *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot("symbol", metrics, "metric", "value")
        long = one if long is None else long.unionByName(one)
    try:
        return {r["metric"]: r["value"] for r in long.filter("value is not null").groupBy("metric").agg(F.avg("value").alias("value")).collect()}
    finally:
        done.unpersist()


def train(rows: DataFrame, names: list[str], trees: Trees = Trees(), cfg: Training = Training(), costs: Costs = Costs()) -> Trained:
    """Fit and judge a model for each fold, then one of all rows.

    ``rows`` come from :func:`aligned_rows`. Folds without training or test rows are left
    out. Metrics of a fold are the means over its symbols. The rows are kept in memory or on
    the executors' disks while the folds are walked through.
    """
    spark = rows.sparkSession
    parts = cv.purged_folds(rows, cfg).persist()
    try:
        cv.check_no_leakage(parts)
        sizes = {(r["fold"], r["role"]) for r in parts.select("fold", "role").distinct().collect()}
        metrics, importances, predictions = [], [], None
        for fold in range(cfg.n_splits):
            if not {(fold, "train"), (fold, "test")} <= sizes:
                log.warning("fold %d has no rows to train on or to test", fold)
                continue
            of_fold = parts.filter(F.col("fold") == fold)
            model = fitted(of_fold.filter("role = 'train'"), names, trees)
            test = predict(model, of_fold.filter("role = 'test'"))
            test = test.select("symbol", "time", "fold", "label", "t1", "ret_pips", "holding_period", "class_predicted", "probabilities")
            metrics += [(fold, metric, value) for metric, value in judged(test, cfg, costs, cfg.confidence).items()]
            importances += [(name, fold, value) for name, value in importances_of(model, names)]
            predictions = test if predictions is None else predictions.unionByName(test)
        if predictions is None:
            raise ValueError("no fold has rows to train on and to test")
        final = fitted(rows, names, trees)
    finally:
        parts.unpersist()
    by_fold = spark.createDataFrame(metrics, "fold int, metric string, value double")
    first = min(fold for fold, _, _ in metrics)
    kept = {m for fold, m, _ in metrics if fold == first}
    average = {m: sum(v for _, n, v in metrics if n == m) / sum(1 for _, n, _ in metrics if n == m) for m in kept}
    return Trained(final, names, by_fold, spark.createDataFrame(importances, "feature string, fold int, importance double"), predictions, trees, average=average)


def ranked(importances: DataFrame) -> DataFrame:
    """feature and its mean importance over folds, the largest first."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("mean")).orderBy(F.desc("mean"), "feature")


def sampled_trees(rng: random.Random, base: Trees) -> Trees:
    """Settings drawn from fixed ranges; rates and sizes by their logarithm."""
    return replace(
        base,
        n_trees=rng.randrange(100, 1001, 50),
        learning_rate=math.exp(rng.uniform(math.log(0.01), math.log(0.2))),
        max_depth=rng.randint(3, 10),
        min_rows=rng.randint(20, 200),
        subsample=rng.uniform(0.5, 1.0),
        columns=rng.uniform(0.5, 1.0),
    )


def sampled_barriers(rng: random.Random, base: Labels) -> Labels:
    """Barriers drawn from fixed grids."""
    return replace(
        base,
        pt=rng.randint(1, 15) / 10,
        sl=rng.randint(1, 15) / 10,
        vol_lookback=rng.randrange(24, 289, 24),
        max_hold=rng.randrange(24, 49, 12),
        min_hold=rng.randrange(6, 19, 6),
    )


def score(average: dict[str, float]) -> float:
    """Yearly Sharpe ratio, lowered for losses and for weak wins; few trades are rejected."""
    sharpe = average.get("sharpe_ratio", 0.0)
    if average.get("n_trades", 0.0) < 100:
        return REJECTED
    if average.get("total_pnl_after_costs_pips", REJECTED) <= 0:
        return sharpe - 10.0
    if average.get("profit_factor", 0.0) < 1.05 or average.get("win_rate", 0.0) < 0.45:
        return sharpe - 5.0
    return sharpe


def joint_trees(rng: random.Random, base: Trees) -> Trees:
    """Settings drawn for the joint search. A tree of so many leaves needs no more levels than its
    logarithm, which bounds the depth; Spark's trees have no penalties on leaf values."""
    leaves = rng.randint(15, 63)
    return replace(
        base,
        n_trees=rng.randrange(100, 801, 100),
        learning_rate=math.exp(rng.uniform(math.log(0.01), math.log(0.1))),
        max_depth=min(rng.randint(3, 8), math.ceil(math.log2(leaves))),
        min_rows=rng.randint(50, 300),
        subsample=rng.uniform(0.6, 0.9),
        columns=rng.uniform(0.6, 0.9),
    )


def _search(trials: list, run: Callable[[object], float], seconds: float, parallel: int = 1) -> object:
    """The trial of the best score, of several the first. ``parallel`` trials submit their jobs at a
    time. A trial that fails is rejected and told in the log; none but the first starts after
    ``seconds``."""
    began = time.monotonic()

    def one(place: int) -> float | None:
        if place and time.monotonic() - began > seconds:
            return None
        try:
            return run(trials[place])
        except ValueError as why:
            log.warning("trial %s failed: %s", trials[place], why)
            return REJECTED

    with ThreadPoolExecutor(parallel) as pool:
        scores = list(pool.map(one, range(len(trials))))
    return trials[max((i for i, s in enumerate(scores) if s is not None), key=lambda i: (scores[i], -i))]


def tune(
    rows: DataFrame, names: list[str], n_trials: int = 80, seconds: float = 7200, base: Trees = Trees(), cfg: Training = Training(), costs: Costs = Costs(),
    sample: Callable[[random.Random, Trees], Trees] = sampled_trees, parallel: int = 1,
) -> Trained:
    """Random search for the settings of the best mean result a trade, then training with them."""
    rng = random.Random(cfg.seed)
    trials = [sample(rng, base) for _ in range(n_trials)]
    best = _search(trials, lambda t: train(rows, names, t, cfg, costs).average.get("expected_return_pips", REJECTED), seconds, parallel)
    return train(rows, names, best, cfg, costs)


def labelled_rows(features: DataFrame, paths: DataFrame, names: list[str], barriers: Labels, pip: float) -> DataFrame:
    """Rows to train on, with the labels of one setting of ``forward_paths``."""
    found = labels_of(paths, barriers, pip).dropna(subset=["label"])
    return aligned_rows(features, found.drop("close"), sample_weights(found.select("symbol", "time", "t1")), names)


def tune_jointly(
    features: DataFrame, prices: DataFrame, names: list[str], n_trials: int = 100, seconds: float = math.inf, base: Trees = Trees(), barriers: Labels = Labels(),
    cfg: Training = Training(), costs: Costs = Costs(), least: int = 100, sample: Callable[[random.Random, Trees], Trees] = joint_trees, parallel: int = 1,
) -> Trained:
    """Random search over barriers and model. The forward paths of all trials are written once in the
    shared folder; each trial reads its labels off them, row by row.

    Trials whose labels lack a class, or have one with fewer than ``least`` rows, are rejected.
    """
    rng = random.Random(cfg.seed)
    trials = [(sampled_barriers(rng, barriers), sample(rng, base)) for _ in range(n_trials)]
    paths = stored(forward_paths(closes_of(prices, features), [b for b, _ in trials]), "paths")

    def run(trial: tuple[Labels, Trees]) -> float:
        rows = labelled_rows(features, paths, names, trial[0], costs.pip_value).persist()
        try:
            counts = [r["n"] for r in distribution(rows, "label").collect()]
            if len(counts) < len(CLASSES) or min(counts) < least:
                return REJECTED
            return score(train(rows, names, trial[1], cfg, costs).average)
        finally:
            rows.unpersist()

    best_barriers, best_trees = _search(trials, run, seconds, parallel)
    rows = labelled_rows(features, paths, names, best_barriers, costs.pip_value)
    return replace(train(rows, names, best_trees, cfg, costs), barriers=best_barriers)
