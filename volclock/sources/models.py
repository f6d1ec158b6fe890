"""Saved models: the model itself, its feature list as JSON, and importances as CSV."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from volclock.operators.training import Trained, importances_of

LABELS = {0: "sell", 1: "hold", 2: "buy"}


@dataclass(frozen=True)
class Saved:
    """A model that was read again: what it needs, and the order of its features."""

    model: PipelineModel
    features: list[str]
    metadata: dict

    @property
    def frac_d(self) -> float:
        return float(self.metadata.get("frac_d", 0.15))


def feature_spec(name: str, features: list[str], metadata: dict) -> dict:
    """What a consumer of the model must know; of the metadata only single values."""
    plain = {k: v for k, v in metadata.items() if isinstance(v, str | int | float | bool)}
    return {"model_name": name, "feature_names": features, "n_features": len(features), "n_classes": len(LABELS), "class_labels": LABELS, "pipeline_metadata": plain}


def export_model(spark: SparkSession, trained: Trained, folder: str, metadata: dict, name: str = "model") -> dict[str, str]:
    """Write the model, its specification and its importances below ``folder`` (any file
    system that Spark can write to); returns their paths. A former export is replaced."""
    paths = {kind: f"{folder.rstrip('/')}/{name}{end}" for kind, end in {"model": "", "feature_spec": "_feature_spec", "importances": "_importances"}.items()}
    trained.model.write().overwrite().save(paths["model"])
    text = json.dumps(feature_spec(name, trained.features, metadata))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(paths["feature_spec"])
    pairs = sorted(importances_of(trained.model, trained.features), key=lambda p: (-p[1], p[0]))
    spark.createDataFrame(pairs, "feature string, importance double").coalesce(1).write.mode("overwrite").option("header", True).csv(paths["importances"])
    return paths


def load_model(spark: SparkSession, folder: str, name: str = "model") -> Saved:
    """Read what :func:`export_model` wrote."""
    path = f"{folder.rstrip('/')}/{name}"
    spec = json.loads(spark.read.text(f"{path}_feature_spec").first()["value"])
    return Saved(PipelineModel.load(path), spec["feature_names"], spec["pipeline_metadata"])
