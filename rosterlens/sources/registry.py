"""Fitted models on shared storage, found again by their names.

A model directory is an ordinary saved ``PipelineModel`` with one extra sub-folder, ``card``, that
holds the feature lists and the decision threshold as JSON.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..schema import DEFAULT_THRESHOLD, FeatureSpec

# fixed values: name prefixes, the preferred kind of score model first
CLASSIFIER_PREFIX = "logreg_"
SCORE_PREFIXES = ("xgbreg_", "rfreg_", "linreg_")


@dataclass(frozen=True)
class StoredModel:
    name: str
    model: PipelineModel
    features: FeatureSpec
    threshold: float = DEFAULT_THRESHOLD


def save_model(
    model: PipelineModel,
    models_dir: str,
    name: str,
    features: FeatureSpec,
    threshold: float = DEFAULT_THRESHOLD,
) -> str:
    if not name.startswith((CLASSIFIER_PREFIX, *SCORE_PREFIXES)):
        raise ValueError(f"model name {name!r} has none of the known prefixes")
    path = f"{models_dir.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    card = json.dumps({"features": features.to_json(), "threshold": threshold})
    spark.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/card"
    )
    return path


def _names(spark: SparkSession, models_dir: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(models_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def load_models(spark: SparkSession, models_dir: str) -> dict[str, StoredModel]:
    """Every stored model under the directory; a missing directory is an empty registry."""
    found = {}
    for name in _names(spark, models_dir):
        if not name.startswith((CLASSIFIER_PREFIX, *SCORE_PREFIXES)):
            continue
        path = f"{models_dir.rstrip('/')}/{name}"
        card = json.loads(spark.read.text(f"{path}/card").first()[0])
        found[name] = StoredModel(
            name,
            PipelineModel.load(path),
            FeatureSpec.from_json(card["features"]),
            card["threshold"],
        )
    return found


def classifiers(models: dict[str, StoredModel]) -> dict[str, StoredModel]:
    """Risk models keyed by target name."""
    cut = len(CLASSIFIER_PREFIX)
    return {n[cut:]: m for n, m in models.items() if n.startswith(CLASSIFIER_PREFIX)}


def preferred_score_model(models: dict[str, StoredModel], target: str) -> StoredModel | None:
    """Boosted before forest before linear; None when there is none of them."""
    return next((models[p + target] for p in SCORE_PREFIXES if p + target in models), None)


def thresholds(models: dict[str, StoredModel], tuned: bool = False) -> dict[str, float]:
    """Decision threshold per risk model: 0.5, or the stored one if ``tuned``."""
    return {
        target: m.threshold if tuned else DEFAULT_THRESHOLD
        for target, m in classifiers(models).items()
    }
