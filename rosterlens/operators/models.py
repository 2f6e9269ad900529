"""Risk classifiers and score regressors, fitted by MLlib."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag_at_most, flag_below, flag_in_set
from ..functions.small_tables import shared_dir
from ..schema import SEED, FeatureSpec, TargetSpec
from .boosting import BoostedTrees
from .features import FEATURES, fit_preparation, prepare
from .quantiles import quantile

LABEL = "_label"
WEIGHT = "_weight"


def make_target(
    df: DataFrame, spec: TargetSpec, out: str, fit_on: DataFrame | None = None
) -> tuple[DataFrame, float | None]:
    """Add the 0/1 label ``out``; returns the frame and the cut-off used, if any.

    ``fit_on`` is the table the quantile is taken from (default: ``df`` itself).
    A missing value of a ``binary`` target fails the query; every other rule gives it 0.
    """
    src = F.col(spec.source)
    if spec.kind == "binary":
        told = F.raise_error(F.lit(f"missing or non-integer value in target {spec.name}"))
        label = F.coalesce(src.try_cast("int"), told.cast("int"))
        return df.withColumn(out, label), None
    if spec.kind == "in_set":
        return df.withColumn(out, flag_in_set(src, spec.values)), None
    if spec.kind == "quantile":
        cut = quantile(fit_on if fit_on is not None else df, spec.source, spec.q)
        return df.withColumn(out, flag_at_most(src, cut)), cut
    if spec.kind == "threshold":
        return df.withColumn(out, flag_below(src, spec.cut)), spec.cut
    raise ValueError(f"unknown target kind for {spec.name}: {spec.kind}")


class OneClass(ValueError):
    """A classifier was to be fitted on rows of a single class."""


def balanced_weights(df: DataFrame, label: str, out: str = WEIGHT) -> tuple[DataFrame, int]:
    """Weight n / (2 n_class) per row, and n; reads one row with the class counts."""
    n, ones = df.agg(F.count(label), F.sum(F.col(label).cast("long"))).first()
    ones = ones or 0
    if ones in (0, n):
        raise OneClass(f"only one class in {label}")
    w = F.when(F.col(label) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    return df.withColumn(out, w), n


def fit_logistic(prepared: DataFrame, label: str, c: float = 1.0, max_iter: int = 1000):
    """Class-balanced L2 logistic regression on a frame that has the feature vector.

    With weights that sum to n, regParam = 1 / (c n) gives the objective of penalty strength c.
    """
    weighted, n = balanced_weights(prepared, label)
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=label,
        weightCol=WEIGHT,
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-7,
    ).fit(weighted)


def logistic_model(intercept: float, coefficients: Sequence[float]) -> LogisticRegressionModel:
    """A fitted model of the ``features`` vector from its numbers."""
    context = SparkContext._active_spark_context
    vector = _py2java(context, DenseVector(coefficients))
    uid = f"LogisticRegression_{uuid.uuid4().hex[:12]}"
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(uid, vector, float(intercept))
    return LogisticRegressionModel(made).setFeaturesCol(FEATURES)


def linear_learner(label: str) -> Estimator:
    return LinearRegression(
        featuresCol=FEATURES, labelCol=label, regParam=0.0, solver="normal", standardization=False
    )


def forest_learner(
    label: str, trees: int = 300, depth: int = 30, bins: int = 32, seed: int = SEED, bootstrap: bool = True
) -> Estimator:
    """Bagged full-depth trees over all features; MLlib stops at depth 30 and bins the splits.

    Without ``bootstrap`` every tree is grown on the rows as they are.
    """
    return RandomForestRegressor(
        featuresCol=FEATURES,
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        featureSubsetStrategy="all",
        bootstrap=bootstrap,
        seed=seed,
    )


def boosted_learner(
    label: str, rounds: int = 600, depth: int = 6, rate: float = 0.05, share: float = 0.9, seed: int = SEED
) -> Estimator:
    """Gradient-boosted trees on squared error with row and column sampling.

    Rounds run one after the other; the checkpoint interval keeps the lineage short.  MLlib fits each tree to
    the gradient, which is twice the residual, so half the ``rate`` is its step; the first tree counts in full.
    """
    return GBTRegressor(
        featuresCol=FEATURES,
        labelCol=label,
        lossType="squared",
        maxIter=rounds,
        stepSize=rate / 2,
        maxDepth=depth,
        subsamplingRate=share,
        featureSubsetStrategy=str(share),
        checkpointInterval=10,
        seed=seed,
    )


def regularised_learner(
    label: str,
    rounds: int = 600,
    depth: int = 6,
    rate: float = 0.05,
    share: float = 0.9,
    penalty: float = 1.0,
    bins: int = 256,
    seed: int = SEED,
) -> Estimator:
    """Second-order boosting with a leaf penalty; ``share`` of the rows and of the columns are drawn for each tree."""
    return BoostedTrees(
        labelCol=label, rounds=rounds, depth=depth, rate=rate, rowShare=share, columnShare=share, penalty=penalty, bins=bins, seed=seed
    )


LEARNERS = {"linreg": linear_learner, "rfreg": forest_learner, "xgbreg": regularised_learner}


def fit_regressor(train: DataFrame, features: FeatureSpec, learner: Estimator) -> PipelineModel:
    """Preparation and learner fitted on the same rows, as one saved-and-loaded unit."""
    shared_dir(train.sparkSession)  # the tree learners checkpoint there between rounds
    prep = fit_preparation(train, features)
    return with_preparation(prep, learner.fit(prepare(prep, train)))


def with_preparation(prep: PipelineModel, model) -> PipelineModel:
    return PipelineModel(stages=[prep, model])
