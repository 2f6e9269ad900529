"""Threshold search, confusion counts, reports, AUC, regression metrics, cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.caching import at_once, kept
from ..functions.columns import number
from ..schema import DEFAULT_THRESHOLD, FeatureSpec
from .features import FEATURES, fit_preparation, prepare

# fixed values: 17 candidate thresholds from 0.1 to 0.9, as floating point gives them
CANDIDATES = [float(t) for t in np.linspace(0.1, 0.9, 17)]


def threshold_sweep(
    df: DataFrame, label: str, prob: str, candidates: Sequence[float] = CANDIDATES, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., threshold, tp, fp, fn, f1) for every candidate from one pass over the rows.

    Each row is counted once, under the number of candidates it reaches; the candidates then sum
    those few counts.
    """
    cuts = sorted(candidates)
    reached = sum((F.col(prob) >= F.lit(t)).cast("int") for t in cuts)
    counts = (
        df.filter(F.col(label).isNotNull() & F.col(prob).isNotNull())
        .groupBy(*by, reached.alias("reached"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    hit = F.col("reached") > F.col("pos_in_list")
    return (
        counts.select("*", F.posexplode(F.array(*[F.lit(t) for t in cuts])).alias("pos_in_list", "threshold"))
        .groupBy(*by, "threshold")
        .agg(
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        )
        .withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )


def best_threshold(df: DataFrame, label: str, prob: str, candidates: Sequence[float] = CANDIDATES) -> float:
    """The lowest candidate with the highest F1; 0.5 if there is nothing to score."""
    best = threshold_sweep(df, label, prob, candidates).orderBy(F.desc("f1"), "threshold").first()
    return DEFAULT_THRESHOLD if best is None else best["threshold"]


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """All four cells (by..., label, pred, n)."""
    cells = [(y, p) for y in (0, 1) for p in (0, 1)]
    counted = df.groupBy(*by).agg(
        *[F.count_if((F.col(label) == y) & (F.col(pred) == p)).alias(f"n{y}{p}") for y, p in cells]
    )
    rows = [
        F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(f"n{y}{p}").alias("n"))
        for y, p in cells
    ]
    return counted.select(*by, F.inline(F.array(*rows)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def class_report(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    y, p = F.col(label), F.col(pred)
    counted = df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def one_class(hit: Column, false: Column, missed: Column):
        return [_ratio(hit, hit + false), _ratio(hit, hit + missed), _ratio(2 * hit, 2 * hit + false + missed)]

    zero, one = one_class(tn, fn, fp), one_class(tp, fp, fn)
    support0, support1 = tn + fp, tp + fn
    accuracy = _ratio(tp + tn, n)
    macro = [(a + b) / 2 for a, b in zip(zero, one, strict=True)]
    weighted = [_ratio(a * support0 + b * support1, n) for a, b in zip(zero, one, strict=True)]
    lines = [
        ("0", zero, support0),
        ("1", one, support1),
        ("accuracy", [accuracy] * 3, n),
        ("macro avg", macro, n),
        ("weighted avg", weighted, n),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("class"),
            v[0].alias("precision"),
            v[1].alias("recall"),
            v[2].alias("f1"),
            support.alias("support"),
        )
        for name, v, support in lines
    ]
    return counted.select(*by, F.inline(F.array(*rows)))


def roc_auc(df: DataFrame, label: str, prob: str) -> float | None:
    """Area under the ROC curve with ties counted half; None if only one class is present."""
    known = df.filter(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(
        F.col(label).cast("double").alias("y"), F.col(prob).cast("double").alias("p")
    )
    rows = known.persist()
    try:
        if rows.agg(F.min("y") < F.max("y")).first()[0] is not True:
            return None
        return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(rows)
    finally:
        rows.unpersist()


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, RMSE, MAE and R squared in one aggregate."""
    y, p = number(label), number(pred)
    e = y - p
    sums = (
        df.filter(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(y).alias("n"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            F.sum(e * e).alias("ss_res"),
            (F.var_pop(y) * F.count(y)).alias("ss_tot"),
        )
    )
    r2 = F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).when(
        F.col("ss_res") == 0, F.lit(1.0)
    ).otherwise(F.lit(0.0))
    return sums.select(*by, "n", "rmse", "mae", r2.alias("r2"))


def residuals(df: DataFrame, label: str, pred: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., predicted, residual) with residual = actual - predicted."""
    return df.select(*keep, number(pred).alias("predicted"), (number(label) - number(pred)).alias("residual"))


def cross_validate(
    df: DataFrame, features: FeatureSpec, learner: Estimator, label: str, fold: str, k: int
) -> DataFrame:
    """(fold, n, rmse, r2); preparation and learner are refitted on the other folds each time, some at once."""

    def one(i: int) -> tuple:
        train, held_out = rows.filter(F.col(fold) != i), rows.filter(F.col(fold) == i)
        prep = fit_preparation(train, features)
        prepared = prepare(prep, train.select(label, *features.columns)).select(label, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = learner.copy().fit(prepared)  # a learner reads its rows several times before it has its own form of them
        finally:
            prepared.unpersist()
        scored = model.transform(prepare(prep, held_out))
        r = regression_metrics(scored, label, model.getPredictionCol()).first()
        return i, r["n"], r["rmse"], r["r2"]

    with kept(df.select(fold, *dict.fromkeys([*features.columns, label]))) as rows:
        scores = at_once(one, range(k))
    return df.sparkSession.createDataFrame(scores, "fold int, n long, rmse double, r2 double")


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of the fold scores."""
    return scores.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("rmse").alias("rmse_mean"),
        F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("r2").alias("r2_mean"),
        F.stddev_pop("r2").alias("r2_std"),
    )
