"""Train and evaluate linear, forest and boosted regressors of a continuous score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.caching import kept
from ..functions.columns import number
from ..functions.small_tables import computed
from ..operators.attribution import attribution_summary, tree_attribution
from ..operators.boosting import BoostedTrees, cross_validate_boosted
from ..operators.clean import complete_cases
from ..operators.evaluate import cross_validate, cv_summary, regression_metrics, residuals
from ..operators.explain import forest_importance, linear_drivers, linear_sentences
from ..operators.features import feature_names, prepare
from ..operators.foldstats import cross_validate_linear
from ..operators.models import LEARNERS, fit_regressor
from ..operators.scoring import coefficient_table
from ..operators.split import assign_folds, random_split, sample_n
from ..schema import (
    FOLDS,
    KEY,
    READINESS_FEATURES,
    RETENTION_FEATURES,
    SEED,
    TEST_SHARE,
    FeatureSpec,
)
from ..sources.registry import save_model
from ..sources.tables import save_drivers

SCORE_FEATURES = {"soldier_readiness": READINESS_FEATURES, "retention_rate": RETENTION_FEATURES}


@dataclass(frozen=True)
class ScoreResult:
    name: str
    model: PipelineModel
    metrics: DataFrame
    cv: DataFrame | None
    residuals: DataFrame
    drivers: DataFrame | None
    importance: DataFrame | None


def train_score_models(
    df: DataFrame,
    target: str,
    features: FeatureSpec | None = None,
    key: str = KEY,
    learners: Sequence[str] = ("linreg", "rfreg", "xgbreg"),
    settings: Mapping[str, Mapping[str, object]] | None = None,
    cv_folds: int = FOLDS,
    models_dir: str | None = None,
    reports_dir: str | None = None,
    seed: int | str = SEED,
) -> dict[str, ScoreResult]:
    """Fit each learner on the train rows, cross-validate it there, report on the test rows.

    ``settings`` overrides learner arguments (``{"xgbreg": {"rounds": 50}}``); ``cv_folds=0`` skips
    cross-validation.
    """
    features = features or SCORE_FEATURES[target]
    wanted = [*features.columns, target]
    clean = complete_cases(df, wanted).select(key, *dict.fromkeys(wanted))
    clean = clean.withColumn(target, number(target))
    results = {}
    with kept(random_split(clean, key, TEST_SHARE, seed)) as split:
        train, test = split.filter(~F.col("is_test")), split.filter("is_test")
        folded = assign_folds(train, key, cv_folds, seed) if cv_folds else None
        for kind in learners:
            learner = LEARNERS[kind](target, **(settings or {}).get(kind, {}))
            r = _one(kind, learner, train, test, folded, cv_folds, features, target, key)
            results[kind] = r
            if models_dir:
                save_model(r.model, models_dir, r.name, features)
            if reports_dir and r.drivers is not None:
                save_drivers(r.drivers, reports_dir, kind, target)
    return results


def _one(kind, learner: Estimator, train, test, folded, k, features, target, key) -> ScoreResult:
    model = fit_regressor(train, features, learner)
    pred = model.stages[-1].getPredictionCol()
    scored = model.transform(test).select(key, target, pred)
    drivers = importance = None
    if kind == "linreg":
        drivers = linear_sentences(linear_drivers(coefficient_table(model, features)), target)
    else:
        importance = forest_importance(model, features)
    cv = cv_summary(_fold_scores(kind, learner, folded, features, target, k)) if k else None
    return ScoreResult(
        name=f"{kind}_{target}",
        model=model,
        metrics=computed(regression_metrics(scored, target, pred)),
        cv=cv,
        residuals=residuals(scored, target, pred, [key]),
        drivers=drivers,
        importance=importance,
    )


def _fold_scores(kind, learner: Estimator, folded, features, target, k) -> DataFrame:
    """Fold scores; linear and boosted models take the passes of one fit for all folds."""
    if kind == "linreg":
        return cross_validate_linear(folded, features, target, "fold", k)
    if isinstance(learner, BoostedTrees):
        return cross_validate_boosted(folded, features, target, "fold", k, learner.settings())
    return cross_validate(folded, features, learner, target, "fold", k)


def forest_attribution(
    rows: DataFrame, model: PipelineModel, features: FeatureSpec, key: str = KEY, n: int | None = None
) -> tuple[DataFrame, DataFrame, float]:
    """(values per record and feature, mean absolute value per feature, expectation) for a stored
    forest, on all records, or on a seeded sample of ``n`` if one is asked for."""
    prep, forest = model.stages
    sample = sample_n(rows, key, n) if n else rows
    values, expected = tree_attribution(prepare(prep, sample), key, forest, feature_names(prep, features))
    return values, attribution_summary(values), expected
