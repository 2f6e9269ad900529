"""Train, tune, evaluate, explain and store the risk classifiers of all targets."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.caching import at_once, kept
from ..functions.small_tables import computed
from ..operators.clean import complete_cases
from ..operators.evaluate import best_threshold, class_report, confusion, roc_auc, threshold_sweep
from ..operators.explain import logistic_drivers, logistic_sentences
from ..operators.features import FEATURES, category_levels, feature_names, fit_preparation, prepare
from ..operators.models import LABEL, OneClass, fit_logistic, logistic_model, make_target, with_preparation
from ..operators.newton import Fit, Moments, fit_targets, target_moments
from ..operators.profile import class_share
from ..operators.ranks import roc_aucs
from ..operators.scoring import apply_threshold, coefficient_table
from ..operators.split import bucket_split, stratified_split, stratified_splits
from ..operators.sums import matrix
from ..schema import DEFAULT_THRESHOLD, KEY, RISK_FEATURES, RISK_TARGETS, SEED, TEST_SHARE, FeatureSpec, TargetSpec
from ..sources.registry import CLASSIFIER_PREFIX, save_model
from ..sources.tables import save_drivers


@dataclass(frozen=True)
class RiskResult:
    target: str
    model: PipelineModel
    cut: float | None
    threshold: float
    auc: float | None
    report: DataFrame
    confusion: DataFrame
    train_share: DataFrame
    drivers: DataFrame
    scored: DataFrame


def train_risk_models(
    df: DataFrame,
    features: FeatureSpec = RISK_FEATURES,
    targets: Mapping[str, TargetSpec] = RISK_TARGETS,
    key: str = KEY,
    models_dir: str | None = None,
    reports_dir: str | None = None,
    shared_preparation: bool = False,
    tune_on: str = "test",
    fit_on: str = "all",
    max_iter: int = 1000,
    seed: int | str = SEED,
) -> dict[str, RiskResult]:
    """One classifier per target, each with its own stratified split.

    Scaling and encoding are fitted on each target's train rows; ``shared_preparation`` fits them once
    on all complete cases, test rows included, so that the assembled frame is cached for all targets.
    A target whose train rows are of one class is left out with a warning.
    ``tune_on`` picks the rows the threshold is tuned on, ``fit_on`` ("all" or "train") the rows a
    quantile label is cut on; "train" cuts it on the rows a label-free split would train on.
    """
    if tune_on not in ("test", "train") or fit_on not in ("all", "train"):
        raise ValueError("tune_on is 'test' or 'train', fit_on is 'all' or 'train'")
    clean = complete_cases(df, features.columns)
    results = {}
    prep = fit_preparation(clean, features) if shared_preparation else None
    with kept(prepare(prep, clean) if prep else clean) as base:

        def one(spec: TargetSpec) -> RiskResult | None:
            try:
                return _train_one(base, prep, features, spec, key, tune_on, fit_on, max_iter, seed)
            except OneClass as e:
                warnings.warn(f"{spec.name}: {e}", stacklevel=2)
                return None

        for name, r in zip(targets, at_once(one, targets.values()), strict=True):
            if r is None:
                continue
            results[name] = r
            if models_dir:
                save_model(r.model, models_dir, CLASSIFIER_PREFIX + name, features, r.threshold)
            if reports_dir:
                save_drivers(r.drivers, reports_dir, "logreg", name)
    return results


def _train_one(base, prep, features, spec, key, tune_on, fit_on, max_iter, seed) -> RiskResult:
    cut_rows = base.filter(~bucket_split(key, TEST_SHARE, seed)) if fit_on == "train" else None
    labelled, cut = make_target(base, spec, LABEL, cut_rows)
    split = stratified_split(labelled, key, LABEL, TEST_SHARE, seed)
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    if prep is None:
        prep = fit_preparation(train, features)
        train, test = prepare(prep, train), prepare(prep, test)
    fitted = fit_logistic(train, LABEL, max_iter=max_iter)
    model = with_preparation(prep, fitted)

    def scored(rows: DataFrame) -> DataFrame:
        return fitted.transform(rows).select(
            key, LABEL, vector_to_array(fitted.getProbabilityCol())[1].alias("prob")
        )

    with kept(scored(test)) as outcome:
        threshold = best_threshold(outcome if tune_on == "test" else scored(train), LABEL, "prob")
        result = outcome.withColumn("pred", apply_threshold("prob", threshold))
        return RiskResult(
            target=spec.name,
            model=model,
            cut=cut,
            threshold=threshold,
            auc=roc_auc(result, LABEL, "prob"),
            report=computed(class_report(result, LABEL, "pred")),
            confusion=computed(confusion(result, LABEL, "pred")),
            train_share=computed(class_share(train.select(LABEL), LABEL)),
            drivers=logistic_sentences(logistic_drivers(coefficient_table(model, features)), spec.name),
            scored=scored(test).withColumn("pred", apply_threshold("prob", threshold)),
        )


def train_risk_models_together(
    df: DataFrame,
    features: FeatureSpec = RISK_FEATURES,
    targets: Mapping[str, TargetSpec] = RISK_TARGETS,
    key: str = KEY,
    models_dir: str | None = None,
    reports_dir: str | None = None,
    tune_on: str = "test",
    seed: int | str = SEED,
) -> dict[str, RiskResult]:
    """The classifiers of ``train_risk_models``, all fitted, tuned and measured in the same scans.

    The number of jobs does not grow with the targets (but for a quantile label's cut).  Each target has its own
    stratified split and its features count as standardised on its own train rows; the stored models share one
    preparation, fitted on all complete cases, so their coefficients are in its units.  ``drivers`` are in the target's.
    Fits are exact to 1e-9, by Newton's method.
    """
    if tune_on not in ("test", "train"):
        raise ValueError("tune_on is 'test' or 'train'")
    specs = list(targets.values())
    labels, flags = [f"_y{i}" for i in range(len(specs))], [f"_test{i}" for i in range(len(specs))]
    with ExitStack() as read, ExitStack() as fitting:  # the table is evaluated once for preparation, cuts, splits and rows
        needed = dict.fromkeys([key, *features.columns, *[s.source for s in specs]])
        clean = read.enter_context(kept(complete_cases(df.select(*needed), features.columns)))
        prep = fit_preparation(clean, features)
        names = feature_names(prep, features)
        cuts = []
        for spec, label in zip(specs, labels):
            clean, cut = make_target(clean, spec, label)
            cuts.append(cut)
        split = stratified_splits(clean, key, dict(zip(labels, flags)), TEST_SHARE, seed)
        rows = prepare(prep, split).select(key, vector_to_array(FEATURES, "float64").alias("x"), *labels, *flags)
        small = [F.col(y).cast("tinyint") for y in labels]  # labels are 0 and 1
        used = F.array(*[F.when(~F.col(t), y) for y, t in zip(small, flags)])
        made = rows.select(key, "x", used.alias("y"), F.array(*small).alias("label"), F.array(*flags).alias("test"))
        rows = fitting.enter_context(kept(made))
        read.close()
        train = rows.select("x", "y")
        moments = target_moments(train, len(names), len(specs))
        live = [_live(prep, features, m) for m in moments]
        fits = fit_targets(train, len(names), moments, len(features.numeric), live=live)
        for spec, fit in zip(specs, fits):
            if fit is None:
                warnings.warn(f"{spec.name}: only one class in its train rows", stacklevel=2)
        fitted = [i for i, f in enumerate(fits) if f is not None]
        if not fitted:
            return {}
        scored = _scores_of_all(rows, key, specs, fits).drop(key)
        with kept(scored if tune_on == "train" else scored.where("is_test")) as scored:
            tuned = threshold_sweep(scored.where(F.col("is_test") == (tune_on == "test")), LABEL, "prob", by=["target"])
            best = Window.partitionBy("target").orderBy(F.desc("f1"), "threshold")  # 17 rows a target
            tuned = tuned.withColumn("_place", F.row_number().over(best)).where("_place = 1")
            at = {r["target"]: r["threshold"] for r in tuned.collect()}
            chosen = F.create_map(*[F.lit(v) for i in fitted for v in (specs[i].name, at.get(specs[i].name, DEFAULT_THRESHOLD))])
            outcome = scored.where("is_test").withColumn("pred", (F.col("prob") >= chosen[F.col("target")]).cast("int"))
            aucs = {r["model"]: r["auc"] for r in roc_aucs(outcome, "target", LABEL, "prob").collect()}
            reports = computed(class_report(outcome, LABEL, "pred", ["target"]))
            cells = computed(confusion(outcome, LABEL, "pred", ["target"]))
    results = {}
    all_scores = _scores_of_all(rows, key, specs, fits).where("is_test")
    spark = df.sparkSession
    for i in fitted:
        name, fit, m = specs[i].name, fits[i], moments[i]
        own = F.col("target") == name
        scale = [m.std[j] if j < len(features.numeric) else 1.0 for j in range(len(names))]
        table = spark.createDataFrame([(n, float(c * s)) for n, c, s in zip(names, fit.coefficients, scale)], "feature string, coef double")
        threshold = at.get(name, DEFAULT_THRESHOLD)
        r = results[name] = RiskResult(
            target=name,
            model=with_preparation(prep, logistic_model(fit.intercept, fit.coefficients)),
            cut=cuts[i],
            threshold=threshold,
            auc=aucs.get(name),
            report=reports.where(own).drop("target"),
            confusion=cells.where(own).drop("target"),
            train_share=spark.createDataFrame(
                [(k, n, n / m.n) for k, n in ((0, m.n - m.ones), (1, m.ones))], f"{LABEL} int, n long, proportion double"
            ),
            drivers=logistic_sentences(logistic_drivers(table), name),
            scored=all_scores.where(own).select(key, LABEL, "prob").withColumn("pred", apply_threshold("prob", threshold)),
        )
        if models_dir:
            save_model(r.model, models_dir, CLASSIFIER_PREFIX + name, features, threshold)
        if reports_dir:
            save_drivers(r.drivers, reports_dir, "logreg", name)
    return results


def _live(prep: PipelineModel, features: FeatureSpec, m: Moments) -> np.ndarray:
    """Features that a preparation of the target's own train rows would have: without the first level seen there."""
    live, at = m.std > 0, len(features.numeric)
    for levels in category_levels(prep, features).values():
        own = slice(at, at + len(levels) - 1)
        if m.n and m.mean[own].sum() > 1 - 0.5 / m.n and live[own].any():  # the first level of all is not there
            live[at + int(np.argmax(m.mean[own] > 0))] = False
        at += len(levels) - 1
    return live


def _scores_of_all(rows: DataFrame, key: str, specs: list[TargetSpec], fits: list[Fit | None]) -> DataFrame:
    """(target, key, label, is_test, prob): a row for each record and fitted target, from one scan."""
    which = [i for i, f in enumerate(fits) if f is not None]
    slopes = np.stack([fits[i].coefficients for i in which], axis=1)
    start = np.array([fits[i].intercept for i in which])
    names = [specs[i].name for i in which]
    places = F.array(*[F.struct(F.lit(n).alias("target"), F.get("label", F.lit(i)).cast("int").alias(LABEL), F.get("test", F.lit(i)).alias("is_test"), F.get("p", F.lit(k)).alias("prob")) for k, (i, n) in enumerate(zip(which, names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(slopes))
            p = 1.0 / (1.0 + np.exp(-(x @ slopes + start)))
            ends = pa.array(np.arange(len(x) + 1) * len(start), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("label"), batch.column("test"), lists], names=[key, "label", "test", "p"])

    kinds = dict(rows.dtypes)
    scored = rows.mapInArrow(run, f"`{key}` {kinds[key]}, label {kinds['label']}, test {kinds['test']}, p array<double>")
    return scored.select(key, F.explode(places).alias("s")).select("s.target", key, f"s.{LABEL}", "s.is_test", "s.prob").where(F.col(LABEL).isNotNull())
