import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import attribution as T
from rosterlens.operators import evaluate as E
from rosterlens.operators import explain as X
from rosterlens.operators import features as P
from rosterlens.operators import models as M
from rosterlens.operators.scoring import LinearScore
from rosterlens.operators.split import assign_folds
from rosterlens.schema import FeatureSpec


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0, 1, 300), 2)
    p[:6] = [0.1, 0.9, 0.5, 0.5, E.CANDIDATES[1], 0.15]
    y = (rng.uniform(size=300) < p).astype(int)
    pdf = pd.DataFrame({"id": range(300), "y": y, "p": p})
    return pdf, spark.createDataFrame(pdf).persist()


def f1(y, pred):
    tp, fp, fn = ((y == 1) & pred).sum(), ((y == 0) & pred).sum(), ((y == 1) & ~pred).sum()
    return 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)


def test_threshold_sweep_equals_brute_force(scored):
    pdf, df = scored
    got = E.threshold_sweep(df, "y", "p").orderBy("threshold").collect()
    assert [r.threshold for r in got] == E.CANDIDATES and len(got) == 17
    for r in got:
        assert r.f1 == pytest.approx(f1(pdf.y, pdf.p >= r.threshold))
    best = max(E.CANDIDATES, key=lambda t: (f1(pdf.y, pdf.p >= t), -t))
    assert E.best_threshold(df, "y", "p") == best


def test_best_threshold_without_positives_or_rows(scored):
    _, df = scored
    assert E.best_threshold(df.withColumn("y", F.lit(0)), "y", "p") == E.CANDIDATES[0]
    assert E.best_threshold(df.filter("false"), "y", "p") == 0.5


def test_confusion_and_report(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "y int, p int")
    assert {(r.label, r.pred): r.n for r in E.confusion(df, "y", "p").collect()} == {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    rep = {r["class"]: r for r in E.class_report(df, "y", "p").collect()}
    assert (rep["1"].precision, rep["1"].recall, rep["1"].support) == (0.75, 0.6, 5)
    assert rep["0"].f1 == pytest.approx(8 / 11) and rep["accuracy"].f1 == 0.7
    assert rep["macro avg"].recall == pytest.approx(0.7) and rep["weighted avg"].precision == pytest.approx((4 / 6 + 0.75) / 2)
    none = {r["class"]: r for r in E.class_report(df.withColumn("p", F.lit(0)), "y", "p").collect()}
    assert none["1"].precision == 0 and none["1"].f1 == 0
    assert len(E.confusion(df.filter("false"), "y", "p").collect()) == 4


def test_auc_with_ties_and_one_class(spark, scored):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double")
    assert E.roc_auc(df, "y", "p") == pytest.approx(0.875)
    assert E.roc_auc(df.filter("y = 1"), "y", "p") is None and E.roc_auc(df.filter("false"), "y", "p") is None
    pdf, big = scored
    pos, neg = pdf.p[pdf.y == 1].values, pdf.p[pdf.y == 0].values
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert E.roc_auc(big, "y", "p") == pytest.approx(want)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    r = E.regression_metrics(df, "y", "p").first()
    assert r.n == 3 and r.rmse == pytest.approx(math.sqrt(1.25 / 3)) and r.mae == pytest.approx(0.5)
    assert r.r2 == pytest.approx(1 - 1.25 / (14 / 3))
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert E.regression_metrics(same, "y", "p").first().r2 == 1.0
    assert E.regression_metrics(same.withColumn("p", F.lit(2.0)), "y", "p").first().r2 == 0.0
    assert [tuple(x) for x in E.residuals(df.limit(1), "y", "p").collect()] == [(1.5, -0.5)]


def test_cross_validation(soldiers):
    spec = FeatureSpec(("stress_score", "sleep_score"), ("rank",))
    folded = assign_folds(soldiers.select("soldier_id", *spec.columns, "soldier_readiness"), "soldier_id", 3)
    scores = E.cross_validate(folded, spec, M.linear_learner("soldier_readiness"), "soldier_readiness", "fold", 3)
    rows = scores.orderBy("fold").collect()
    assert [r.n for r in rows] == [134, 133, 133] and all(0.2 < r.r2 < 1 for r in rows)
    s = E.cv_summary(scores).first()
    assert s.rmse_mean == pytest.approx(np.mean([r.rmse for r in rows]))
    assert s.r2_std == pytest.approx(np.std([r.r2 for r in rows]))


def test_drivers(spark):
    rows = [(f"num__x{i}", float(i - 6)) for i in range(13)] + [("cat__rank=E_E-6", 9.0)]
    coefs = spark.createDataFrame(rows, "feature string, coef double")
    got = X.logistic_drivers(coefs).collect()
    assert [r.coef for r in got] == [9, 6, 5, 4, 3, -2, -3, -4, -5, -6] and got[0].feature_clean == "rank_E_E-6"
    assert got[1].odds_ratio == pytest.approx(math.exp(6)) and got[-1].pct_change_odds == pytest.approx((math.exp(-6) - 1) * 100)
    assert len(X.linear_drivers(coefs.limit(6)).collect()) == 10  # short tables repeat rows
    top = X.top_coefficients(coefs, 3, "risk").collect()
    assert [(r.feature, r.effect) for r in top] == [
        ("cat__rank=E_E-6", "↑ increases risk"), ("num__x0", "↓ decreases risk"), ("num__x12", "↑ increases risk"),
    ]
    text = [r.text for r in X.logistic_sentences(X.logistic_drivers(coefs), "ucmj").collect()]
    assert text[4] == "x9: increases odds of ucmj by ~1909% (OR=20.09)"
    assert text[5] == "x4: decreases odds of ucmj by ~86% (OR=0.14)"
    lines = [r.text for r in X.linear_sentences(X.linear_drivers(coefs), "retention_rate").collect()]
    assert lines[0] == "rank_E_E-6: associated with HIGHER retention_rate (coef=9.000)"
    assert lines[-1] == "x0: associated with LOWER retention_rate (coef=-6.000)"


def test_contributions_add_up_to_the_log_odds(spark):
    df = spark.createDataFrame([(1, 3.0, "a"), (2, -1.0, "b"), (3, 0.0, None)], "id int, x double, c string")
    m = LinearScore(0.25, (("x", 1.0, 2.0, 0.8),), (("c", "a", 0.5), ("c", "b", -2.0)))
    parts = X.local_contributions(df, m, "id").toPandas()
    logit = df.select("id", m.margin().alias("m"), m.score().alias("p")).toPandas().set_index("id")
    total = parts.groupby("id")["contribution"].sum() + 0.25
    np.testing.assert_allclose(total, logit["m"])
    np.testing.assert_allclose(logit["p"], 1 / (1 + np.exp(-total)))
    first = parts[parts.id == 2].sort_values("place").iloc[0]
    assert (first.feature, first.direction) == ("cat__c_b", "↓ decreases")
    assert X.local_contributions(df, m, "id", 1).count() == 3


@pytest.fixture(scope="module")
def forest(soldiers):
    spec = FeatureSpec(("stress_score", "sleep_score", "fatigue"), ("rank", "morale"))
    data = soldiers.select("soldier_id", *spec.columns, "soldier_readiness")
    return spec, data, M.fit_regressor(data, spec, M.forest_learner("soldier_readiness", trees=7, depth=6))


def test_forest_importance(forest):
    spec, _, model = forest
    rows = X.forest_importance(model, spec, 4).collect()
    assert len(rows) == 4 and rows[0].feature in ("num__stress_score", "num__sleep_score")
    assert X.forest_importance(model, spec, 99).agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_attribution_sums_to_the_prediction(forest):
    spec, data, model = forest
    prep, rf = model.stages
    prepared = P.prepare(prep, data)
    values, expected = T.tree_attribution(prepared, "soldier_id", rf, P.feature_names(prep, spec))
    total = values.groupBy("soldier_id").agg(F.sum("value").alias("v"))
    both = rf.transform(prepared).join(total, "soldier_id")
    worst = both.select(F.max(F.abs(F.col("v") + expected - F.col("prediction")))).first()[0]
    assert both.count() == 400 and worst < 1e-9
    blocks, same = T.tree_attribution(prepared, "soldier_id", rf, P.feature_names(prep, spec), block_nodes=60)
    assert same == pytest.approx(expected)
    gap = blocks.join(values.withColumnRenamed("value", "whole"), ["soldier_id", "feature"])
    assert gap.count() == values.count() and gap.select(F.max(F.abs(F.col("value") - F.col("whole")))).first()[0] < 1e-9
    summary = T.attribution_summary(values).collect()
    assert len(summary) == len(P.feature_names(prep, spec)) and summary[0].mean_abs_value >= summary[-1].mean_abs_value
