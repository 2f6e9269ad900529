import pytest
from pyspark.sql import functions as F

from rosterlens import schema as S
from rosterlens.operators.scoring import add_scores
from rosterlens.operators.screening import fit_groups
from rosterlens.plans import dashboard, risk_models, score_models
from rosterlens.schema import FeatureSpec, TargetSpec
from rosterlens.sources import registry

SMALL = FeatureSpec(("stress_score", "sleep_score", "fatigue", "OPTEMPO", "acft_failure", "low_morale"), ("rank", "morale"))
TARGETS = {t: S.RISK_TARGETS[t] for t in ("high_burnout_risk", "ucmj", "low_readiness_risk")}


@pytest.fixture(scope="module")
def stored(soldiers, tmp_path_factory):
    root = tmp_path_factory.mktemp("out")
    risks = risk_models.train_risk_models(
        soldiers, SMALL, TARGETS, models_dir=str(root / "models"), reports_dir=str(root / "reports")
    )
    scores = {}
    for target in S.SCORES:
        scores[target] = score_models.train_score_models(
            soldiers,
            target,
            SMALL,
            learners=("linreg", "rfreg") if target == "soldier_readiness" else ("linreg", "xgbreg"),
            settings={"rfreg": {"trees": 8, "depth": 5}, "xgbreg": {"rounds": 5, "depth": 3}},
            cv_folds=2 if target == "soldier_readiness" else 0,
            models_dir=str(root / "models"),
            reports_dir=str(root / "reports"),
        )
    return root, risks, scores


def test_risk_models(spark, soldiers, stored):
    root, risks, _ = stored
    assert list(risks) == list(TARGETS)
    r = risks["high_burnout_risk"]
    assert r.auc > 0.7 and 0.1 <= r.threshold <= 0.9
    assert r.report.count() == 5 and r.confusion.agg(F.sum("n")).first()[0] == 80
    assert r.train_share.agg(F.sum("n")).first()[0] == 320
    assert r.drivers.count() == 10 and "odds of high_burnout_risk" in r.drivers.first().text
    assert r.scored.count() == 80
    assert risks["low_readiness_risk"].cut == pytest.approx(soldiers.toPandas().soldier_readiness.quantile(0.25))
    report = spark.read.csv(str(root / "reports" / "drivers_logreg_ucmj.csv"), header=True)
    assert report.count() == 10 and "odds_ratio" in report.columns


def test_separate_preparation_and_train_only_tuning(soldiers):
    one = {"low": TargetSpec("low", "quantile", "soldier_readiness", q=0.25), "none": TargetSpec("none", "threshold", "soldier_readiness", cut=-1.0)}
    with pytest.warns(UserWarning, match="only one class"):
        both = risk_models.train_risk_models(soldiers, SMALL, one, tune_on="train", fit_on="train", max_iter=50)
    assert set(both) == {"low"}
    r = both["low"]
    assert r.auc > 0.6 and r.confusion.agg(F.sum("n")).first()[0] == 80
    with pytest.raises(ValueError):
        risk_models.train_risk_models(soldiers, SMALL, one, tune_on="x")


def test_score_models_beat_the_mean(stored):
    _, _, scores = stored
    for results in scores.values():
        for r in results.values():
            m = r.metrics.first()
            assert m.n == 80 and m.r2 > 0.05, r.name
    lin, forest = scores["soldier_readiness"]["linreg"], scores["soldier_readiness"]["rfreg"]
    assert lin.cv.first().folds == 2 and lin.drivers.count() == 10 and lin.importance is None
    assert forest.importance.count() > 0 and forest.drivers is None
    assert lin.residuals.count() == 80 and scores["retention_rate"]["xgbreg"].cv is None


def test_registry_round_trip(spark, soldiers, stored):
    root, risks, scores = stored
    models = registry.load_models(spark, str(root / "models"))
    assert len(models) == 3 + 4 and registry.load_models(spark, str(root / "nothing")) == {}
    assert models["logreg_ucmj"].features == SMALL and models["logreg_ucmj"].threshold == risks["ucmj"].threshold
    assert registry.preferred_score_model(models, "soldier_readiness").name == "rfreg_soldier_readiness"
    assert registry.preferred_score_model(models, "retention_rate").name == "xgbreg_retention_rate"
    assert registry.preferred_score_model(models, "other") is None
    assert set(registry.thresholds(models).values()) == {0.5}
    assert registry.thresholds(models, tuned=True)["ucmj"] == risks["ucmj"].threshold
    for fitted, name in ((risks["ucmj"].model, "logreg_ucmj"), (scores["soldier_readiness"]["rfreg"].model, "rfreg_soldier_readiness")):
        both = add_scores(soldiers, {"a": fitted, "b": models[name].model})
        assert both.select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] == 0
    with pytest.raises(ValueError, match="prefix"):
        registry.save_model(risks["ucmj"].model, str(root / "models"), "other", SMALL)


def test_dashboard_pages(spark, soldiers, stored):
    root, *_ = stored
    models = registry.load_models(spark, str(root / "models"))
    page = dashboard.overview(soldiers, {"division_level": "D0"}, "ucmj")
    assert set(page) == {"kpi", "histogram_stress_score", "histogram_sleep_score", "histogram_OPTEMPO", "rate_by_group"}
    assert page["rate_by_group"].count() == 2 and page["kpi"].first().soldier_readiness > 1
    record = soldiers.orderBy("soldier_id").limit(1)
    risks = dashboard.record_risks(record, models, {"stress_score": 95.0})
    assert risks.count() == 3 and {r.band for r in risks.collect()} <= {"high", "moderate", "lower"}
    low = dashboard.record_risks(record, models, {"stress_score": 5.0}).filter("risk = 'high_burnout_risk'").first()
    high = risks.filter("risk = 'high_burnout_risk'").first()
    assert high.probability > low.probability
    scores = dashboard.record_scores(soldiers, models)
    assert scores.columns == ["soldier_id", "predicted_soldier_readiness", "predicted_retention_rate"]
    assert scores.agg(F.max("predicted_retention_rate")).first()[0] <= 1
    drivers = dashboard.record_drivers(record, models["logreg_ucmj"])
    assert drivers.count() == 10
    assert dashboard.workload_test(soldiers, {}).decision in ("Reject H0", "Fail to reject H0")
    assert dashboard.headline(soldiers, ["ucmj", "absent"]).count() == 1
    assert dashboard.unit_levels(soldiers) == ["brigade_level", "division_level"]


def test_unit_page(spark, soldiers, stored):
    root, *_ = stored
    risks = {t: m.model for t, m in registry.classifiers(registry.load_models(spark, str(root / "models"))).items()}
    base = soldiers.orderBy("soldier_id").first().asDict()
    page = dashboard.unit_page(
        soldiers, {"division_level": "D1"}, risks, SMALL.columns, "brigade_level", base,
        {"sleep_score": base["sleep_score"] + 2, "low_morale": 0}, sample=150,
    )
    assert page["matrix"].count() == 2 and set(risks) < set(page["matrix"].columns)
    table = page["before_after"].collect()
    assert len(table) == 3 and [r.change_pp for r in table] == sorted(r.change_pp for r in table)


def test_forest_attribution_plan(soldiers, stored):
    _, _, scores = stored
    model = scores["soldier_readiness"]["rfreg"].model
    values, summary, expected = score_models.forest_attribution(soldiers, model, SMALL, n=50)
    assert values.select("soldier_id").distinct().count() == 50 and 0 < expected < 1
    assert summary.first().feature in ("num__stress_score", "num__sleep_score")


def test_groups(soldiers):
    grouped = fit_groups(soldiers, SMALL, 3, components=2).transform(soldiers)
    assert grouped.select("group").distinct().count() == 3 and len(grouped.first().components) == 2
