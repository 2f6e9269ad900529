import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import split
from rosterlens.operators.scoring import coefficient_table
from rosterlens.plans.risk_models import train_risk_models, train_risk_models_together
from rosterlens.schema import KEY, RISK_TARGETS, FeatureSpec
from rosterlens.sources.registry import classifiers, load_models

SPEC = FeatureSpec(("stress_score", "sleep_score", "fatigue", "age"), ("rank", "morale"))


@pytest.fixture(scope="module")
def together(soldiers, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    return train_risk_models_together(soldiers, SPEC, models_dir=path), path


def test_all_nine_equal_the_single_fits(soldiers, together):
    results, _ = together
    assert list(results) == list(RISK_TARGETS) and len(results) == 9
    some = {t: RISK_TARGETS[t] for t in ("ucmj", "low_readiness_risk")}
    for name, one in train_risk_models(soldiers, SPEC, some).items():
        all_ = results[name]
        assert all_.cut == one.cut and all_.threshold == one.threshold
        assert all_.auc == pytest.approx(one.auc, abs=1e-4)
        assert sorted(map(tuple, all_.confusion.collect())) == sorted(map(tuple, one.confusion.collect()))
        assert [tuple(r)[0] for r in all_.report.collect()] == [tuple(r)[0] for r in one.report.collect()]
        assert {r[0]: r[1] for r in all_.train_share.collect()} == pytest.approx({r[0]: r[1] for r in one.train_share.collect()})
        both = all_.scored.join(one.scored.select(KEY, F.col("prob").alias("p"), F.col("pred").alias("q")), KEY)
        gap = both.agg(F.count("p"), F.max(F.abs(F.col("p") - F.col("prob"))), F.count_if(F.col("q") != F.col("pred"))).first()
        assert gap[0] == all_.scored.count() and gap[1] < 1e-4 and gap[2] == 0
        drivers = [{r.feature_clean: r.coef for r in x.drivers.collect()} for x in (all_, one)]
        assert drivers[0] == pytest.approx(drivers[1], abs=2e-3)


def test_stored_models_score_as_they_were_measured(soldiers, together):
    results, path = together
    stored = classifiers(load_models(soldiers.sparkSession, path))
    assert set(stored) == set(results)
    r = results["suicide_risk"]
    assert stored["suicide_risk"].threshold == r.threshold
    coefs = [x.coef for x in coefficient_table(stored["suicide_risk"].model, SPEC).collect()]
    assert np.isfinite(coefs).all()
    again = stored["suicide_risk"].model.transform(soldiers).select(KEY, F.col("probability").cast("string").alias("v"))
    both = r.scored.join(again, KEY).withColumn("p", F.regexp_extract("v", r",([^\]]+)\]", 1).cast("double"))
    assert both.count() > 50 and both.where(F.abs(F.col("p") - F.col("prob")) > 1e-12).count() == 0


def test_a_target_of_one_class_is_left_out(soldiers):
    rows = soldiers.withColumn("ucmj", F.lit(1))
    targets = {t: RISK_TARGETS[t] for t in ("ucmj", "suicide_risk")}
    with pytest.warns(UserWarning, match="ucmj"):
        assert list(train_risk_models_together(rows, SPEC, targets)) == ["suicide_risk"]


def test_splits_of_all_labels_equal_single_splits(soldiers):
    rows = soldiers.select(KEY, F.col("ucmj").alias("a"), F.when(F.col("rank") != "E-4", F.col("suicide_risk")).alias("b"))
    both = split.stratified_splits(rows, KEY, {"a": "ta", "b": "tb"}).persist()
    for label, flag in (("a", "ta"), ("b", "tb")):
        one = split.stratified_split(rows, KEY, label).select(KEY, "is_test")
        assert one.join(both.where(F.col(label).isNotNull()), KEY).where(F.col("is_test") != F.col(flag)).count() == 0
    assert both.where("b is null and tb is not null").count() == 0


def test_splits_of_many_labels_keep_no_row_for_each_label(spark, monkeypatch):
    labels = {f"c{i}": f"t{i}" for i in range(6)}
    rows = spark.range(40_000).select("id", *[F.when(F.col("id") % 11 != i, (F.col("id") % (i + 2) == 0).cast("int")).alias(c) for i, c in enumerate(labels)])
    seen = []
    ranked = split.hash_cuts
    monkeypatch.setattr(split, "hash_cuts", lambda hashed, *more: seen.append(hashed.count()) or ranked(hashed, *more))
    got = split.stratified_splits(rows, "id", labels).persist()
    assert sum(seen) < 1_000  # of 240,000 rows times labels
    monkeypatch.undo()
    for label, flag in list(labels.items())[:2]:
        one = split.stratified_split(rows, "id", label).select("id", "is_test")
        assert one.join(got.where(F.col(label).isNotNull()), "id").where(F.col("is_test") != F.col(flag)).count() == 0
    assert split.stratified_splits(rows.where("id < 0"), "id", labels).count() == 0
