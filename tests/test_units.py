import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import features as P
from rosterlens.operators import models as M
from rosterlens.operators import units as U
from rosterlens.operators.scoring import LinearScore
from rosterlens.schema import FeatureSpec

A = LinearScore(-0.2, (("stress_score", 50.0, 20.0, 0.9), ("fatigue", 0.5, 0.2, 0.4)), (("rank", "E-6", 0.5),))
B = LinearScore(0.4, (("sleep_score", 5.0, 2.0, -0.7),), (("morale", "low", 0.3),))
R = LinearScore(0.6, (("stress_score", 50.0, 20.0, -0.1),), link="identity")


def prob(m, pdf):
    z = m.intercept + sum(c * (pdf[n] - mu) / s for n, mu, s, c in m.numeric)
    z = z + sum(c * (pdf[n] == v) for n, v, c in m.levels)
    return 1 / (1 + np.exp(-z)) if m.link == "logit" else z


@pytest.fixture(scope="module")
def pdf(soldiers):
    return soldiers.toPandas()


def test_unit_summary(soldiers, pdf):
    got = U.unit_summary(soldiers, {"a": A, "b": B}, {"r": R}, {"a": 0.6}).toPandas().set_index("metric")
    assert got.loc["a", "threshold"] == 0.6 and got.loc["b", "threshold"] == 0.5
    assert got.loc["a", "avg_probability"] == pytest.approx(prob(A, pdf).mean())
    assert got.loc["a", "predicted_rate"] == pytest.approx((prob(A, pdf) >= 0.6).mean())
    np.testing.assert_allclose(
        got.loc["r", ["p10", "p50", "p90"]].astype(float), np.percentile(prob(R, pdf), [10, 50, 90])
    )
    assert pd.isna(got.loc["a", "avg_pred"]) and pd.isna(got.loc["r", "predicted_rate"]) and pd.isna(got.loc["b", "p50"])
    assert U.unit_summary(soldiers, {"a": A}, {}).first().p50 is None


def test_unit_matrix_equals_loop_over_groups(spark, soldiers, pdf):
    extra = soldiers.limit(1).withColumn("brigade_level", F.lit(None).cast("string"))
    alone = soldiers.limit(1).withColumn("brigade_level", F.lit("solo"))
    got = U.unit_risk_matrix(soldiers.union(extra).union(alone), "brigade_level", {"a": A, "b": B}).collect()
    assert [r.n for r in got] == sorted((r.n for r in got), reverse=True) and got[-1].brigade_level == "solo"
    for r in got[:-1]:
        grp = pdf[pdf.brigade_level == r.brigade_level]
        assert r.n == len(grp) and r.a == pytest.approx((prob(A, grp) >= 0.5).mean())
        assert r.b == pytest.approx((prob(B, grp) >= 0.5).mean())
    assert len(got) == pdf.brigade_level.nunique() + 1


def test_unit_matrix_is_one_shuffle(soldiers):
    plan = U.unit_risk_matrix(soldiers, "brigade_level", {"a": A, "b": B})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_override(soldiers):
    one = soldiers.limit(1)
    got = U.override_record(one, {"stress_score": 7, "rank": "E-9", "absent": 1}).first()
    assert (got.stress_score, got["rank"]) == (7.0, "E-9") and "absent" not in got
    with pytest.raises(ValueError, match="changes its type"):
        U.override_record(one, {"morale": 1})
    with pytest.raises(ValueError, match="changes its type"):
        U.override_record(one, {"stress_score": "high"})


BASE = {"stress_score": 40.0, "sleep_score": 6.0, "fatigue": 0.5, "OPTEMPO": 0.5}


def test_scenario_shifts_clips_and_sets_flags(soldiers, pdf):
    over = {"stress_score": 70.0, "sleep_score": 1.0, "fatigue": 0.9, "low_morale": 1, "acft_failure": 0, "absent": 3}
    got = U.apply_scenario(soldiers, BASE, over).toPandas().set_index("soldier_id").loc[pdf.soldier_id]
    np.testing.assert_allclose(got["stress_score"], (pdf["stress_score"] + 30).clip(0, 100).values)
    np.testing.assert_allclose(got["sleep_score"], (pdf["sleep_score"] - 5).clip(0, 10).values)
    np.testing.assert_allclose(got["fatigue"], (pdf["fatigue"] + 0.4).clip(0, 1).values)
    assert (got["low_morale"] == 1).all() and (got["acft_failure"] == 0).all()
    assert (got["OPTEMPO"].values == pdf["OPTEMPO"].values).all()


def test_zero_shift_changes_nothing(soldiers):
    same = U.apply_scenario(soldiers, BASE, dict(BASE)).select(soldiers.columns)
    moved = same.join(soldiers.select("soldier_id", *[F.col(c).alias(f"o_{c}") for c in BASE]), "soldier_id")
    for c in BASE:
        assert moved.select(F.max(F.abs(F.col(c) - F.col(f"o_{c}")))).first()[0] < 1e-9


def test_shift_one_column(soldiers, pdf):
    got = U.shift_column(soldiers, "sleep_score", 1.5, 0, 10).agg(F.avg("sleep_score")).first()[0]
    assert got == pytest.approx((pdf.sleep_score + 1.5).clip(0, 10).mean())
    assert U.shift_column(soldiers, "absent", 1, 0, 1).columns == soldiers.columns


def test_before_after_inline_and_pipeline_agree(soldiers, pdf):
    inputs = U.scenario_inputs(soldiers, BASE, {"stress_score": 60.0, "sleep_score": 3.0})
    got = {r.risk: r for r in U.before_after(soldiers, {"a": A, "b": B}, inputs, {"a": 0.6}).collect()}
    after = pdf.assign(stress_score=(pdf.stress_score + 20).clip(0, 100), sleep_score=(pdf.sleep_score - 3).clip(0, 10))
    assert got["a"].baseline_avg_prob == pytest.approx(prob(A, pdf).mean())
    assert got["b"].after_avg_prob == pytest.approx(prob(B, after).mean())
    assert got["a"].delta == pytest.approx((prob(A, after) >= 0.6).mean() - (prob(A, pdf) >= 0.6).mean())
    report = U.before_after_report(soldiers, {"a": A, "b": B}, inputs).collect()
    assert report[0].change_pp <= report[1].change_pp
    assert {r.risk: r.baseline_pct for r in report}["a"] == round(prob(A, pdf).mean() * 100, 1)

    spec = FeatureSpec(("stress_score", "sleep_score"), ("rank",))
    data = soldiers.withColumn("y", F.col("ucmj"))
    prep = P.fit_preparation(data, spec)
    model = M.with_preparation(prep, M.fit_logistic(P.prepare(prep, data), "y"))
    other = M.with_preparation(prep, M.fit_logistic(P.prepare(prep, data), "high_burnout_risk"))
    from rosterlens.operators.scoring import linear_score

    piped = U.before_after(soldiers, {"m": model, "o": other}, inputs).toPandas().set_index("risk")
    inline = U.before_after(
        soldiers, {"m": linear_score(model, spec), "o": linear_score(other, spec)}, inputs
    ).toPandas().set_index("risk")
    np.testing.assert_allclose(piped.loc[["m", "o"]], inline.loc[["m", "o"]], atol=1e-9)


def test_mean_rates(soldiers, pdf):
    got = {r.risk: r.mean_rate for r in U.mean_rates(soldiers, {"a": A, "b": B}).collect()}
    assert got["a"] == pytest.approx(prob(A, pdf).mean()) and got["b"] == pytest.approx(prob(B, pdf).mean())
