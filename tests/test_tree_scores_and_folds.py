import pytest
from pyspark.sql import functions as F

from rosterlens.operators import evaluate as E
from rosterlens.operators import models as M
from rosterlens.operators import scoring as SC
from rosterlens.operators import units as U
from rosterlens.operators.foldstats import cross_validate_linear
from rosterlens.operators.split import assign_folds
from rosterlens.schema import FeatureSpec

SPEC = FeatureSpec(("stress_score", "sleep_score", "fatigue"), ("rank", "morale"))
LABEL = "soldier_readiness"


@pytest.fixture(scope="module")
def data(soldiers):
    return soldiers.select("soldier_id", *SPEC.columns, LABEL, "brigade_level").persist()


@pytest.fixture(scope="module", params=["forest", "mllib", "own"])
def model(data, request):
    learner = {
        "forest": M.forest_learner(LABEL, trees=4, depth=4),
        "mllib": M.boosted_learner(LABEL, rounds=3, depth=3),
        "own": M.regularised_learner(LABEL, rounds=3, depth=3),
    }[request.param]
    return M.fit_regressor(data, SPEC, learner)


@pytest.mark.parametrize("written", [0, 10_000])
def test_columns_score_as_the_pipeline(data, model, written, monkeypatch):
    monkeypatch.setattr(SC, "WRITTEN_NODES", written)
    score = SC.tree_score(model, SPEC)
    assert set(score.columns) == set(SPEC.columns)
    gaps = data.withColumn("fatigue", F.when(F.col("soldier_id") > "s00020", F.col("fatigue")))
    changed = {"stress_score": F.col("stress_score") * 0.5, "rank": F.lit("E-5"), "morale": F.lit("unheard of")}
    both = SC.add_scores(gaps, {"piped": model, "inline": score})
    both = SC.add_scores(both, {"piped": model, "inline": score}, {"piped": "p2", "inline": "i2"}, changed)
    rows = both.select("piped", "inline", "p2", "i2").collect()
    assert len(rows) == 400 and sum(r.inline is None for r in rows) == sum(r.piped is None for r in rows) > 0
    for r in rows:
        assert r.inline == pytest.approx(r.piped, abs=1e-12) and r.i2 == pytest.approx(r.p2, abs=1e-12)
    assert any(r.i2 != r.inline for r in rows)


def test_before_and_after_in_one_scan(data, model):
    score = SC.tree_score(model, SPEC)
    inputs = {"stress_score": F.least(F.col("stress_score") + 30, F.lit(100.0))}
    got = U.before_after(data, {"m": score}, inputs)
    want = U.before_after(data, {"m": model}, inputs).first()
    assert tuple(got.first())[1:] == pytest.approx(tuple(want)[1:], abs=1e-12)
    assert got._jdf.queryExecution().analyzed().collectLeaves().size() == 1


@pytest.mark.parametrize("spec", [SPEC, FeatureSpec(("stress_score", "sleep_score"), ()), FeatureSpec((), ("rank",))])
def test_folds_by_sums_equal_refitting(data, spec):
    folded = assign_folds(data, "soldier_id", 4)
    want = {r.fold: r for r in E.cross_validate(folded, spec, M.linear_learner(LABEL), LABEL, "fold", 4).collect()}
    got = cross_validate_linear(folded, spec, LABEL, "fold", 4).collect()
    assert len(got) == 4
    for r in got:
        w = want[r.fold]
        assert (r.n, r.rmse, r.r2) == (w.n, pytest.approx(w.rmse, rel=1e-7), pytest.approx(w.r2, abs=1e-7))


def test_levels_and_constants_of_one_fold(data):
    """A level that only one fold has, and a number that is constant elsewhere."""
    folded = assign_folds(data, "soldier_id", 3).withColumns(
        {
            "rank": F.when(F.col("fold") == 0, F.lit("A-only")).otherwise(F.col("rank")),
            "fatigue": F.when(F.col("fold") == 1, F.col("fatigue")).otherwise(F.lit(0.5)),
        }
    )
    want = {r.fold: r for r in E.cross_validate(folded, SPEC, M.linear_learner(LABEL), LABEL, "fold", 3).collect()}
    for r in cross_validate_linear(folded, SPEC, LABEL, "fold", 3).collect():
        assert r.rmse == pytest.approx(want[r.fold].rmse, rel=1e-6)
