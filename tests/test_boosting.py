import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rosterlens.operators import boosting as B
from rosterlens.operators import evaluate as E
from rosterlens.operators import models as M
from rosterlens.operators.attribution import tree_attribution
from rosterlens.operators.explain import forest_importance
from rosterlens.operators.features import feature_names, fit_preparation, prepare
from rosterlens.operators.split import assign_folds
from rosterlens.schema import FeatureSpec

SPEC = FeatureSpec(("stress_score", "sleep_score", "fatigue"), ("rank", "morale"))
LABEL = "soldier_readiness"


@pytest.fixture(scope="module")
def data(soldiers):
    return soldiers.select("soldier_id", *SPEC.columns, LABEL).persist()


def brute(x, y, rounds, depth, rate, penalty, start, used=None):
    """All splits at all values, one node after the other; ``used`` are the rows fitted on."""
    p, used = np.full(len(y), start), np.arange(len(y)) if used is None else used

    def node(all_, fit, level):
        g, h = p[fit] - y[fit], len(fit)
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[fit, f])[:-1]:
                    low = x[fit, f] <= cut
                    gain = g[low].sum() ** 2 / (low.sum() + penalty) + g[~low].sum() ** 2 / ((~low).sum() + penalty) - g.sum() ** 2 / (h + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            step[all_] = -rate * g.sum() / (h + penalty)
            return
        f, cut = best[1]
        for side in (True, False):
            node(all_[(x[all_, f] <= cut) == side], fit[(x[fit, f] <= cut) == side], level + 1)

    for _ in range(rounds):
        step = np.zeros(len(y))
        node(np.arange(len(y)), used, 0)
        p = p + step
    return p


def coarse(data):
    """Few distinct values, so that bins hold one value each."""
    return data.withColumns({c: F.round(F.col(c) * 10 / F.lit(v)) for c, v in (("stress_score", 100), ("sleep_score", 10), ("fatigue", 1))})


def matrices(prepared, *more):
    rows = prepared.select(vector_to_array("features").alias("x"), LABEL, *more).collect()
    return (np.array([r.x for r in rows]), np.array([r[LABEL] for r in rows], float), rows)


def test_trees_equal_brute_force(data):
    rows = coarse(data)
    learner = M.regularised_learner(LABEL, rounds=3, depth=3, rate=0.3, share=1.0, penalty=2.0)
    prep, model = M.fit_regressor(rows, SPEC, learner).stages
    x, y, out = matrices(model.transform(prepare(prep, rows)), "prediction")
    np.testing.assert_allclose([r.prediction for r in out], brute(x, y, 3, 3, 0.3, 2.0, y.mean()), atol=1e-7)


def test_folds_in_the_same_passes_equal_brute_force(data):
    rows = assign_folds(coarse(data), "soldier_id", 3)
    s = B.Settings(rounds=2, depth=2, rate=0.5, row_share=1.0, column_share=1.0)
    got = {r.fold: r for r in B.cross_validate_boosted(rows, SPEC, LABEL, "fold", 3, s).collect()}
    x, y, out = matrices(prepare(fit_preparation(rows, SPEC), rows), "fold")
    fold = np.array([r.fold for r in out])
    for i in range(3):
        p = brute(x, y, 2, 2, 0.5, 1.0, y[fold != i].mean(), np.flatnonzero(fold != i))
        error = (p - y)[fold == i]
        assert got[i].n == len(error) and got[i].rmse == pytest.approx(np.sqrt((error**2).mean()), abs=1e-7)
        assert got[i].r2 == pytest.approx(1 - (error**2).sum() / ((y - y[fold == i].mean())[fold == i] ** 2).sum(), abs=1e-6)


def test_trees_do_not_depend_on_the_order_of_rows(data):
    learner = M.regularised_learner(LABEL, rounds=4, depth=4)
    prepared = prepare(fit_preparation(data, SPEC), data).persist()
    one = learner.fit(prepared.repartition(7, "rank")).getOrDefault("trees")
    assert one == learner.fit(prepared.coalesce(1).orderBy(F.desc("fatigue"))).getOrDefault("trees")


def test_more_rounds_fit_better_and_samples_differ(data):
    prepared = prepare(fit_preparation(data, SPEC), data).persist()

    def rmse(**s):
        model = M.regularised_learner(LABEL, **s).fit(prepared)
        return model, E.regression_metrics(model.transform(prepared), LABEL, "prediction").first().rmse

    few, many = rmse(rounds=3, depth=4), rmse(rounds=30, depth=4)  # over a checkpoint
    assert many[1] < 0.7 * few[1]
    columns = [set(t.tolist()) for t in (B.drawn_columns(10, 0.5, 0, r, 1) for r in range(20))]
    assert all(len(c) == 5 for c in columns) and len(set(map(frozenset, columns))) > 10
    hashes = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    samples = [B.drawn(hashes, r, 42, 0.9) for r in range(2)]
    assert all(abs(s.mean() - 0.9) < 0.01 for s in samples) and 0.15 < (samples[0] ^ samples[1]).mean() < 0.21


def test_saved_and_loaded_model_explains_itself(data, tmp_path):
    model = M.fit_regressor(data, SPEC, M.regularised_learner(LABEL, rounds=5, depth=3))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    prepared = prepare(again.stages[0], data)
    both = again.stages[1].transform(prepared).select("soldier_id", "prediction")
    same = model.transform(data).select("soldier_id", F.col("prediction").alias("p")).join(both, "soldier_id")
    assert same.count() == 400 and same.where("p != prediction").count() == 0
    assert forest_importance(again, SPEC, 99).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    values, expected = tree_attribution(prepared, "soldier_id", again.stages[1], feature_names(again.stages[0], SPEC))
    total = values.groupBy("soldier_id").agg(F.sum("value").alias("v")).join(both, "soldier_id")
    assert total.where(F.abs(F.col("v") + expected - F.col("prediction")) > 1e-9).count() == 0


def test_odd_tables(data):
    prepared = prepare(fit_preparation(data, SPEC), data)
    flat = M.regularised_learner("one", rounds=2, depth=2).fit(prepared.withColumn("one", F.lit(3.0)))
    assert {r.prediction for r in flat.transform(prepared).collect()} == {3.0}
    gaps = prepared.withColumn("y", F.when(F.col("rank") != "E-4", F.col(LABEL)))
    known = M.regularised_learner("y", rounds=2, depth=2).fit(gaps).getOrDefault("trees")
    assert known == M.regularised_learner("y", rounds=2, depth=2).fit(gaps.where("y is not null")).getOrDefault("trees")
    with pytest.raises(ValueError, match="no rows"):
        M.regularised_learner("y").fit(gaps.where("y is null"))


def test_nodes_of_rows_by_whole_levels():
    """Trees of few levels compare all rows at every split; rows come where a walk down the tree takes them."""
    r = np.random.default_rng(5)
    for depth, rows, share in ((0, 9, 1), (1, 0, 1), (3, 200, 0.7), (4, 200, 1), (8, 200, 0.9), (9, 200, 1)):
        t = B.Tree(depth)
        for i in range(2**depth - 1):
            if r.random() < share and (not i or t.feature[(i - 1) // 2] >= 0):
                t.feature[i], t.bin[i] = r.integers(3), r.integers(255)
        t.value = r.normal(size=len(t.value))
        codes = r.integers(0, 256, (3, rows)).astype(np.uint8)
        want = []
        for row in codes.T:
            i = 0
            while i < 2**depth - 1 and t.feature[i] >= 0:
                i = 2 * i + 1 + int(row[t.feature[i]] > t.bin[i])
            want.append(i)
        assert t.nodes_of(codes).tolist() == want
        assert t.values_of(codes).tolist() == t.value[want].tolist()


def test_a_task_of_a_level_has_many_rows_and_sends_a_cell_once(spark, monkeypatch):
    """Levels were passes of as many tasks as the input had parts, each with cells for every block."""
    r = np.random.default_rng(6)
    rows = spark.createDataFrame([(float(r.normal()), float(r.normal())) for _ in range(600)], "a double, y double").repartition(40)
    prepared = prepare(fit_preparation(rows, FeatureSpec(("a",), ())), rows)
    s = B.Settings(rounds=2, depth=3, rate=0.3, bins=16)
    fitted = B.boost(prepared, "y", s)
    assert fitted.state.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    want = [(t.feature.tolist(), t.bin.tolist(), t.value.tolist()) for t in fitted.trees[0]]
    monkeypatch.setattr(B, "TASK_CELLS", 0)
    assert [(t.feature.tolist(), t.bin.tolist(), t.value.tolist()) for t in B.boost(prepared, "y", s).trees[0]] == want
