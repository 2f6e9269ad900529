import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import association, charts, screening
from rosterlens.schema import FeatureSpec


def test_components_equal_a_decomposition(soldiers):
    spec = FeatureSpec(("stress_score", "sleep_score", "fatigue", "age"), ("rank",))
    shares, loadings = screening.principal_components(soldiers.repartition(9), spec, 3)
    rows = soldiers.select(*spec.columns).toPandas()
    x = rows[list(spec.numeric)].to_numpy(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    levels = sorted(rows["rank"].unique())[1:]
    x = np.concatenate([x, np.stack([(rows["rank"] == v).to_numpy(float) for v in levels], axis=1)], axis=1)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    order = np.argsort(-values)[:3]
    assert [r.share for r in shares.orderBy("component").collect()] == pytest.approx((values[order] / values.sum()).tolist())
    for i, o in enumerate(order):
        got = np.array([r.loading for r in loadings.where(F.col("component") == i + 1).collect()])
        assert abs(got @ vectors[:, o]) == pytest.approx(1, abs=1e-9) and got[np.abs(got).argmax()] > 0


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_density_is_within_its_bound_of_the_kernel_sum(spark, scale):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=700), rng.normal(30, 0.1, size=50), [500.0]]) * scale  # a gap and a far row
    rows = [("a", float(x)) for x in v] + [("b", float(x)) for x in rng.uniform(0, 5, 40)]
    got = charts.density_by_group(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g", points=300).toPandas()
    for name, own in got.groupby("g"):
        own = own.sort_values("point")
        x = np.array([b for a, b in rows if a == name])
        bw = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((own["x"].to_numpy()[:, None] - x) / bw) ** 2).sum(axis=1) / (len(rows) * bw * np.sqrt(2 * np.pi))
        assert len(own) == 300
        np.testing.assert_allclose(own["density"], want, atol=1e-11 * len(x) / (len(rows) * bw))


def test_cells_do_not_depend_on_how_rows_are_counted(soldiers, monkeypatch):
    pairs = [("rank", "mos"), ("rank", "morale"), ("morale", "soldier_id")]
    want = sorted(map(tuple, association._cells(soldiers, pairs).collect()))
    assert sum(r[4] for r in want) == 3 * soldiers.count()
    monkeypatch.setattr(association, "COUNTED_ROWS", 7)
    assert want == sorted(map(tuple, association._cells(soldiers.repartition(3), pairs).collect()))
    direct = soldiers.groupBy("rank", "mos").count().collect()
    assert sorted((r["rank"], r["mos"], r["count"]) for r in direct) == sorted(r[2:] for r in want if r[:2] == ("rank", "mos"))


def test_rows_keep_their_tasks_while_triangles_meet_in_few(spark, tmp_path):
    seen = str(tmp_path)

    @F.udf("double")
    def told(i):
        import os

        from pyspark import TaskContext

        open(os.path.join(seen, f"{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}"), "w").close()
        return float(i * i % 17)

    rows = spark.range(640).repartition(32, "id").select("id", F.rand(1).alias("x"), told.asNondeterministic()("id").alias("y"))
    shares, _ = screening.principal_components(rows, FeatureSpec(("x", "y")), 1)
    stages = [name.partition("-")[0] for name in __import__("os").listdir(seen)]
    assert shares.count() == 1 and all(stages.count(s) == 32 for s in set(stages))
