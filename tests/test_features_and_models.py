import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rosterlens.operators import features as P
from rosterlens.operators import models as M
from rosterlens.operators.scoring import LinearScore, add_scores, coefficient_table, linear_score
from rosterlens.schema import FeatureSpec


def matrix(prep, df, key="id"):
    rows = P.prepare(prep, df).orderBy(key).select(vector_to_array("features").alias("v")).collect()
    return np.array([r.v for r in rows])


def test_scaling_uses_population_std_and_zero_for_constants(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in (1, 2, 3, 4)], "id int, x double, k double")
    spec = FeatureSpec(("x", "k"))
    prep = P.fit_preparation(df, spec)
    x = np.array([1, 2, 3, 4.0])
    np.testing.assert_allclose(matrix(prep, df), np.c_[(x - 2.5) / x.std(), np.zeros(4)])
    assert P.scaling(prep, spec)["x"] == pytest.approx((2.5, x.std())) and P.scaling(prep, spec)["k"][1] == 0


def test_encoding_drops_first_level_and_zeroes_unknown(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "id int, x string")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "new"), (5, None)], "id int, x string")
    spec = FeatureSpec((), ("x",))
    prep = P.fit_preparation(train, spec)
    assert matrix(prep, test).tolist() == [[0, 0], [1, 0], [0, 1], [0, 0], [0, 0]]
    assert P.feature_names(prep, spec) == ["cat__x_b", "cat__x_c"]
    assert P.category_levels(prep, spec) == {"x": ["a", "b", "c"]}


def test_vector_order_and_names(soldiers):
    spec = FeatureSpec(("stress_score", "fatigue"), ("rank", "morale"))
    prep = P.fit_preparation(soldiers, spec)
    names = P.feature_names(prep, spec)
    assert names[:3] == ["num__stress_score", "num__fatigue", "cat__rank_E-5"] and len(names) == 2 + 2 + 3
    wide = P.feature_columns(P.prepare(prep, soldiers), names).toPandas()
    pdf = wide
    np.testing.assert_allclose(pdf["cat__morale_low"], (pdf["morale"] == "low").astype(float))
    np.testing.assert_allclose(
        pdf["num__fatigue"], (pdf["fatigue"] - pdf["fatigue"].mean()) / pdf["fatigue"].std(ddof=0), atol=1e-9
    )


def test_one_level_category_adds_no_column(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id int, x string, n double")
    spec = FeatureSpec(("n",), ("x",))
    assert P.feature_names(P.fit_preparation(df, spec), spec) == ["num__n"]


def test_too_many_levels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_LEVELS", 50)
    df = spark.range(200).select("id", F.col("id").cast("string").alias("x"))
    with pytest.raises(ValueError, match="too many levels.*x"):
        P.fit_preparation(df, FeatureSpec((), ("x",)))


def test_ordinal(spark):
    df = spark.createDataFrame([("CL0",), ("CL2",), ("?",), (None,)], "x string")
    assert [r.o for r in P.ordinal(df, "x", ["CL0", "CL1", "CL2"], "o").collect()] == [0, 2, None, None]


@pytest.fixture(scope="module")
def logistic(soldiers):
    spec = FeatureSpec(("stress_score", "sleep_score"), ("rank",))
    data = soldiers.select("soldier_id", *spec.columns, F.col("ucmj").alias("y")).persist()
    prep = P.fit_preparation(data, spec)
    prepared = P.prepare(prep, data).persist()
    return spec, data, prep, prepared, M.fit_logistic(prepared, "y")


def test_logistic_solves_the_balanced_penalised_problem(logistic):
    _, _, _, prepared, model = logistic
    rows = prepared.select(vector_to_array("features").alias("v"), "y").collect()
    x, y = np.array([r.v for r in rows]), np.array([r.y for r in rows])
    beta, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b)))
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    gradient = x.T @ (w * (p - y)) + beta
    assert np.abs(gradient).max() < 1e-2 * len(y) / 400 and abs((w * (p - y)).sum()) < 1e-2
    # Newton's method on the same objective
    z = np.c_[x, np.ones(len(y))]
    theta, penalty = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 0]
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ theta))
        hess = (z * (w * q * (1 - q))[:, None]).T @ z + np.diag(penalty)
        theta -= np.linalg.solve(hess, z.T @ (w * (q - y)) + penalty * theta)
    np.testing.assert_allclose(np.r_[beta, b], theta, atol=1e-4)


def test_logistic_needs_two_classes(spark, logistic):
    _, _, _, prepared, _ = logistic
    with pytest.raises(ValueError, match="only one class"):
        M.fit_logistic(prepared.filter("y = 1"), "y")


def test_inline_score_equals_the_pipeline(logistic):
    spec, data, prep, _, fitted = logistic
    model = M.with_preparation(prep, fitted)
    inline = linear_score(model, spec)
    both = add_scores(data, {"a": inline, "b": model}).select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert both < 1e-9
    gaps = data.withColumns({"stress_score": F.lit(None).cast("double"), "rank": F.lit(None).cast("string")})
    for frame, scored in ((gaps, 0), (data.withColumn("rank", F.lit(None).cast("string")), data.count())):
        found = add_scores(frame, {"a": inline, "b": model})
        assert [found.filter(F.col(c).isNotNull()).count() for c in "ab"] == [scored, scored]
    table = {r.feature: r.coef for r in coefficient_table(model, spec).collect()}
    assert list(table) == ["num__stress_score", "num__sleep_score", "cat__rank_E-5", "cat__rank_E-6"]


def test_inputs_change_only_the_score(logistic):
    spec, data, prep, _, fitted = logistic
    model = M.with_preparation(prep, fitted)
    inputs = {"stress_score": F.col("stress_score") + 5, "rank": F.lit("E-6")}
    out = add_scores(data, {"m": model, "i": linear_score(model, spec)}, {"m": "m2", "i": "i2"}, inputs)
    assert out.columns == [*data.columns, "i2", "m2"]
    assert out.select(F.max(F.abs(F.col("m2") - F.col("i2")))).first()[0] < 1e-9
    assert out.select(*data.columns).exceptAll(data).count() == 0


def test_linear_regression_equals_least_squares(soldiers):
    spec = FeatureSpec(("stress_score", "sleep_score", "low_morale"), ("morale",))  # collinear on purpose
    data = soldiers.select("soldier_id", *spec.columns, "soldier_readiness")
    model = M.fit_regressor(data, spec, M.linear_learner("soldier_readiness"))
    pdf = model.transform(data).select("soldier_id", "prediction", "soldier_readiness", *spec.columns).toPandas()
    x = np.c_[pdf[list(spec.numeric)], pd.get_dummies(pdf["morale"]).iloc[:, 1:].astype(float), np.ones(len(pdf))]
    best = x @ np.linalg.lstsq(x.astype(float), pdf["soldier_readiness"], rcond=None)[0]
    np.testing.assert_allclose(pdf["prediction"], best, atol=1e-4)


def test_clamped_score_and_null_input(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -5.0), (3, None)], "id int, x double")
    m = LinearScore(0.0, (("x", 0.0, 1.0, 1.0), ("x", 0.0, 0.0, 9.0)), link="identity")
    got = add_scores(df, {"a": m.clamped(), "b": m}, bounds={"b": (-1.0, 2.0)}).orderBy("id").collect()
    assert [r.a for r in got] == [1.0, 0.0, None] and [r.b for r in got] == [2.0, -1.0, None]


def test_written_out_features_equal_those_of_the_stages(spark, monkeypatch):
    rows = [(1, 1.5, 2, 7.0, "a", 3), (2, -0.5, 4, 7.0, "b", 5), (3, 9.25, 1, 7.0, "c", 3), (4, 0.1, 8, 7.0, "b", 9)]
    kinds = "id int, x double, n int, same double, word string, code int"
    spec = FeatureSpec(("x", "n", "same"), ("word", "code"))
    prep = P.fit_preparation(spark.createDataFrame(rows, kinds), spec)
    more = spark.createDataFrame([*rows, (5, None, 3, 1.0, None, None), (6, 2.0, 0, 7.0, "new", 4), (7, float("nan"), 1, 7.0, "c", 5)], kinds)
    out = P.prepare(prep, more)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 1  # a vector is made once
    monkeypatch.setattr(P, "WRITTEN_OUT", 0)
    stages = P.prepare(prep, more)
    assert out.schema["features"].metadata == stages.schema["features"].metadata
    for a, b in zip(out.orderBy("id").collect(), stages.orderBy("id").collect()):
        np.testing.assert_array_equal(a["features"].toArray(), b["features"].toArray())
