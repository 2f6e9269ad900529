import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import charts, profile, quantiles, screening
from rosterlens.operators.quantiles import approximate_quantiles, exact_quantiles, quantile


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame(
        {
            "rank": np.where(rng.uniform(size=n) < 0.4, "hot", rng.integers(0, 9, n).astype(str)),
            "smooth": rng.normal(0, 1, n),
            "skewed": np.exp(rng.normal(0, 9, n)),
            "ties": rng.integers(0, 4, n).astype(float),
            "constant": 5.0,
            "gaps": np.where(rng.uniform(size=n) < 0.3, np.nan, rng.uniform(-1e9, 1e9, n)),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(8).persist()


COLS = ["smooth", "skewed", "ties", "constant", "gaps"]
PROBS = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("sort_rows", [10**9, 20])
def test_exact_quantiles_equal_pandas(numbers, sort_rows):
    pdf, df = numbers
    got = exact_quantiles(df, COLS, PROBS, sort_rows=sort_rows).collect()
    assert len(got) == len(COLS) * len(PROBS)
    for r in got:
        assert r["quantile"] == pytest.approx(pdf[r["column"]].quantile(r["prob"]), rel=1e-12)


@pytest.mark.parametrize("sort_rows", [10**9, 20])
def test_exact_quantiles_by_group(numbers, sort_rows):
    pdf, df = numbers
    got = exact_quantiles(df, ["gaps", "ties"], [0.25, 0.5], ["rank"], sort_rows=sort_rows).collect()
    assert len(got) == 2 * 2 * pdf["rank"].nunique()
    for r in got:
        want = pdf.loc[pdf["rank"] == r["rank"], r["column"]].quantile(r["prob"])
        assert r["quantile"] == pytest.approx(want, rel=1e-12)


def test_quartiles_by_hand(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "v double")
    assert quantile(df, "v", 0.25) == 1.75
    assert quantile(df.filter("v is null"), "v", 0.25) is None
    row = profile.numeric_profile(df, ["v"]).first()
    assert (row["count"], row["q25"], row["q50"], row["q75"]) == (4, 1.75, 2.5, 3.25)
    assert row["std"] == pytest.approx(1.2909944)


def test_approximate_quantiles_are_close(numbers):
    pdf, df = numbers
    got = {r["prob"]: r["quantile"] for r in approximate_quantiles(df, ["smooth"], [0.1, 0.9]).collect()}
    for p, q in got.items():
        assert abs((pdf["smooth"] <= q).mean() - p) < 0.005


def test_numeric_profile_equals_pandas(numbers):
    pdf, df = numbers
    got = profile.numeric_profile(df, COLS).toPandas().set_index("column")
    want = pdf[COLS].describe().T
    for mine, theirs in zip(["count", "mean", "std", "min", "q25", "q50", "q75", "max"], want.columns):
        np.testing.assert_allclose(got.loc[COLS, mine].astype(float), want[theirs], rtol=1e-9, atol=1e-12)


def test_text_profile_and_counts(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", None), ("b", None), (None, None)], "s string, t string")
    got = {r["column"]: tuple(r)[1:] for r in profile.text_profile(df).collect()}
    assert got == {"s": (4, 2, "a", 2), "t": (2, 1, "x", 2)}
    counts = [tuple(r) for r in profile.category_counts(df, ["s", "nope"]).collect()]
    assert counts == [("s", "a", 2), ("s", "b", 2)]


def test_null_report_and_missing_rates(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, None)], "v double, s string")
    assert [(r["column"], r["dtype"], r["non_null"]) for r in profile.null_report(df).orderBy("position").collect()] == [
        ("v", "double", 1), ("s", "string", 1),
    ]
    assert [(r[0], round(r[1], 3)) for r in profile.missing_rates(df).collect()] == [("s", 0.667), ("v", 0.667)]
    assert profile.missing_rates(df, n=1).count() == 1


def test_rate_by_group_drops_missing_and_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0), (None, 1), ("c", None)], "g string, f int")
    assert [tuple(r) for r in profile.observed_rate_by_group(df, "g", "f", 2).collect()] == [
        ("a", 1, 1.0, 100.0), ("b", 1, 1.0, 100.0),
    ]


def test_rates_shares_summaries(spark):
    df = spark.createDataFrame([(0.2, 1, "a"), (0.4, 0, "a"), (None, 0, "b")], "s double, f int, g string")
    row = profile.kpi_rates(df, ["s", "zz"], ["f"]).first()
    assert row.s == pytest.approx(30) and row.f == pytest.approx(100 / 3)
    assert sorted((r.f, r.n, round(r.proportion, 3)) for r in profile.class_share(df, "f").collect()) == [(0, 2, 0.667), (1, 1, 0.333)]
    got = profile.group_summary(df, "g", "s").collect()
    assert len(got) == 1 and got[0].n == 2 and got[0]["var"] == pytest.approx(0.02)
    assert tuple(profile.shape(df).first()) == (3, 3)
    assert [r.s for r in profile.roster_topk(df, "s", "g", 5).collect()] == [0.4, 0.2]


def test_prediction_percentiles(numbers):
    pdf, df = numbers
    row = profile.prediction_percentiles(df, "smooth").first()
    np.testing.assert_allclose([row.p10, row.p50, row.p90], np.percentile(pdf["smooth"], [10, 50, 90]))
    rough = profile.prediction_percentiles(df, "smooth", exact=False).first()
    assert abs(rough.p50 - row.p50) < 0.05


def test_histogram_equals_numpy(numbers):
    pdf, df = numbers
    got = charts.histogram(df, "smooth").orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf["smooth"], bins=30)
    assert got["n"].tolist() == counts.tolist()
    np.testing.assert_allclose(got["lo"], edges[:-1])


def test_histogram_of_constant_and_empty(numbers, spark):
    _, df = numbers
    got = charts.histogram(df, "constant").orderBy("bin").toPandas()
    assert got["n"].tolist() == np.histogram(np.full(5000, 5.0), bins=30)[0].tolist()
    assert charts.histogram(df.filter("false"), "smooth").count() == 0


def test_box_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 7.0), (None, 1.0)], "g string, v double")
    got = {r.g: r for r in charts.box_by_group(df, "g", "v").collect()}
    a = got["a"]
    assert (a.q25, a.q50, a.q75, a.whisker_low, a.whisker_high, a.n_outliers, a.n) == (2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)
    assert got["b"].n_outliers == 0 and len(got) == 2


def test_density_integrates_to_group_share(numbers):
    pdf, df = numbers
    got = charts.density_by_group(df, "smooth", "ties").toPandas()
    for g, curve in got.groupby("ties"):
        curve = curve.sort_values("x")
        assert len(curve) == 200
        share = (pdf["ties"] == g).mean()
        assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(share, rel=2e-3)
    exact = charts.density_by_group(df, "smooth").orderBy("point").toPandas()
    rough = charts.density_by_group(df, "smooth", pre_bins=2000).orderBy("point").toPandas()
    np.testing.assert_allclose(exact["density"], rough["density"], atol=1e-4)
    x0, bw = exact["x"][100], pdf["smooth"].std() * len(pdf) ** -0.2
    want = np.exp(-0.5 * ((x0 - pdf["smooth"]) / bw) ** 2).sum() / (len(pdf) * bw * np.sqrt(2 * np.pi))
    assert exact["density"][100] == pytest.approx(want)


def test_quantiles_of_hard_values_in_few_rounds(spark):
    r = np.random.default_rng(0)
    sets = {
        "endless": np.r_[r.normal(size=1990), np.full(10, np.inf)],
        "wide": 10.0 ** r.uniform(-250, 250, 2000),
        "hot": np.r_[np.full(1500, 3.0), r.normal(size=500)],
        "below": np.r_[np.full(50, -np.inf), r.normal(size=1950)],
    }
    df = spark.createDataFrame(pd.DataFrame(sets))
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    found, rounds = quantiles._search(quantiles.long_values(df, list(sets)), ["column"], probs, 20)
    assert 1 <= rounds <= 5
    got = {(x["column"], x["prob"]): x["quantile"] for x in found.collect()}
    for c, v in sets.items():
        v = np.sort(v)
        for p in probs:
            at = p * (len(v) - 1)
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert got[c, p] == pytest.approx(low if low == high else low + (high - low) * (at - np.floor(at)), rel=1e-12)


def test_pair_grid_says_how_much_it_shows(numbers):
    _, df = numbers
    keyed = df.withColumn("id", F.monotonically_increasing_id()).select("id", "smooth", "ties", "rank").persist()
    points = charts.pair_points(keyed, "id", ["smooth", "ties", "zz"], "rank", 40)
    curves = charts.pair_grid_diagonal(keyed, ["smooth", "ties", "zz"], "rank")
    cells = charts.pair_grid(keyed, ["smooth", "ties"], "rank", 4)
    assert {(r.x_name, r.n) for r in cells.groupBy("x_name").agg(F.sum("n").alias("n")).collect()} == {("smooth", 5000), ("ties", 5000)}
    assert points.count() == 2 * 40
    assert {(r.n_shown, r.n_total) for r in points.select("n_shown", "n_total").distinct().collect()} == {(40, 5000)}
    assert {r["column"] for r in curves.select("column").distinct().collect()} == {"smooth", "ties"}


def test_screening(numbers, spark):
    pdf, df = numbers
    z = screening.normalise(df, ["smooth", "constant"]).agg(F.avg("smooth"), F.stddev_pop("smooth"), F.max("constant")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1) and z[2] == 0.0
    m = screening.normalise(df, ["smooth"], "minmax").agg(F.min("smooth"), F.max("smooth")).first()
    assert tuple(m) == (0.0, 1.0)
    with pytest.raises(ValueError):
        screening.normalise(df, ["smooth"], "rank")
    out = {r["column"]: r.n_outside for r in screening.outlier_counts(df, ["smooth"]).collect()}
    q1, q3 = pdf["smooth"].quantile([0.25, 0.75])
    beyond = (pdf["smooth"] < q1 - 1.5 * (q3 - q1)) | (pdf["smooth"] > q3 + 1.5 * (q3 - q1))
    assert out["smooth"] == beyond.sum()
    assert screening.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).collect()[0].n == 2
    total = screening.row_total(spark.createDataFrame([(1.0, None), (3.0, 4.0)], "a double, b double"), ["a", "b"], "t", 5, {"low": 0, "high": 6})
    assert [(r.t, r.t_heavy, r.t_label) for r in total.collect()] == [(1.0, 0, "low"), (7.0, 1, "high")]
