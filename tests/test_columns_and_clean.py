import pytest
from pyspark.sql import functions as F

from rosterlens import schema as S
from rosterlens.functions import columns as C
from rosterlens.operators import clean
from rosterlens.operators.models import make_target
from rosterlens.schema import TargetSpec
from rosterlens.sources import tables

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [("a", 1.0, "Low"), ("b", None, "POOR"), ("c", NAN, None), ("d", 0.5, "high"), ("e", 0.2, "low")]
    return spark.createDataFrame(rows, "id string, x double, s string").persist()


def values(df, *cols):
    return [tuple(r) for r in df.orderBy("id").select(*cols).collect()]


def test_comparison_with_missing_is_false(gaps):
    got = values(gaps.select("id", C.flag_below("x", 0.6).alias("b"), C.flag_at_most("x", 0.5).alias("m")), "b", "m")
    assert got == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 1)]


def test_flag_at_most_without_cut(gaps):
    assert values(gaps.select("id", C.flag_at_most("x", None).alias("m")), "m") == [(0,)] * 5


def test_set_flag_ignores_case_and_missing(gaps):
    assert values(gaps.select("id", C.flag_in_set("s", ["low", "Poor"]).alias("f")), "f") == [(1,), (1,), (0,), (0,), (1,)]


def test_ready_label_of_missing_is_not_ready(gaps):
    got = values(gaps.select("id", C.cut_label("x", 0.5, "ready", "not_ready").alias("l")), "l")
    assert [g[0] for g in got] == ["ready", "not_ready", "not_ready", "ready", "not_ready"]


def test_clip_keeps_missing(gaps):
    assert values(clean.complete_cases(gaps, []).select("id", C.clip(C.number("x"), 0.3, 0.6).alias("c")), "c") == [
        (0.6,), (None,), (None,), (0.5,), (0.3,),
    ]


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.4,), (0.39,), (None,)], "p double")
    assert [r[0] for r in df.select(C.risk_band("p")).collect()] == ["high", "moderate", "moderate", "lower", None]


def test_observed_rate(spark):
    df = spark.createDataFrame([("1", "1", 1.9, None), ("0", "x", 0.2, None), (None, "0", None, None)], "a string, b string, c double, d int")
    row = df.agg(*[C.observed_rate(c).alias(c) for c in "abcd"]).first()
    assert row["a"] == 0.5 and row["b"] is None and row["d"] is None
    assert row["c"] == 0.5  # truncated to 1 and 0


def test_complete_cases_drop_null_and_nan(gaps):
    assert [r.id for r in clean.complete_cases(gaps, ["x", "s", "nope"]).orderBy("id").collect()] == ["a", "d", "e"]
    assert tuple(clean.complete_case_report(gaps, ["x", "s"]).first()) == (5, 3)


def test_complete_cases_reach_the_scan(spark, tmp_path):
    spark.range(5).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("s")).write.parquet(str(tmp_path / "t.parquet"))
    df = clean.filter_equal(clean.complete_cases(spark.read.parquet(str(tmp_path / "t.parquet")), ["k"]), {"s": "x"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(k)" in plan and "EqualTo(s,x)" in plan


def test_clean_table_from_raw_spellings(spark):
    raw = spark.createDataFrame(
        [(0.5, "Low", "Severe", 1), (None, None, "at risk", 0)],
        "soldier_readiness double, morale string, behavioral_health string, suicie_risk int",
    )
    rows = clean.clean_table(raw).orderBy("suicide_risk").collect()
    assert [(r.soldier_readiness_bin, r.low_morale, r.poor_behavioral_health) for r in rows] == [("not_ready", 0, 0), ("ready", 1, 1)]
    other = clean.clean_table(raw, S.POOR_HEALTH_WORDS_DASHBOARD).orderBy("suicide_risk").collect()
    assert [r.poor_behavioral_health for r in other] == [1, 0]


def test_add_flag_only_if_absent(spark):
    df = spark.createDataFrame([("low", 0)], "morale string, low_morale int")
    assert clean.add_flag(df, "morale", ["low"], "low_morale", only_if_absent=True).first().low_morale == 0
    assert "f" not in clean.add_flag(df, "missing", ["low"], "f").columns


def test_filters_options_and_cascade(spark):
    df = spark.createDataFrame([("N", "a", 1), ("N", "b", 2), ("S", "c", 3), (None, "d", 4)], "division string, brigade string, n int")
    assert clean.filter_equal(df, {"division": "N", "brigade": "All", "n": 2, "zz": "q", "x": None}).count() == 1
    assert [r.option for r in clean.options(df, "division").collect()] == ["N", "S"]
    tree = clean.unit_options(df, ["division", "brigade", "company"])
    assert [r.option for r in clean.options_within(tree, "brigade", {"division": "N"}).collect()] == ["a", "b"]


def test_pick_records(spark):
    df = spark.range(50).withColumn("k", F.concat(F.lit("k"), "id"))
    assert clean.pick_record(df, "k", "k7").first().id == 7
    first = clean.pick_random(df, "k").first()
    assert clean.pick_random(df.repartition(7), "k").first() == first
    assert {clean.pick_random(df, "k", s).first().k for s in range(5)} != {first.k}


def test_targets(spark, gaps):
    y, _ = make_target(gaps, TargetSpec("s", "in_set", values=("low",)), "y")
    assert values(y, "y") == [(1,), (0,), (0,), (0,), (1,)]
    y, cut = make_target(gaps, TargetSpec("q", "quantile", "x", q=0.25), "y")
    assert cut == pytest.approx(0.35) and values(y, "y") == [(0,), (0,), (0,), (0,), (1,)]
    y, cut = make_target(gaps, TargetSpec("t", "threshold", "x", cut=0.5), "y")
    assert cut == 0.5 and values(y, "y") == [(0,), (0,), (0,), (0,), (1,)]
    with pytest.raises(ValueError, match="unknown target kind"):
        make_target(gaps, TargetSpec("z", "other"), "y")


def test_binary_target_with_missing_fails(spark):
    df = spark.createDataFrame([(1,), (None,)], "flag int")
    y, _ = make_target(df, TargetSpec("flag", "binary"), "y")
    with pytest.raises(Exception, match="missing or non-integer value in target flag"):
        y.collect()


def test_feature_lists_match_the_published_sizes():
    assert (len(S.RISK_FEATURES.numeric), len(S.RISK_FEATURES.categorical)) == (29, 18)
    assert (len(S.READINESS_FEATURES.numeric), len(S.READINESS_FEATURES.categorical)) == (11, 6)
    assert (len(S.RETENTION_FEATURES.numeric), len(S.RETENTION_FEATURES.categorical)) == (28, 15)
    assert len(S.ASSOCIATION_COLUMNS) == 21 and len(S.RISK_TARGETS) == 9
    assert S.FeatureSpec.from_json(S.RISK_FEATURES.to_json()) == S.RISK_FEATURES


def test_load_save_round_trip(spark, soldiers, tmp_path):
    assert dict(soldiers.dtypes)["stress_score"] == "double" and dict(soldiers.dtypes)["ucmj"] == "int"
    path = str(tmp_path / "clean.parquet")
    tables.save_table(soldiers, path)
    back = tables.load_first(spark, [str(tmp_path / "none.csv"), path])
    assert back.count() == soldiers.count() and back.columns == soldiers.columns
    with pytest.raises(FileNotFoundError):
        tables.load_first(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError, match="spreadsheets"):
        tables.load_table(spark, "x.xlsx")
    with pytest.raises(ValueError, match="unknown table format"):
        tables.load_table(spark, "x.bin")


def test_nan_becomes_null_at_load(spark, tmp_path):
    spark.createDataFrame([(NAN, "a"), (1.0, None)], "x double, s string").write.parquet(str(tmp_path / "n.parquet"))
    rows = tables.load_table(spark, str(tmp_path / "n.parquet")).collect()
    assert sorted((r.x is None, r.s) for r in rows if r.s) == [(True, "a")]
