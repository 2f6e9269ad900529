"""The registered queries: (spark, sf_dir) -> DataFrame, one per operator."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import columns as C
from rosterlens.functions.caching import at_once, kept
from rosterlens.functions.small_tables import computed
from rosterlens.operators import (
    association,
    attribution,
    boosting,
    charts,
    clean,
    evaluate,
    explain,
    foldstats,
    models,
    newton,
    profile,
    ranks,
    screening,
    split,
    units,
)
from rosterlens.operators.features import feature_columns, feature_names, fit_preparation, ordinal, prepare
from rosterlens.operators.models import (
    boosted_learner,
    fit_regressor,
    forest_learner,
    linear_learner,
    make_target,
)
from rosterlens.operators.quantiles import exact_quantiles
from rosterlens.operators.scoring import add_scores, apply_threshold, coefficient_table, linear_score, tree_score
from rosterlens.plans.risk_models import train_risk_models, train_risk_models_together
from rosterlens.schema import FeatureSpec, TargetSpec
from rosterlens.sources.tables import load_table

from .cohort import (
    CATEGORICAL,
    COUNTED,
    FEATURES,
    KEY,
    NINE,
    NUMERIC,
    RISK_MODELS,
    SCENARIO,
    SCENARIO_BASE,
    SCENARIO_OVERRIDES,
    SCORE_MODEL,
    THRESHOLDS,
    cohort,
    gappy,
)

QUERIES = {}


def query(f):
    """Register a function of the cohort under its own name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(cohort(spark, sf_dir))
    return f


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """All double columns rounded, names kept."""
    kinds = dict(df.dtypes)
    return df.select(
        [r(F.col(c), special.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]
    )


# --- cleaning, filters, selection -----------------------------------------------------------------


@query
def clean_cohort(df):
    out = clean.fix_spelling(gappy(df), {"trend": "trend_text", "not_there": "x"})
    out = out.withColumn("size_label", C.cut_label("qty", 100.0, "ready", "not_ready"))
    out = clean.add_flag(out, "rank", ["5-low", "4-not specified"], "low_rank")
    return clean.complete_cases(out, ["qty", "mos"]).select(
        KEY, "trend_text", "mos", r("qty").alias("qty"), "size_label", "low_rank"
    )


@query
def complete_case_report(df):
    return clean.complete_case_report(gappy(df), ["qty", "mos", "o_totalprice"])


@query
def filter_equal(df):
    picked = clean.filter_equal(
        df, {"division_level": "EUROPE", "mos": "MACHINERY", "rank": "All", "n_lines": 4, "absent": "x"}
    )
    return picked.select(KEY, "brigade_level", "rank", r("o_totalprice", 2).alias("o_totalprice"))


@query
def filter_options(df):
    return clean.options(gappy(df), "mos")


@query
def unit_options(df):
    return clean.unit_options(df, ["division_level", "brigade_level", "battalion_level"])


@query
def options_within(df):
    tree = clean.unit_options(df, ["division_level", "brigade_level"])
    return clean.options_within(tree, "brigade_level", {"division_level": "ASIA"})


@query
def pick_record(df):
    one = clean.pick_random(df, KEY)
    return one.select(KEY, "brigade_level", "mos", r("o_totalprice", 2).alias("o_totalprice"))


@query
def pick_record_by_key(df):
    return clean.pick_record(df, KEY, 7).select(KEY, "brigade_level", "mos", "rank", "n_lines")


# --- profiles ---------------------------------------------------------------------------------------


@query
def table_shape(df):
    return profile.shape(df)


@query
def numeric_profile(df):
    return rounded(profile.numeric_profile(gappy(df), COUNTED), 4)


@query
def text_profile(df):
    return profile.text_profile(gappy(df), [*CATEGORICAL, "brigade_level"])


@query
def missing_rates(df):
    return rounded(profile.missing_rates(gappy(df)))


@query
def null_report(df):
    return profile.null_report(gappy(df).select("mos", "qty", "n_lines", "returned"))


@query
def kpi_rates(df):
    return rounded(profile.kpi_rates(df, ["o_totalprice", "disc", "absent"], ["returned", "low_flag"]), 4)


@query
def observed_rate_by_unit(df):
    return rounded(profile.observed_rate_by_group(df, "brigade_level", "low_flag"))


@query
def observed_rate_by_mos(df):
    return rounded(profile.observed_rate_by_group(gappy(df), "mos", "returned"))


@query
def category_counts(df):
    return profile.category_counts(gappy(df), [*CATEGORICAL, "returned"])


@query
def class_share(df):
    return rounded(profile.class_share(df, "low_flag"))


@query
def group_summary(df):
    return rounded(profile.group_summary(gappy(df), "trend", "qty"))


@query
def column_quantile(df):
    return rounded(exact_quantiles(gappy(df), ["qty", "o_totalprice"], [0.05, 0.25, 0.333, 0.9]), 4)


@query
def group_quantile(df):
    return rounded(exact_quantiles(gappy(df), ["qty"], [0.1, 0.5, 0.9], ["mos"]), 4)


@query
def column_quantile_by_counting(df):
    """The path for columns of any size: brackets narrowed by counting, no sorted group."""
    return rounded(
        exact_quantiles(df, ["o_totalprice"], [0.1, 0.5, 0.9], ["rank"], sort_rows=50), 4
    )


@query
def grouped_means(df):
    return rounded(profile.grouped_means(df, "mos", NUMERIC), 4)


# --- labels -----------------------------------------------------------------------------------------


def _labels(df, *specs):
    for s in specs:
        df, _ = make_target(df, s, f"y_{s.name}")
    return df.select(KEY, *[f"y_{s.name}" for s in specs])


@query
def label_binary(df):
    return _labels(df, TargetSpec("returned", "binary"), TargetSpec("low_flag", "binary"))


@query
def label_flag_in_set(df):
    return _labels(gappy(df), TargetSpec("in_set", "in_set", "mos", values=("machinery", "furniture")))


@query
def label_quantile(df):
    return _labels(gappy(df), TargetSpec("low_quarter", "quantile", "qty", q=0.25))


@query
def label_threshold(df):
    return _labels(gappy(df), TargetSpec("below", "threshold", "qty", cut=85.0))


# --- chart tables -----------------------------------------------------------------------------------


@query
def histogram30(df):
    return rounded(charts.histogram(df, "o_totalprice"), 4)


@query
def box_by_group(df):
    return rounded(charts.box_by_group(gappy(df), "trend", "qty"), 4)


@query
def density_by_group(df):
    return rounded(charts.density_by_group(df, "n_lines", "low_flag"))


@query
def pair_grid_points(df):
    return rounded(charts.pair_points(df, KEY, ["qty", "disc", "n_lines"], "low_flag", 500))


@query
def pair_grid_cells(df):
    return charts.pair_grid(gappy(df), ["qty", "n_lines", "o_totalprice"], "low_flag")


@query
def pair_grid_diagonal(df):
    return rounded(charts.pair_grid_diagonal(df, ["n_lines", "qty"], "low_flag"))


@query
def density_continuous(df):
    curve = charts.density_by_group(df, "o_totalprice", "trend")
    return curve.withColumns({"x": F.round("x", 4), "density": F.round("density", 12)})


@query
def quantiles_of_odd_values(df):
    """Infinities, a spread of 400 decades and one hot value."""
    x = F.col("o_totalprice")
    odd = {
        "endless": F.when(F.col(KEY) % 97 == 0, F.lit(float("inf"))).when(F.col(KEY) % 101 == 0, F.lit(float("-inf"))).otherwise(x),
        "wide": x * F.pow(F.lit(10.0), (F.col(KEY) % 400 - 200).cast("double")),
        "hot": F.when(F.col(KEY) % 3 > 0, F.lit(7.0)).otherwise(x),
    }
    found = exact_quantiles(df.withColumns(odd), list(odd), [0.002, 0.25, 0.5, 0.75, 0.998], sort_rows=100)
    endless = F.abs("quantile") == float("inf")
    text = F.when(endless, F.when(F.col("quantile") > 0, "inf").otherwise("-inf"))
    return found.select("column", "prob", F.coalesce(text, F.format_string("%.6e", "quantile")).alias("quantile"))


# --- tests and association ----------------------------------------------------------------------------


@query
def welch_test(df):
    return rounded(association.welch_stats(gappy(df), "trend", "qty", "P", "F"), 4)


@query
def welch_decision(df):
    r = association.welch_test(gappy(df), "trend", "qty", "P", "F")
    row = (r.t, r.dof, r.p_two_sided, r.p_one_sided, r.decision)
    found = df.sparkSession.createDataFrame([row], "t double, dof double, p_two_sided double, p_one_sided double, decision string")
    return rounded(found)


@query
def cramers_v(df):
    pairs = [("rank", "mos"), ("returned", "low_flag"), ("brigade_level", "division_level")]
    return rounded(association.cramers_v(gappy(df), pairs))


@query
def association_matrix(df):
    cols = [*CATEGORICAL, "brigade_level", "returned", "low_flag", "absent"]
    return rounded(association.association_matrix(gappy(df), cols))


@query
def pearson_matrix(df):
    return rounded(association.pearson_matrix(gappy(df), COUNTED))


@query
def chi_square(df):
    return rounded(association.chi_square(df, [("rank", "trend"), ("returned", "low_flag")]), 4)


@query
def anova(df):
    return rounded(association.anova_stats(gappy(df), "mos", "qty").select("groups", "n", "f"))


@query
def chi_square_p(df):
    found = association.chi_square_test(df, "rank", "trend")
    return rounded(df.sparkSession.createDataFrame([found], "chi2 double, dof long, p double"))


@query
def anova_p(df):
    found = association.anova_test(gappy(df), "mos", "qty")
    return rounded(df.sparkSession.createDataFrame([found], "f double, p double"))


# --- splits and samples -----------------------------------------------------------------------------


@query
def stratified_split(df):
    done = split.stratified_split(df, KEY, "low_flag")
    return done.select(KEY, "low_flag", F.col("is_test").cast("int").alias("is_test"))


@query
def random_split(df):
    return split.random_split(df, KEY).select(KEY, F.col("is_test").cast("int").alias("is_test"))


@query
def fold_assign(df):
    return split.assign_folds(df, KEY, 5).select(KEY, "fold")


@query
def sample_n(df):
    return split.sample_n(df, KEY, 1000).select(KEY, "mos", "n_lines")


# --- feature preparation ------------------------------------------------------------------------------


def _spread(df, spec, names):
    data = df.select(KEY, *spec.columns)
    with kept(data) as rows:
        prep = fit_preparation(rows, spec)
    wide = feature_columns(prepare(prep, data), feature_names(prep, spec))
    return wide.select(KEY, *[r(F.col(f"`{old}`")).alias(new) for old, new in names.items()])


@query
def standardize(df):
    spec = FeatureSpec(tuple(COUNTED), ())
    return _spread(df, spec, {f"num__{c}": f"z_{c}" for c in COUNTED})


@query
def one_hot(df):
    spec = FeatureSpec(("disc",), ("mos", "trend"))
    names = {"num__disc": "z_disc"}
    for c, levels in (("mos", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]), ("trend", ["O", "P"])):
        names |= {f"cat__{c}_{v}": f"{c}_{v.lower()}" for v in levels}
    return _spread(df, spec, names)


# --- scoring, units, scenarios --------------------------------------------------------------------------


@query
def score_linear(df):
    scored = add_scores(df, {**RISK_MODELS, "score": SCORE_MODEL})
    return rounded(scored.select(KEY, *RISK_MODELS, "score"))


@query
def risk_bands(df):
    scored = add_scores(df, RISK_MODELS)
    bands = {f"band_{m}": C.risk_band(m) for m in RISK_MODELS}
    return scored.withColumns(bands).select(KEY, *bands)


@query
def apply_thresholds(df):
    scored = add_scores(df, RISK_MODELS)
    hits = {f"hit_{m}": apply_threshold(m, t) for m, t in THRESHOLDS.items()}
    return scored.withColumns(hits).select(KEY, *hits)


@query
def clamped_score(df):
    scored = add_scores(df, {"score": SCORE_MODEL}, bounds={"score": (0.0, 150.0)})
    return rounded(scored.select(KEY, "score"))


@query
def unit_summary(df):
    return rounded(units.unit_summary(df, RISK_MODELS, {"score": SCORE_MODEL}, THRESHOLDS), 4)


@query
def prediction_percentiles(df):
    scored = add_scores(df, {"score": SCORE_MODEL})
    return rounded(profile.prediction_percentiles(scored, "score", ["brigade_level"]), 4)


@query
def unit_risk_matrix(df):
    return rounded(units.unit_risk_matrix(df, "brigade_level", RISK_MODELS, THRESHOLDS))


@query
def mean_rates(df):
    return rounded(units.mean_rates(df, RISK_MODELS))


@query
def roster_topk(df):
    scored = add_scores(df, {"prob": RISK_MODELS["price_risk"]})
    return rounded(profile.roster_topk(scored, "prob", KEY).select(KEY, "brigade_level", "rank", "prob"))


@query
def override_record(df):
    one = clean.pick_random(df, KEY)
    changed = units.override_record(one, {"qty": 210.0, "trend": "P", "returned": 1, "absent": 3})
    return rounded(add_scores(changed, RISK_MODELS).select(KEY, "qty", "trend", "returned", *RISK_MODELS))


def _scenario(df):
    return units.scenario_inputs(df, SCENARIO_BASE, SCENARIO_OVERRIDES, SCENARIO)


@query
def scenario_shift(df):
    changed = units.apply_scenario(df, SCENARIO_BASE, SCENARIO_OVERRIDES, SCENARIO)
    return rounded(changed.select(KEY, "qty", "c_acctbal", "disc", "low_flag"))


@query
def shift_one_column(df):
    return rounded(units.shift_column(df, "qty", -60.0, 0.0, 100.0).select(KEY, "qty"))


@query
def scenario_before_after(df):
    return units.before_after_report(df, RISK_MODELS, _scenario(df))


@query
def scenario_by_threshold(df):
    return rounded(units.before_after_by_threshold(df, RISK_MODELS, _scenario(df), THRESHOLDS))


# --- explanation ----------------------------------------------------------------------------------------


@query
def local_contributions(df):
    return rounded(explain.local_contributions(df, RISK_MODELS["price_risk"], KEY, 4))


@query
def local_contributions_linear(df):
    return rounded(explain.local_contributions(df, SCORE_MODEL, KEY, 3))


def _marginal_coefficients(df: DataFrame, target: str) -> DataFrame:
    """A (feature, coef) table from the data: slope of the target on each standardised number, and
    mean difference between a level and the rest."""
    y = F.col(target).cast("double")
    wide = df.agg(*[(F.regr_slope(y, F.col(c).cast("double")) * F.stddev_pop(c)).alias(c) for c in COUNTED])
    numbers = wide.unpivot([], COUNTED, "column", "coef").select(
        F.concat(F.lit("num__"), "column").alias("feature"), "coef"
    )
    total = df.agg(F.struct(F.count(y).alias("n"), F.sum(y).alias("s"))).scalar()
    levels = (
        df.select(y.alias("y"), *CATEGORICAL)
        .unpivot(["y"], CATEGORICAL, "column", "level")
        .groupBy("column", "level")
        .agg(F.count("y").alias("n"), F.sum("y").alias("s"))
        .withColumn("t", total)
    )
    rest = (F.col("t.s") - F.col("s")) / (F.col("t.n") - F.col("n"))
    return numbers.unionByName(
        levels.select(
            F.concat(F.lit("cat__"), "column", F.lit("_"), "level").alias("feature"),
            (F.col("s") / F.col("n") - rest).alias("coef"),
        )
    )


@query
def top_drivers(df):
    return rounded(explain.logistic_drivers(_marginal_coefficients(df, "returned")))


@query
def linear_drivers(df):
    return rounded(explain.linear_drivers(_marginal_coefficients(df, "qty")))


@query
def top_coefficients(df):
    return rounded(explain.top_coefficients(_marginal_coefficients(df, "low_flag"), 10, "low price"))


@query
def driver_text(df):
    drivers = explain.logistic_drivers(_marginal_coefficients(df, "returned"))
    return explain.logistic_sentences(drivers, "returned").select("feature_clean", "text")


@query
def linear_driver_text(df):
    drivers = explain.linear_drivers(_marginal_coefficients(df, "qty"))
    return explain.linear_sentences(drivers, "qty").select("feature_clean", "text")


# --- evaluation -----------------------------------------------------------------------------------------


def _scored(df, threshold=0.7):
    scored = add_scores(df, {"p": RISK_MODELS["return_risk"], "score": SCORE_MODEL})
    # equal inputs must give equal scores in both engines
    return scored.withColumn("p", r("p", 9)).withColumn("pred", apply_threshold("p", threshold))


@query
def threshold_sweep(df):
    return rounded(evaluate.threshold_sweep(_scored(df), "returned", "p"))


@query
def best_threshold(df):
    scored = _scored(df)
    best = evaluate.best_threshold(scored, "returned", "p")
    sweep = evaluate.threshold_sweep(scored, "returned", "p", [best])
    return rounded(sweep.select("threshold", "f1"))


@query
def confusion(df):
    return evaluate.confusion(_scored(df), "returned", "pred")


@query
def class_report(df):
    return rounded(evaluate.class_report(_scored(df), "returned", "pred"))


@query
def auc(df):
    value = evaluate.roc_auc(_scored(df), "returned", "p")
    return df.sparkSession.createDataFrame([(round(value, 6),)], "auc double")


@query
def regression_metrics(df):
    return rounded(evaluate.regression_metrics(_scored(df), "qty", "score"), 4)


@query
def residuals(df):
    return rounded(evaluate.residuals(_scored(df), "qty", "score", [KEY]))


# --- fitted models ------------------------------------------------------------------------------------------


@query
def fit_linear(df):
    spec = FeatureSpec(("qty", "c_acctbal"), ())
    with kept(df.select("o_totalprice", *spec.columns)) as rows:
        model = fit_regressor(rows, spec, linear_learner("o_totalprice"))
    coefs = coefficient_table(model, spec).withColumn("intercept", F.lit(float(model.stages[1].intercept)))
    return rounded(coefs, 2)


@query
def fitted_linear_scores(df):
    """Scores of a fitted model in both forms; rows with a missing input have none."""
    spec = FeatureSpec(("qty", "c_acctbal"), ())
    with kept(df.select("o_totalprice", *spec.columns)) as rows:
        model = fit_regressor(rows, spec, linear_learner("o_totalprice"))
    both = add_scores(gappy(df).select(KEY, *spec.columns), {"inline": linear_score(model, spec), "piped": model})
    return rounded(both.select(KEY, "inline", "piped"), 2)


@query
def cv_linear(df):
    """Fold scores of a linear model on two inputs."""
    spec = FeatureSpec(("qty", "c_acctbal"), ())
    folded = split.assign_folds(df.select(KEY, "o_totalprice", *spec.columns), KEY, 5)
    return rounded(evaluate.cross_validate(folded, spec, linear_learner("o_totalprice"), "o_totalprice", "fold", 5), 4)


@query
def fit_logistic(df):
    targets = {
        "returned": TargetSpec("returned", "binary"),
        "low_qty": TargetSpec("low_qty", "quantile", "qty", q=0.25),
    }
    spec = FeatureSpec(("o_totalprice", "c_acctbal", "disc", "n_lines"), ("mos", "rank", "trend"))
    fitted = train_risk_models(df, spec, targets, KEY)
    rows = []
    for name, x in fitted.items():
        for line in x.report.collect():  # five lines per target
            rows.append((name, float(x.threshold), float(x.auc), *line))
    names = (
        "target string, threshold double, auc double, class string, "
        "precision double, recall double, f1 double, support long"
    )
    return df.sparkSession.createDataFrame(rows, names)


@query
def fitted_drivers(df):
    """The drivers of a fitted linear model."""
    spec = FeatureSpec(("qty", "c_acctbal"), ())
    with kept(df.select("o_totalprice", *spec.columns)) as rows:
        model = fit_regressor(rows, spec, linear_learner("o_totalprice"))
    return rounded(explain.linear_drivers(coefficient_table(model, spec)), 2)


@query
def logistic_coefficients(df):
    """A class-balanced, penalised logistic model on one number."""
    spec = FeatureSpec(("qty",), ())
    with kept(df.select("returned", "qty")) as rows:
        fitted = models.fit_logistic(prepare(fit_preparation(rows, spec), rows), "returned")
    row = (float(fitted.coefficients[0]), float(fitted.intercept))
    return rounded(df.sparkSession.createDataFrame([row], "coef double, intercept double"), 3)


#: Two whole-numbered inputs, for trees that SQL can grow as well.
STUMP = FeatureSpec(("n_lines", "returned"), ())


def _stump(df, learner):
    """A model of ``qty`` on STUMP, and its prediction for every combination of inputs."""
    with kept(df.select("qty", *STUMP.columns)) as rows:
        model = fit_regressor(rows, STUMP, learner)
        cells = model.transform(rows).groupBy(*STUMP.columns)
        return model, computed(rounded(cells.agg(F.count(F.lit(1)).alias("n"), F.max("prediction").alias("prediction"))))


@query
def forest_stump(df):
    """One tree of one split, grown on the rows as they are."""
    return _stump(df, forest_learner("qty", trees=1, depth=1, bootstrap=False))[1]


@query
def boosted_stumps(df):
    """Two rounds of one split each."""
    return _stump(df, boosted_learner("qty", rounds=2, depth=1, rate=0.5, share=1.0))[1]


@query
def stump_importance(df):
    return explain.forest_importance(_stump(df, forest_learner("qty", trees=1, depth=1, bootstrap=False))[0], STUMP)


@query
def stump_attribution(df):
    """Shapley values of a tree of one split: the feature that is split on has all of the difference."""
    model, _ = _stump(df, forest_learner("qty", trees=1, depth=1, bootstrap=False))
    prep, forest = model.stages
    values, _ = attribution.tree_attribution(prepare(prep, df), KEY, forest, feature_names(prep, STUMP))
    return rounded(values)


@query
def attribution_adds_up(df):
    """Records whose Shapley values and the expectation do not sum to the prediction."""
    with kept(_regression_frame(df)) as data:
        model = fit_regressor(data, FEATURES, forest_learner("y", trees=5, depth=4))
        prep, forest = model.stages
        values, expected = attribution.tree_attribution(prepare(prep, data), KEY, forest, feature_names(prep, FEATURES))
        total = values.groupBy(KEY).agg(F.sum("value").alias("total"))
        gap = F.abs(F.col("total") + expected - F.col("prediction"))
        both = model.transform(data).select(KEY, "prediction").join(total, KEY, "left")
        return computed(both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(gap > 1e-9, F.lit(True))).alias("wrong")))


@query
def cv_stump(df):
    """Fold scores of a tree of one split."""
    spec = FeatureSpec(("n_lines",), ())
    folded = split.assign_folds(df.select(KEY, "qty", *spec.columns), KEY, 5)
    learner = forest_learner("qty", trees=1, depth=1, bootstrap=False)
    return rounded(evaluate.cross_validate(folded, spec, learner, "qty", "fold", 5))


def _regression_frame(df):
    return df.select(KEY, *FEATURES.columns, F.col("n_lines").cast("double").alias("y"))


def _fit_and_measure(df, learner):
    with kept(split.random_split(_regression_frame(df), KEY)) as rows:
        train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
        model = fit_regressor(train, FEATURES, learner)
        metrics = evaluate.regression_metrics(model.transform(test), "y", "prediction").collect()
    return model, df.sparkSession.createDataFrame(metrics)


@query
def fit_forest(df):
    return _fit_and_measure(df, forest_learner("y", trees=20, depth=8))[1]


@query
def fit_boosted(df):
    return _fit_and_measure(df, boosted_learner("y", rounds=10, depth=4))[1]


@query
def cv_scores(df):
    folded = split.assign_folds(_regression_frame(df), KEY, 5)
    return evaluate.cv_summary(evaluate.cross_validate(folded, FEATURES, linear_learner("y"), "y", "fold", 5))


@query
def forest_importance(df):
    model, _ = _fit_and_measure(df, forest_learner("y", trees=10, depth=6))
    return explain.forest_importance(model, FEATURES)


@query
def tree_attribution(df):
    with kept(_regression_frame(df)) as data:
        model = fit_regressor(data, FEATURES, forest_learner("y", trees=5, depth=4))
        prep, forest = model.stages
        names = feature_names(prep, FEATURES)
        values, _ = attribution.tree_attribution(prepare(prep, data), KEY, forest, names)
        return computed(attribution.attribution_summary(values))


# --- many models in the same scans, trees as columns --------------------------------------------------------


@query
def logistic_nine_targets(df):
    """Coefficients of class-balanced models of nine targets on two numbers, all from the same scans."""
    spec = FeatureSpec(("qty", "c_acctbal"), ())
    labels = F.array(*[F.expr(e).cast("double") for e in NINE.values()])
    prepared = prepare(fit_preparation(df, spec), df.withColumn("y", labels))
    with kept(prepared.select(vector_to_array("features").alias("x"), "y")) as rows:
        moments = newton.target_moments(rows, 2, len(NINE))
        fits = newton.fit_targets(rows, 2, moments, 2)
    table = [(t, f.intercept, *map(float, f.coefficients)) for t, f in zip(NINE, fits)]
    return rounded(df.sparkSession.createDataFrame(table, "target string, intercept double, qty double, c_acctbal double"), 4)


@query
def auc_nine(df):
    """Areas under the curve of three scores for three labels, from one shuffle."""
    labels = ("returned", "low_flag", "urgent")
    scored = add_scores(df, RISK_MODELS).withColumn("urgent", F.expr(NINE["urgent"]))
    pairs = [
        F.struct(F.lit(f"{m} of {y}").alias("model"), F.col(y).alias("y"), r(F.col(m), 9).alias("p")) for m in RISK_MODELS for y in labels
    ]
    long = scored.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return rounded(ranks.roc_aucs(long, "model", "y", "p"))


@query
def fit_nine_risk_models(df):
    """Nine risk models split, fitted, tuned and measured together."""
    specs = {t: TargetSpec(t, "binary") for t in NINE}
    spec = FeatureSpec(("o_totalprice", "c_acctbal", "disc", "qty"), ("mos", "trend"))
    fitted = train_risk_models_together(df.withColumns({t: F.expr(e) for t, e in NINE.items()}), spec, specs, KEY)
    rows = [(t, float(x.threshold), float(x.auc), *line) for t, x in fitted.items() for line in x.confusion.collect()]  # four lines a target
    return df.sparkSession.createDataFrame(rows, "target string, threshold double, auc double, label int, pred int, n long")


def _regularised(depth: int = 2, rounds: int = 2):
    return models.regularised_learner("qty", rounds=rounds, depth=depth, rate=0.5, share=1.0)


@query
def regularised_boosting(df):
    """Two rounds of depth two with a leaf penalty of one."""
    return _stump(df, _regularised())[1]


@query
def cv_regularised_boosting(df):
    """Fold scores of the same; the models of all folds grow in the same passes."""
    folded = split.assign_folds(df.select(KEY, "qty", *STUMP.columns), KEY, 5)
    settings = boosting.Settings(rounds=2, depth=2, rate=0.5, row_share=1.0, column_share=1.0)
    return rounded(boosting.cross_validate_boosted(folded, STUMP, "qty", "fold", 5, settings))


@query
def cv_linear_by_sums(df):
    """Fold scores of a linear model from sums by fold: no model is fitted or scored on rows again."""
    spec = FeatureSpec(("qty", "c_acctbal"), ())
    folded = split.assign_folds(df.select(KEY, "o_totalprice", *spec.columns), KEY, 5)
    return rounded(foldstats.cross_validate_linear(folded, spec, "o_totalprice", "fold", 5), 4)


@query
def cv_three_learners(df):
    """Mean fold scores of the linear, forest and boosted learners on all features."""
    with kept(_regression_frame(df)) as base, kept(split.assign_folds(base, KEY, 5)) as rows:
        scores = {
            "linreg": lambda: foldstats.cross_validate_linear(rows, FEATURES, "y", "fold", 5),
            "rfreg": lambda: evaluate.cross_validate(rows, FEATURES, forest_learner("y", trees=10, depth=6), "y", "fold", 5),
            "xgbreg": lambda: boosting.cross_validate_boosted(rows, FEATURES, "y", "fold", 5, boosting.Settings(rounds=10, depth=4, rate=0.3, bins=64)),
        }
        scores = dict(zip(scores, at_once(lambda fit: fit(), scores.values()), strict=True))  # a level of trees alone leaves cores idle
    lines = [evaluate.cv_summary(x).withColumn("learner", F.lit(name)) for name, x in scores.items()]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


@query
def tree_scenario(df):
    """Mean predictions of a boosted model by unit, before and after orders gain a line, from one scan."""
    score = tree_score(_stump(df, _regularised())[0], STUMP)
    more = {"n_lines": F.least(F.col("n_lines") + 1, F.lit(7))}
    both = add_scores(add_scores(df, {"m": score}, {"m": "before"}), {"m": score}, {"m": "after"}, more)
    means = both.groupBy("brigade_level").agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"))
    return rounded(means, 5)


@query
def boosted_attribution_adds_up(df):
    """Records whose Shapley values and the expectation do not sum to the prediction, for a model of deeper trees."""
    with kept(_regression_frame(df)) as data:
        model = fit_regressor(data, FEATURES, models.regularised_learner("y", rounds=5, depth=6, rate=0.3, bins=64))
        prep, fitted = model.stages
        values, expected = attribution.tree_attribution(prepare(prep, data), KEY, fitted, feature_names(prep, FEATURES))
        total = values.groupBy(KEY).agg(F.sum("value").alias("total"))
        gap = F.abs(F.col("total") + expected - F.col("prediction"))
        both = model.transform(data).select(KEY, "prediction").join(total, KEY, "left")
        return computed(both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(gap > 1e-9, F.lit(True))).alias("wrong")))


# --- screening ----------------------------------------------------------------------------------------------


@query
def ordinal_levels(df):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
    return ordinal(df, "rank", order, "rank_code").select(
        KEY, "rank", F.coalesce("rank_code", F.lit(-1)).alias("rank_code")
    )


@query
def row_totals(df):
    steps = {"light": 0.0, "medium": 60.0, "heavy": 150.0}
    out = screening.row_total(gappy(df), ["qty", "n_lines"], "total", 120.0, steps)
    return rounded(out.select(KEY, "total", "total_heavy", "total_label"))


@query
def duplicate_keys(df):
    return screening.duplicates(df, ["brigade_level", "mos", "n_lines", "returned"])


@query
def outlier_counts(df):
    return rounded(screening.outlier_counts(df, NUMERIC), 4)


@query
def range_checks(df):
    return screening.range_violations(df, {"qty": (10.0, 200.0), "disc": (0.0, 0.08)})


@query
def minmax_scaled(df):
    return rounded(screening.normalise(df, ["qty", "c_acctbal"], "minmax").select(KEY, "qty", "c_acctbal"))


@query
def zscore_scaled(df):
    return rounded(screening.normalise(df, ["qty", "c_acctbal"]).select(KEY, "qty", "c_acctbal"))


@query
def component_shares(df):
    """The share of the strongest component of four numbers in their variance."""
    shares, _ = screening.principal_components(df, FeatureSpec(("o_totalprice", "c_acctbal", "qty", "n_lines"), ()), 1)
    return rounded(shares)


@query
def component_loadings(df):
    """The direction of the strongest component."""
    _, loadings = screening.principal_components(df, FeatureSpec(("o_totalprice", "c_acctbal", "qty", "n_lines"), ()), 1)
    return rounded(loadings, 5)


@query
def kmeans_groups(df):
    with kept(df.select(KEY, *FEATURES.columns)) as data:
        grouped = screening.fit_groups(data, FEATURES, 4, components=3).transform(data)
        return computed(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")))


@query
def kmeans_stable(df):
    """Rows that are nearer to another centre than to their own, and centres that are off their rows' mean."""
    with kept(df.select(KEY, *FEATURES.columns)) as data:
        model = screening.fit_groups(data, FEATURES, 4, components=3)
        rows = model.transform(data).select("group", vector_to_array("components").alias("x"))
        centres = [[float(v) for v in c] for c in model.stages[-1].clusterCenters()]
        away = F.array(*[sum((F.col("x")[i] - v) * (F.col("x")[i] - v) for i, v in enumerate(c)) for c in centres])
        stray = F.get(away, F.col("group")) > F.array_min(away) + 1e-9
        middles = [F.avg(F.col("x")[i]) for i in range(3)]
        at = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
        off = F.greatest(*[F.abs(m - F.get(F.get(at, F.col("group")), F.lit(i))) for i, m in enumerate(middles)])
        groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(stray).alias("strays"), off.alias("off"))
        return computed(groups.agg(F.sum("n").alias("n"), F.sum("strays").alias("strays"), F.count_if(F.col("off") > 0.01).alias("moved")))


def loaded_customers(spark, sf_dir):
    """A table through the loader, by its extension."""
    return load_table(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


QUERIES["loaded_customers"] = loaded_customers
