"""The dashboard's pages as lazy tables: overview, one record, hypothesis test, unit what-if."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present, risk_band
from ..operators.association import WelchResult, welch_test
from ..operators.charts import histogram
from ..operators.clean import complete_cases, filter_equal
from ..operators.explain import local_contributions
from ..operators.profile import kpi_rates, observed_rate_by_group, one_row_per_column
from ..operators.scoring import LinearScore, add_scores, linear_score
from ..operators.split import sample_n
from ..operators.units import (
    ScenarioSpec,
    before_after_report,
    override_record,
    scenario_inputs,
    unit_risk_matrix,
)
from ..schema import FINE_UNIT_LEVELS, KEY, RATE_GROUPS, SCORES, UNIT_LEVELS
from ..sources.registry import StoredModel, classifiers, preferred_score_model

HISTOGRAM_COLUMNS = ["stress_score", "sleep_score", "OPTEMPO"]
OVERVIEW_FLAGS = ["high_burnout_risk", "high_risk_of_injury"]


def overview(
    df: DataFrame, selection: Mapping[str, object], flag: str, group: str = RATE_GROUPS[0]
) -> dict[str, DataFrame]:
    """Headline rates, histograms and the flag rate by group of the selected part of the table."""
    view = filter_equal(df, selection)
    tables = {"kpi": kpi_rates(view, SCORES, OVERVIEW_FLAGS)}
    for c in present(view, HISTOGRAM_COLUMNS):
        tables[f"histogram_{c}"] = histogram(view, c)
    if group in view.columns and flag in view.columns:
        tables["rate_by_group"] = observed_rate_by_group(view, group, flag)
    return tables


def record_risks(
    record: DataFrame, models: Mapping[str, StoredModel], overrides: Mapping[str, object] | None = None
) -> DataFrame:
    """Predicted risks (probability and band) of one record, or of every row given."""
    changed = override_record(record, overrides or {})
    risks = {t: m.model for t, m in classifiers(models).items()}
    names = {t: f"_p_{t}" for t in risks}
    scored = add_scores(changed, risks, names)
    lines = [
        F.struct(F.lit(t).alias("risk"), F.col(c).alias("probability"), risk_band(c).alias("band"))
        for t, c in names.items()
    ]
    keep = present(record, [KEY])
    return scored.select(*keep, F.inline(F.array(*lines)))


def record_scores(
    record: DataFrame, models: Mapping[str, StoredModel], overrides: Mapping[str, object] | None = None
) -> DataFrame:
    """Predicted readiness and retention from the preferred model of each; retention in [0, 1]."""
    changed = override_record(record, overrides or {})
    chosen = {t: m for t in SCORES if (m := preferred_score_model(models, t))}
    names = {t: f"predicted_{t}" for t in chosen}
    scored = add_scores(
        changed, {t: m.model for t, m in chosen.items()}, names, bounds={"retention_rate": (0.0, 1.0)}
    )
    return scored.select(*present(record, [KEY]), *names.values())


def record_drivers(
    record: DataFrame, model: StoredModel, overrides: Mapping[str, object] | None = None, key: str = KEY
) -> DataFrame:
    """The ten strongest contributions of a stored linear or logistic model per record."""
    changed = override_record(record, overrides or {})
    return local_contributions(changed, linear_score(model.model, model.features), key)


def workload_test(df: DataFrame, selection: Mapping[str, object], alpha: float = 0.05) -> WelchResult:
    """Is mean stress higher for a declining than for an improving workload trend?"""
    view = filter_equal(df, selection)
    return welch_test(view, "optempo_trend", "stress_score", "declining", "improving", alpha)


def unit_page(
    df: DataFrame,
    selection: Mapping[str, object],
    models: Mapping[str, LinearScore] | Mapping[str, object],
    feature_columns: Sequence[str],
    unit: str,
    base: Mapping[str, object],
    overrides: Mapping[str, object],
    thresholds: Mapping[str, float] | None = None,
    sample: int | None = None,
    spec: ScenarioSpec = ScenarioSpec(),
    key: str = KEY,
) -> dict[str, DataFrame]:
    """Risk matrix of the units below a selection and the before/after table of a scenario.

    ``sample`` limits the scenario to exactly that many records, if there are more; None uses them all.
    ``shown`` says how many of how many were used.
    """
    rows = complete_cases(filter_equal(df, selection), feature_columns)
    simulated = sample_n(rows, key, sample) if sample else rows
    inputs = scenario_inputs(rows, base, overrides, spec)
    return {
        "matrix": unit_risk_matrix(rows, unit, models, thresholds),
        "before_after": before_after_report(simulated, models, inputs),
        "shown": rows.agg(F.count(F.lit(1)).alias("n_total")).withColumn(
            "n_shown", F.least("n_total", F.lit(sample).cast("long"))
        ),
    }


def unit_levels(df: DataFrame) -> list[str]:
    """Unit columns the table has, finest first."""
    return present(df, [*FINE_UNIT_LEVELS, *reversed(UNIT_LEVELS[1:])])


def headline(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Observed rate of each flag as (flag, percent)."""
    wide = kpi_rates(df, [], flags)
    rows = {c: {"percent": F.col(c)} for c in wide.columns}
    return one_row_per_column(wide, rows).withColumnRenamed("column", "flag")
