"""Unit summaries and what-if scenarios over many records and models at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clip
from ..schema import DEFAULT_THRESHOLD, SCENARIO_FLAGS, SHIFT_RANGES
from .profile import one_row_per_column
from .quantiles import approximate_quantiles, exact_quantiles
from .scoring import LinearScore, add_scores

Models = Mapping[str, LinearScore | PipelineModel]


def unit_summary(
    df: DataFrame,
    classifiers: Models,
    regressors: Models,
    thresholds: Mapping[str, float] | None = None,
    exact: bool = True,
) -> DataFrame:
    """One line per model: mean probability and share at or above the threshold for classifiers,
    mean and p10, p50, p90 for regressors."""
    thresholds = thresholds or {}
    scored = add_scores(df, {**classifiers, **regressors})
    aggs, rows = [], {}
    none = F.lit(None).cast("double")
    for i, m in enumerate(classifiers):
        t = float(thresholds.get(m, DEFAULT_THRESHOLD))
        aggs += [
            F.avg(m).alias(f"c_avg_{i}"),
            F.avg((F.col(m) >= t).cast("int")).alias(f"c_rate_{i}"),
        ]
        rows[m] = {
            "type": F.lit("risk_rate"),
            "threshold": F.lit(t),
            "avg_probability": F.col(f"c_avg_{i}"),
            "predicted_rate": F.col(f"c_rate_{i}"),
            "avg_pred": none,
        }
    for i, m in enumerate(regressors):
        aggs.append(F.avg(m).alias(f"r_avg_{i}"))
        rows[m] = {
            "type": F.lit("regression"),
            "threshold": none,
            "avg_probability": none,
            "predicted_rate": none,
            "avg_pred": F.col(f"r_avg_{i}"),
        }
    table = one_row_per_column(scored.agg(*aggs), rows).withColumnRenamed("column", "metric")
    if not regressors:
        return table.withColumns({p: none for p in ("p10", "p50", "p90")})
    pick = exact_quantiles if exact else approximate_quantiles
    long = pick(scored, list(regressors), (0.1, 0.5, 0.9))
    spread = long.groupBy(F.col("column").alias("metric")).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
            for p, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))
        ]
    )
    return table.join(spread, "metric", "left")


def unit_risk_matrix(
    df: DataFrame, unit: str, classifiers: Models, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Per unit: record count and, per model, the share at or above its threshold; largest first."""
    thresholds = thresholds or {}
    scored = add_scores(df.filter(F.col(unit).isNotNull()), classifiers)
    shares = [
        F.avg((F.col(m) >= float(thresholds.get(m, DEFAULT_THRESHOLD))).cast("int")).alias(m) for m in classifiers
    ]
    return (
        scored.groupBy(F.col(unit).cast("string").alias(unit))
        .agg(F.count(F.lit(1)).alias("n"), *shares)
        .orderBy(F.desc("n"), unit)
    )


def mean_rates(df: DataFrame, classifiers: Models) -> DataFrame:
    """Mean predicted probability per model."""
    scored = add_scores(df, classifiers).agg(*[F.avg(m).alias(m) for m in classifiers])
    return one_row_per_column(scored, {m: {"mean_rate": F.col(m)} for m in classifiers}).withColumnRenamed(
        "column", "risk"
    )


# --- overrides and scenarios ----------------------------------------------------------------------


def _checked(df: DataFrame, overrides: Mapping[str, object]) -> dict[str, object]:
    """Overrides of existing columns; a number for a text column (or the reverse) is an error."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = {}
    for c, v in overrides.items():
        if c not in kinds:
            continue
        if v is not None and isinstance(kinds[c], T.StringType) != isinstance(v, str):
            raise ValueError(f"override of {c} changes its type {kinds[c].simpleString()}: {v!r}")
        out[c] = v
    return out


def override_record(record: DataFrame, overrides: Mapping[str, object]) -> DataFrame:
    """Set columns of a record (or of every row given); unknown columns are left out."""
    kinds = dict(record.dtypes)
    exprs = {c: F.lit(v).cast(kinds[c]) for c, v in _checked(record, overrides).items()}
    return record.withColumns(exprs) if exprs else record


@dataclass(frozen=True)
class ScenarioSpec:
    """Which columns a scenario shifts (with their valid range) and which flags it sets."""

    ranges: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(SHIFT_RANGES))
    flags: Sequence[str] = tuple(SCENARIO_FLAGS)


def scenario_inputs(
    df: DataFrame,
    base: Mapping[str, object],
    overrides: Mapping[str, object],
    spec: ScenarioSpec = ScenarioSpec(),
) -> dict[str, Column]:
    """Changed input columns: value + (override - base value), clipped; flags as given."""
    kinds = dict(df.dtypes)
    overrides = _checked(df, overrides)
    out = {}
    for c, (low, high) in spec.ranges.items():
        if c in overrides and base.get(c) is not None:
            shift = float(overrides[c]) - float(base[c])
            out[c] = clip(F.col(c).cast("double") + F.lit(shift), low, high)
    for c in spec.flags:
        if c in overrides:
            out[c] = F.lit(int(overrides[c])).cast(kinds[c])
    return out


def apply_scenario(df: DataFrame, base, overrides, spec: ScenarioSpec = ScenarioSpec()) -> DataFrame:
    changed = scenario_inputs(df, base, overrides, spec)
    return df.withColumns(changed) if changed else df


def shift_column(df: DataFrame, col: str, delta: float, low: float, high: float) -> DataFrame:
    """Shift one column for all rows, clipped; a missing column changes nothing."""
    if col not in df.columns:
        return df
    return df.withColumn(col, clip(F.col(col).cast("double") + F.lit(float(delta)), low, high))


def before_after(
    df: DataFrame,
    classifiers: Models,
    inputs: Mapping[str, Column],
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """Mean probability and share at or above the threshold, before and after a scenario.

    Both scores of a row are computed side by side, so the table is read and aggregated once.
    """
    thresholds = thresholds or {}
    before = {m: f"_b{i}" for i, m in enumerate(classifiers)}
    after = {m: f"_a{i}" for i, m in enumerate(classifiers)}
    scored = add_scores(df, classifiers, before)
    scored = add_scores(scored, classifiers, after, inputs)
    aggs, rows = [], {}
    for m in classifiers:
        t = float(thresholds.get(m, DEFAULT_THRESHOLD))
        for side in (before[m], after[m]):
            aggs += [
                F.avg(side).alias(f"p{side}"),
                F.avg((F.col(side) >= t).cast("int")).alias(f"s{side}"),
            ]
        b, a = before[m], after[m]
        rows[m] = {
            "baseline_avg_prob": F.col(f"p{b}"),
            "after_avg_prob": F.col(f"p{a}"),
            "baseline_rate": F.col(f"s{b}"),
            "after_rate": F.col(f"s{a}"),
            "delta": F.col(f"s{a}") - F.col(f"s{b}"),
        }
    return one_row_per_column(scored.agg(*aggs), rows).withColumnRenamed("column", "risk")


def before_after_report(
    df: DataFrame, classifiers: Models, inputs: Mapping[str, Column], digits: int = 1
) -> DataFrame:
    """Mean predicted probability in percent before and after, change in points, smallest first."""
    table = before_after(df, classifiers, inputs)
    before, after = F.col("baseline_avg_prob") * 100, F.col("after_avg_prob") * 100
    change = (F.col("after_avg_prob") - F.col("baseline_avg_prob")) * 100
    return (
        table.orderBy(change, "risk")
        .select(
            "risk",
            F.bround(before, digits).alias("baseline_pct"),
            F.bround(after, digits).alias("after_pct"),
            F.bround(change, digits).alias("change_pp"),
        )
    )


def before_after_by_threshold(
    df: DataFrame,
    classifiers: Models,
    inputs: Mapping[str, Column],
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """``before_after`` sorted by the change of the share at or above the threshold."""
    return before_after(df, classifiers, inputs, thresholds).orderBy("delta", "risk")
