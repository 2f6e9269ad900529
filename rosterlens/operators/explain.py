"""Global drivers, forest importances and per-record contributions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clean_feature_name
from ..schema import FeatureSpec
from .features import feature_names
from .scoring import LinearScore

UP, DOWN = "↑ increases", "↓ decreases"


def _both_ends(table: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n // 2`` highest and the ``n - n // 2`` lowest rows; short tables repeat rows."""
    half = n // 2
    high = table.orderBy(F.desc(by), "feature").limit(half)
    low = table.orderBy(F.asc(by), "feature").limit(n - half)
    return high.unionByName(low)


def logistic_drivers(coefs: DataFrame, n: int = 10) -> DataFrame:
    """Strongest risk increasers and decreasers of a (feature, coef) table by odds ratio."""
    table = coefs.withColumn("odds_ratio", F.exp("coef"))
    return (
        _both_ends(table, "odds_ratio", n)
        .select(
            clean_feature_name("feature").alias("feature_clean"),
            "coef",
            "odds_ratio",
            ((F.col("odds_ratio") - 1.0) * 100.0).alias("pct_change_odds"),
        )
        .orderBy(F.desc("odds_ratio"), "feature_clean")
    )


def linear_drivers(coefs: DataFrame, n: int = 10) -> DataFrame:
    """Most positive and most negative coefficients of a (feature, coef) table."""
    return (
        _both_ends(coefs, "coef", n)
        .select(clean_feature_name("feature").alias("feature_clean"), "coef")
        .orderBy(F.desc("coef"), "feature_clean")
    )


def top_coefficients(coefs: DataFrame, n: int = 10, target: str = "risk") -> DataFrame:
    """Top ``n`` by absolute coefficient with the direction in words."""
    effect = F.when(F.col("coef") > 0, f"{UP} {target}").otherwise(f"{DOWN} {target}")
    return (
        coefs.orderBy(F.desc(F.abs("coef")), "feature").limit(n).select("feature", "coef", effect.alias("effect"))
    )


def logistic_sentences(drivers: DataFrame, target: str) -> DataFrame:
    """Add ``text``: the driver in plain language."""
    up = F.col("odds_ratio") > 1
    verb = F.when(up, "increases").otherwise("decreases")
    text = F.format_string(
        f"%s: %s odds of {target} by ~%s%% (OR=%s)",
        "feature_clean",
        verb,
        F.format_string("%.0f", F.bround(F.abs("pct_change_odds"), 0)),
        F.format_string("%.2f", "odds_ratio"),
    )
    return drivers.withColumn("text", text)


def linear_sentences(drivers: DataFrame, target: str) -> DataFrame:
    side = F.when(F.col("coef") > 0, "HIGHER").otherwise("LOWER")
    text = F.format_string(
        f"%s: associated with %s {target} (coef=%s)",
        "feature_clean",
        side,
        F.format_string("%.3f", "coef"),
    )
    return drivers.withColumn("text", text)


def forest_importance(model: PipelineModel, spec: FeatureSpec, n: int = 20) -> DataFrame:
    """Top ``n`` feature importances of a fitted forest or boosted pipeline."""
    prep, fitted = model.stages
    values = fitted.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(feature_names(prep, spec), values, strict=True)]
    table = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def local_contributions(
    df: DataFrame,
    model: LinearScore,
    key: str,
    n: int = 10,
    inputs: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The ``n`` strongest contributions of every record: coefficient x prepared value.

    One pass, no shuffle: the terms of a row are an array that is sorted and cut in place.
    """
    terms = [
        F.struct((-F.abs(c)).alias("order"), F.lit(name).alias("feature"), c.alias("contribution"))
        for name, c in model.terms(inputs)
    ]
    top = F.slice(F.sort_array(F.array(*terms)), 1, n)
    return df.select(key, F.posexplode(top).alias("pos", "term")).select(
        key,
        (F.col("pos") + 1).alias("place"),
        F.col("term.feature").alias("feature"),
        F.col("term.contribution").alias("contribution"),
        F.when(F.col("term.contribution") >= 0, UP).otherwise(DOWN).alias("direction"),
    )
