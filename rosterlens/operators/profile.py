"""Descriptive statistics: profiles, rates, counts, group summaries, rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, observed_rate, present
from .quantiles import approximate_quantiles, exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def one_row_per_column(wide: DataFrame, rows: dict[str, dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into a long table: {column: {field: expression}}."""
    structs = [
        F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in fields.items()])
        for c, fields in rows.items()
    ]
    return wide.select(F.inline(F.array(*structs)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per numeric column."""
    cols = list(cols or numeric_columns(df))
    aggs, rows = [F.count(F.lit(1)).alias("n_rows")], {}
    for i, c in enumerate(cols):
        x = number(c)
        parts = {
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
        }
        aggs += [e.alias(f"{k}_{i}") for k, e in parts.items()]
        rows[c] = {k: F.col(f"{k}_{i}") for k in parts} | {"_rows": F.col("n_rows")}
    spark = df.sparkSession
    long = one_row_per_column(df.agg(*aggs), rows)
    found = long.collect()  # one row per column
    quartiles = exact_quantiles(df, cols, QUARTILES)
    q25, q50, q75 = (
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{int(p * 100)}") for p in QUARTILES
    )
    moments = spark.createDataFrame(found, long.schema).drop("_rows")
    spread = quartiles.groupBy("column").agg(q25, q50, q75)
    return moments.join(spread, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns in one pass; missing values left out."""
    return (
        df.select([F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([], list(cols), "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def text_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, unique, most frequent value and its frequency; ties go to the smallest value."""
    cols = list(cols or text_columns(df))
    return (
        value_counts(df, cols)
        .groupBy("column")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
            F.max("n").alias("freq"),
        )
    )


def null_report(df: DataFrame) -> DataFrame:
    """Type and number of known values per column, in table order."""
    kinds = dict(df.dtypes)
    counted = df.agg(*[F.count(_known(df, c)).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    return one_row_per_column(
        counted,
        {
            c: {"position": F.lit(i), "dtype": F.lit(kinds[c]), "non_null": F.col(f"n_{i}")}
            for i, c in enumerate(df.columns)
        },
    )


def _known(df: DataFrame, c: str) -> Column:
    """The column with NaN counted as missing."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(c), F.lit(None))
    return F.col(c)


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None, n: int = 20) -> DataFrame:
    """Share of missing values per column, the ``n`` worst first."""
    cols = list(cols or df.columns)
    rates = df.agg(*[F.avg(_known(df, c).isNull().cast("int")).alias(f"m_{i}") for i, c in enumerate(cols)])
    long = one_row_per_column(rates, {c: {"missing_rate": F.col(f"m_{i}")} for i, c in enumerate(cols)})
    return long.orderBy(F.desc("missing_rate"), "column").limit(n)


def kpi_rates(df: DataFrame, scores: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Means of scores and observed rates of flags, in percent; null stands for 'N/A'."""
    scores, flags = present(df, scores), present(df, flags)
    return df.agg(
        *[(F.avg(number(c)) * 100).alias(c) for c in scores],
        *[(observed_rate(c) * 100).alias(c) for c in flags],
    )


def observed_rate_by_group(df: DataFrame, group: str, flag: str, n: int = 20) -> DataFrame:
    """Flag rate per group, the ``n`` highest; rows without group or flag do not count."""
    return (
        df.dropna(subset=[group, flag])
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("int")).alias("rate"))
        .withColumn("percent", F.col("rate") * 100)
        .orderBy(F.desc("rate"), group)
        .limit(n)
    )


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per category, most frequent first within each column."""
    return value_counts(df, present(df, cols)).orderBy("column", F.desc("n"), "value")


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Share of each class among the known labels."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (F.col("n") / total).alias("proportion"))


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample std and variance of the known values per group."""
    y = number(value)
    return (
        df.filter(F.col(group).isNotNull() & y.isNotNull())
        .groupBy(group)
        .agg(
            F.count(y).alias("n"),
            F.avg(y).alias("mean"),
            F.stddev_samp(y).alias("std"),
            F.var_samp(y).alias("var"),
        )
    )


def prediction_percentiles(
    df: DataFrame, pred: str, by: Sequence[str] = (), probs: Sequence[float] = (0.1, 0.5, 0.9), exact: bool = True
) -> DataFrame:
    """p10, p50, p90 of a prediction, per group if asked; ``exact=False`` uses a sketch."""
    pick = exact_quantiles if exact else approximate_quantiles
    long = pick(df, [pred], probs, by)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{round(p * 100)}") for p in probs]
    )


def roster_topk(df: DataFrame, score: str, key: str, k: int = 25) -> DataFrame:
    """The ``k`` records with the highest score; ties by key."""
    return df.filter(number(score).isNotNull()).orderBy(F.desc(score), key).limit(k)


def grouped_means(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Mean of several scores per group (trait profile of a group)."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(number(c)).alias(f"mean_{c}") for c in values])
    )
