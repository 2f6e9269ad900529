"""Column builders that keep pandas' missing-value rules in Spark.

In the target semantics a comparison with a missing number is false and a missing text belongs to
no set, so every label builder here ends in a plain 0 or 1, never in null.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """The value as double with NaN turned into null."""
    return F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Load rule: after this, null is the only missing value in the frame."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, FLOATING)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The columns of ``cols`` the frame has, in the given order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def is_complete(df: DataFrame, cols: Sequence[str]) -> Column:
    """True where no listed column is null or NaN.

    Written with explicit ``isNotNull`` so that the null part reaches the file scan.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    tests = []
    for c in cols:
        tests.append(F.col(c).isNotNull())
        if isinstance(kinds[c], FLOATING):
            tests.append(~F.isnan(c))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def flag_in_set(c: Column | str, values: Iterable[str]) -> Column:
    """1 where the lower-cased text is one of ``values``; missing gives 0."""
    hit = F.lower(as_col(c).cast("string")).isin([v.lower() for v in values])
    return F.coalesce(hit, F.lit(False)).cast("int")


def text_is(c: Column | str, value: str) -> Column:
    """Case-blind equality with missing counted as false."""
    return F.coalesce(F.lower(as_col(c).cast("string")) == value.lower(), F.lit(False))


def cut_label(c: Column | str, cut: float, at_or_above: str, below: str) -> Column:
    return F.when(number(c) >= F.lit(cut), at_or_above).otherwise(below)


def flag_below(c: Column | str, cut: float) -> Column:
    """1 where value < cut; missing gives 0."""
    return F.coalesce(number(c) < F.lit(float(cut)), F.lit(False)).cast("int")


def flag_at_most(c: Column | str, cut: float | None) -> Column:
    """1 where value <= cut; missing gives 0, and so does a missing cut."""
    if cut is None:
        return F.lit(0)
    return F.coalesce(number(c) <= F.lit(float(cut)), F.lit(False)).cast("int")


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high], keeping null (``greatest`` alone would skip it)."""
    x = as_col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def risk_band(p: Column | str) -> Column:
    x = number(p)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(x >= 0.7, "high")
        .when(x >= 0.4, "moderate")
        .otherwise("lower")
    )


def observed_rate(c: Column | str) -> Column:
    """Mean of a flag over its known values; null when there are none or one is not a number."""
    x = as_col(c)
    as_int = x.try_cast("int")
    return F.when(F.count(x) == F.count(as_int), F.avg(as_int))


def clean_feature_name(c: Column | str) -> Column:
    """``num__x`` / ``cat__col_level`` without the prefix, ``=`` shown as ``_``."""
    return F.translate(F.regexp_replace(as_col(c), "^(num__|cat__)", ""), "=", "_")


def chart_title(c: Column | str) -> Column:
    return F.initcap(F.translate(as_col(c), "_", " "))
