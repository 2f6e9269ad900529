"""Cleaning, filters, option lists and record selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut_label, flag_in_set, is_complete, present
from ..schema import (
    LOW_MORALE_WORDS,
    POOR_HEALTH_WORDS,
    READY_CUT,
    SEED,
    SPELLING_FIXES,
)

ALL = "All"


def fix_spelling(df: DataFrame, names: Mapping[str, str] = SPELLING_FIXES) -> DataFrame:
    """Rename misspelled columns; absent ones are ignored."""
    return df.withColumnsRenamed(dict(names))


def add_flag(
    df: DataFrame, source: str, words: Sequence[str], out: str, only_if_absent: bool = False
) -> DataFrame:
    """Add a 0/1 word-list flag if the text column exists."""
    if source not in df.columns or (only_if_absent and out in df.columns):
        return df
    return df.withColumn(out, flag_in_set(source, words))


def clean_table(df: DataFrame, health_words: Sequence[str] = POOR_HEALTH_WORDS) -> DataFrame:
    """Raw soldier table to cleaned table: names, readiness label, morale and health flags."""
    df = fix_spelling(df)
    if "soldier_readiness" in df.columns:
        label = cut_label("soldier_readiness", READY_CUT, "ready", "not_ready")
        df = df.withColumn("soldier_readiness_bin", label)
    df = add_flag(df, "morale", LOW_MORALE_WORDS, "low_morale")
    return add_flag(df, "behavioral_health", health_words, "poor_behavioral_health")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that have every listed column the frame knows."""
    return df.filter(is_complete(df, present(df, cols)))


def complete_case_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row counts before and after ``complete_cases``, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_complete(df, present(df, cols))).alias("n_complete"),
    )


def selection_predicate(df: DataFrame, selection: Mapping[str, object]) -> Column:
    """AND of ``column = value``; ``All``, empty values and unknown columns do not filter.

    Text columns are compared as they are, so that the predicate reaches the file scan.
    """
    kinds = dict(df.dtypes)
    tests = [
        (F.col(c) if kinds[c] == "string" else F.col(c).cast("string")) == F.lit(str(v))
        for c, v in selection.items()
        if c in kinds and v not in (None, "", ALL)
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_equal(df: DataFrame, selection: Mapping[str, object]) -> DataFrame:
    return df.filter(selection_predicate(df, selection))


def options(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a column as text, missing ones left out."""
    text = F.col(col).cast("string")
    return df.filter(text.isNotNull()).select(text.alias("option")).distinct().orderBy("option")


def unit_options(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per existing unit path with its row count: the source of cascading choices."""
    levels = present(df, levels)
    return (
        df.select([F.col(c).cast("string").alias(c) for c in levels])
        .groupBy(*levels)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*levels)
    )


def options_within(units: DataFrame, level: str, chosen: Mapping[str, object]) -> DataFrame:
    """Options of one level below the choices made above it, from a ``unit_options`` table."""
    return options(filter_equal(units, chosen), level)


def pick_record(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def seeded_hash(key: str, seed: int | str = SEED) -> Column:
    """md5 of seed and key: an order that looks random and is the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def pick_random(df: DataFrame, key: str, seed: int | str = SEED) -> DataFrame:
    """The one record whose seeded hash is lowest."""
    return df.orderBy(seeded_hash(key, seed), key).limit(1)
