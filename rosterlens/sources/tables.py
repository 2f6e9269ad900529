"""Tables in and out: Parquet or CSV, explicit types, NaN turned into null at the door."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..schema import table_schema

SUFFIXES = {".parquet": "parquet", ".csv": "csv"}


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def format_of(path: str) -> str:
    lower = path.rstrip("/").lower()
    for suffix, fmt in SUFFIXES.items():
        if lower.endswith(suffix):
            return fmt
    if lower.endswith((".xlsx", ".xls")):
        raise ValueError(f"{path}: spreadsheets are not read; export the sheet to CSV or Parquet")
    raise ValueError(f"{path}: unknown table format; pass fmt='parquet' or fmt='csv'")


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    types_for: Callable[[list[str]], T.StructType] = table_schema,
) -> DataFrame:
    """Read one table.

    A CSV without a schema takes its column names from the header and its types from ``types_for``,
    so no inference pass over the data is needed.
    """
    fmt = fmt or format_of(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return nan_to_null(reader.parquet(path))
    if fmt == "csv":
        if schema is None:
            schema = types_for(spark.read.csv(path, header=True).columns)
        return nan_to_null(spark.read.csv(path, header=True, schema=schema))
    raise ValueError(f"unknown table format {fmt!r}")


def load_first(spark: SparkSession, candidates: Sequence[str], **options) -> DataFrame:
    """Read the first candidate that exists."""
    for path in candidates:
        if path_exists(spark, path):
            return load_table(spark, path, **options)
    raise FileNotFoundError(f"no table found; looked for {', '.join(candidates) or 'nothing'}")


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_drivers(drivers: DataFrame, reports_dir: str, kind: str, target: str) -> str:
    """Write a driver table (a handful of rows) as one CSV; ``kind`` is logreg or linreg."""
    path = f"{reports_dir.rstrip('/')}/drivers_{kind}_{target}.csv"
    drivers.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
