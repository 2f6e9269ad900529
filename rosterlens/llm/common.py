"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch: texts may be long, and a batch is in memory as a whole.
BATCH_ROWS = 512

#: A word of the contracts: anything but space and the ASCII controls tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores before it while a column of that name exists (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    fn: Callable[..., Sequence[Sequence]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Append columns that ``fn`` computes from lists of the input columns' values, batch by batch.

    ``fn(*lists)`` returns one list per new field.  Other columns pass through in Arrow form; those in
    ``drop`` are left out.
    """
    small_batches(df.sparkSession)
    places = [df.columns.index(c) for c in inputs]
    stay = [i for i, c in enumerate(df.columns) if c not in drop]
    schema = T.StructType([df.schema.fields[i] for i in stay] + list(fields))
    kinds = [arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(*(batch.column(i).to_pylist() for i in places))
                new = [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in stay] + new, names=names)

    return df.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fold(column: str | Column, n: int) -> Column:
    """crc32 of an id as text modulo ``n``; -1 for a null id, which thus is in no held-out part."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column) % n, F.lit(-1))


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def shuffled_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input, which is never a broadcast.

    Spark sizes a side by the bytes of the files or shuffles under it.  An explode is not counted, so a side of many
    times those rows would pass for a small table and be collected on the driver.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)
