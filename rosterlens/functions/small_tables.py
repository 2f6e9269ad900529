"""Joining a table that is expected to be small, without trusting that it is.

Statistics tables (one row per group, stratum or bin) are usually tiny but their size depends on the
data.  ``attach`` looks at rows and bytes before it broadcasts and has a salted shuffle join for the other case.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or a fresh one where one machine is all there is."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = tempfile.mkdtemp(prefix="rosterlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so lost executors do not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _bytes(value) -> int:
    """About the size of a value of a row; text and lists count by length."""
    if isinstance(value, (str, bytes, bytearray)):
        return len(value)
    return sum(map(_bytes, value)) if isinstance(value, (tuple, list)) else 8


def pinned(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, bool]:
    """Compute ``df`` once.  Returns (frame, whether it is within ``max_rows`` and ``max_bytes``)."""
    # coalesced, so that the limit is one job and not a series of growing attempts
    rows = df.limit(max_rows + 1).coalesce(1).collect()
    if len(rows) <= max_rows and sum(map(_bytes, rows)) <= max_bytes:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return cut_lineage(df), False


def computed(df: DataFrame) -> DataFrame:
    """A report table evaluated now, while the rows it reads are still cached."""
    return pinned(df)[0]


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join ``big`` with a statistics table ``small`` on non-null keys.

    Broadcast when ``small`` was counted to fit; otherwise every row of ``small`` is repeated per
    salt so that no key of ``big``, however hot, lands in a single task.
    """
    table, fits = pinned(small, max_rows)
    return join_pinned(big, table, fits, on, how)


def join_pinned(
    big: DataFrame, table: DataFrame, fits: bool, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """The join of ``attach`` for a table that ``pinned`` already looked at."""
    on = list(on)
    if how not in ("inner", "left"):
        raise ValueError(f"attach keeps rows of the big side only: {how}")
    if fits:
        return big.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = [c for c in big.columns if c not in on] or on
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    return big.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")
