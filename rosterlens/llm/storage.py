"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from rosterlens.functions.small_tables import shared_dir

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a row group where each may have megabytes.
LARGE_ROWS = 8


def written(df: DataFrame, release: bool = False, large_rows: bool = False) -> DataFrame:
    """Write a frame as Parquet under ``spark.checkpoint.dir`` and read it back.

    It is computed once, its lineage ends, and a lost executor takes nothing with it.  With ``release`` the files of
    its shuffles go as soon as it is written, not when the driver next collects garbage.  A task holds a row group as a
    whole, when it writes it and, up to 4,096 rows of it, in each column when it reads it; ``large_rows`` keeps them short.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.option("parquet.block.row.count.limit", LARGE_ROWS) if large_rows else out).parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)
