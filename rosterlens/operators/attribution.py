"""Shapley values of tree predictions, per record and feature.

Trees come in blocks of a bounded size and values add up over blocks, so neither the driver nor a task ever holds
a large forest; Spark hands the rows to tasks in Arrow batches.  The recursion itself is in ``trees``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.small_tables import cut_lineage
from .features import FEATURES
from .sums import matrix
from .trees import BLOCK_NODES, FlatTrees, blocks_of


def with_block(rows: DataFrame, width: int, block: FlatTrees) -> DataFrame:
    """Rows of (key, x, phi) with the values of some trees added to ``phi``."""
    shipped = rows.sparkSession.sparkContext.broadcast(block)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value.explainers()
        for batch in batches:
            if batch.num_rows:
                x, phi = (matrix(batch.column(i), width) for i in (1, 2))
                total = phi + shipped.value.shapley(x, trees)
                ends = pa.array(np.arange(len(x) + 1) * width, pa.int32())
                added = pa.ListArray.from_arrays(ends, pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), added], names=names)

    return rows.mapInArrow(run, rows.schema)


def tree_attribution(
    prepared: DataFrame,
    key: str,
    model,
    names: list[str],
    block_nodes: int = BLOCK_NODES,
) -> tuple[DataFrame, float]:
    """((key, feature, value) for every row and feature, expectation of the model).

    For every row, values + expectation = prediction.  A model of more than one block is passed block by
    block, with the sums so far in the shared folder.  Rows in fewer parts than there are cores are spread out first:
    a row is much work.
    """
    zeros = F.array_repeat(F.lit(0.0), len(names))
    rows = prepared.select(F.col(key), vector_to_array(FEATURES).alias("x"), zeros.alias("phi"))
    cores = prepared.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    expected = 0.0
    last = None
    for block in blocks_of(model, block_nodes):
        if last is not None:
            rows = cut_lineage(with_block(rows, len(names), last))
        expected += block.expected()
        last = block
    rows = with_block(rows, len(names), last)
    labels = F.array(*[F.lit(n) for n in names])
    long = rows.select(key, F.posexplode("phi").alias("i", "value")).select(
        key, F.element_at(labels, F.col("i") + 1).alias("feature"), "value"
    )
    return long, expected


def attribution_summary(values: DataFrame) -> DataFrame:
    """Mean absolute value per feature, strongest first."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("value")).alias("mean_abs_value"))
        .orderBy(F.desc("mean_abs_value"), "feature")
    )
