"""Areas under the ROC curve of many models from one shuffle.

Rows are counted by model and score where they are, dealt to ranges of (model, score), and each range adds up what its
positives win against its own negatives.  How many negatives the ranges below hold is a sum over a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "part int, model string, pos long, neg long, won double"


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.groupby(["model", "p"], as_index=False, sort=True)[["pos", "neg"]].sum()


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (model, p, pos, neg) with equal scores put together, batch by batch."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pandas(_counted(batch.to_pandas()), preserve_index=False)


def _won(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of sorted rows, for each model in it: positives, negatives, and pairs won within (ties half)."""
    total: dict[str, list[float]] = {}
    open_ = None  # the last score may go on in the next batch
    part = TaskContext.get().partitionId()

    def close(groups: pd.DataFrame) -> None:
        for model, g in groups.groupby("model", sort=False):
            t = total.setdefault(model, [0, 0, 0.0])
            pos, neg = g["pos"].to_numpy(), g["neg"].to_numpy()
            below = t[1] + np.cumsum(neg) - neg
            total[model] = [t[0] + int(pos.sum()), t[1] + int(neg.sum()), t[2] + float((pos * (below + neg / 2)).sum())]

    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        groups = _counted(rows if open_ is None else pd.concat([open_, rows]))
        open_ = groups.iloc[-1:]
        close(groups.iloc[:-1])
    if open_ is not None:
        close(open_)
    rows = [(part, m, *t) for m, t in total.items()]
    made = zip(*rows) if rows else [[]] * 5
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(made, kinds)], names=["part", "model", "pos", "neg", "won"])


def roc_aucs(df: DataFrame, model: str, label: str, prob: str) -> DataFrame:
    """(model, n, auc) of rows (model, label, prob); ties count half, auc is null where there is only one class.

    Rows without a label or a score are not counted.
    """
    known = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull() & F.col(model).isNotNull()).select(
        F.col(model).cast("string").alias("model"),
        (F.col(prob).cast("double") + 0.0).alias("p"),
        F.when(F.col(label) == 1, 1).otherwise(0).cast("long").alias("pos"),
        F.when(F.col(label) == 1, 0).otherwise(1).cast("long").alias("neg"),
    )
    counts = known.mapInArrow(_local_counts, known.schema).repartitionByRange("model", "p").sortWithinPartitions("model", "p")
    parts = counts.mapInArrow(_won, PARTS).toPandas()  # a row for each range and each model that ends in it
    rows = []
    for name, g in parts.sort_values("part").groupby("model"):
        pos, neg = g["pos"].to_numpy(), g["neg"].to_numpy()
        won = g["won"].sum() + float((pos * (np.cumsum(neg) - neg)).sum())
        pairs = int(pos.sum()) * int(neg.sum())
        rows.append((name, int(pos.sum() + neg.sum()), float(won / pairs) if pairs else None))
    return df.sparkSession.createDataFrame(rows, "model string, n long, auc double")
