"""Sums of many numbers over all rows in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 8192


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(df: DataFrame, size: int, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (an array of ``size`` numbers) over all batches of a frame.

    Each task adds up its own batches; Spark adds up the tasks' numbers, place by place.  What reaches the
    driver is one array, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                total += part(batch.slice(at, BATCH))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "v"])

    table = df.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[table.column("place").to_numpy()] = table.column("v").to_numpy()
    return out


def triangle(n: int) -> int:
    """Numbers of a symmetric matrix of ``n`` rows, each pair once."""
    return n * (n + 1) // 2


def packed(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def square(v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = v
    return out + np.triu(out, 1).T
