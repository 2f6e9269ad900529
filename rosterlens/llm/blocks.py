"""Documents gathered to blocks of bounded size, one row each, inside the tasks that read them; small forms of arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession

#: A block's number is that of its partition and its place in it.
PLACE_BITS = 40


def gathered(batches: Iterator[pa.RecordBatch], block_chars: int, text: str = "text") -> Iterator[tuple[int, pa.Table, list[str]]]:
    """Block number, rows and their texts (null: empty); a block is full once its texts have ``block_chars``.

    Numbers are unique within the stage; write the result once, so that they stay with their rows.
    """
    place = TaskContext.get().partitionId() << PLACE_BITS
    rows: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        start = 0
        for i, t in enumerate(batch.column(text).to_pylist()):
            texts.append(t or "")
            size += len(texts[-1]) + 1
            if size >= block_chars:
                rows.append(batch.slice(start, i + 1 - start))
                yield place, pa.Table.from_batches(rows), texts
                place, rows, texts, size, start = place + 1, [], [], 0, i + 1
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if texts:
        yield place, pa.Table.from_batches(rows), texts


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """Within, Arrow batches hold a few rows only: blocks are large.  For jobs that end within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def pressed(raw: bytes) -> bytes:
    """Compressed bytes, after their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpressed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def pressed_numbers(a: np.ndarray) -> bytes:
    """Numbers from zero on, by planes of bytes, as many as the largest needs: equal planes take next to nothing."""
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pressed(planes.tobytes())


def unpressed_numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unpressed(raw[1:]), np.uint8).reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = planes.T
    return wide.view("<i8").ravel()
