"""Keeping a frame that is read many times."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark import StorageLevel
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

FITS_AT_ONCE = 5  # the folds of a usual cross-validation, none of them alone at the end


def at_once(f: Callable[[Any], Any], of: Iterable) -> list:
    """``f`` of each item, a few jobs at a time: single fits leave most of a cluster idle."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(inherit(f), of))


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Cache a frame for the passes of a fit, in at least as many parts as there are cores.

    A frame of few input files would otherwise keep most cores idle in every pass.  A large one has
    more parts than cores already and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    frame = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frame.count()
        if frame.rdd.getNumPartitions() >= cores:
            yield frame
            return
        spread = frame.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            spread.count()
            frame.unpersist()
            yield spread
        finally:
            spread.unpersist()
    finally:
        frame.unpersist()
