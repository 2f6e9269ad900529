"""Table checks and scalings: row totals, duplicates, outliers, ranges, normalisation, PCA, k-means."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number
from ..schema import SEED, FeatureSpec
from .features import FEATURES, feature_names, fit_preparation, prepare
from .quantiles import exact_quantiles
from .sums import BATCH, matrix


def row_total(
    df: DataFrame, cols: Sequence[str], out: str, heavy_from: float, labels: Mapping[str, float]
) -> DataFrame:
    """Add the row total of several columns, ``<out>_heavy`` (total >= heavy_from) and
    ``<out>_label``: the name of the highest step of ``labels`` (name to lower bound) reached."""
    total = sum(F.coalesce(number(c), F.lit(0.0)) for c in cols)
    df = df.withColumn(out, total)
    label = F.lit(None).cast("string")
    for name, start in sorted(labels.items(), key=lambda kv: kv[1]):
        label = F.when(F.col(out) >= start, name).otherwise(label)
    return df.withColumns(
        {f"{out}_heavy": (F.col(out) >= heavy_from).cast("int"), f"{out}_label": label}
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def outlier_counts(df: DataFrame, cols: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Per column: the interquartile fences and the number of values outside."""
    q = exact_quantiles(df, cols, (0.25, 0.75)).groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q25"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q75"),
    )
    fences = {}
    for r in q.collect():  # one row per column
        iqr = r["q75"] - r["q25"]
        fences[r["column"]] = (r["q25"] - reach * iqr, r["q75"] + reach * iqr)
    return range_violations(df, fences)


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(column, low, high, n_outside) in one pass."""
    counted = df.agg(
        *[F.count_if((number(c) < lo) | (number(c) > hi)).alias(f"n_{i}") for i, (c, (lo, hi)) in enumerate(ranges.items())]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(float(lo)).alias("low"),
            F.lit(float(hi)).alias("high"),
            F.col(f"n_{i}").alias("n_outside"),
        )
        for i, (c, (lo, hi)) in enumerate(ranges.items())
    ]
    return counted.select(F.inline(F.array(*rows)))


def normalise(df: DataFrame, cols: Sequence[str], how: str = "zscore") -> DataFrame:
    """Replace columns by (x - mean) / population std, or by (x - min) / (max - min).

    The scalars come from one aggregate and enter the plan as literals; a constant column gives 0.
    """
    scalars = {
        "zscore": lambda x: (F.avg(x), F.stddev_pop(x)),
        "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
    }
    if how not in scalars:
        raise ValueError(f"unknown scaling {how!r}")
    found = df.agg(*[e for c in cols for e in scalars[how](number(c))]).first()
    exprs = {}
    for i, c in enumerate(cols):
        a, b = found[2 * i], found[2 * i + 1]
        exprs[c] = (number(c) - a) / b if b else F.when(number(c).isNotNull(), 0.0)
    return df.withColumns(exprs)


def fit_groups(
    df: DataFrame, features: FeatureSpec, k: int, components: int | None = None, seed: int = SEED, max_iter: int = 300
) -> PipelineModel:
    """k-means on the prepared features, after a projection on principal components if asked.

    The model adds ``group`` (and ``components``) to a table.
    """
    prep = fit_preparation(df, features)
    stages, source = [], FEATURES
    if components:
        stages.append(PCA(k=components, inputCol=FEATURES, outputCol="components"))
        source = "components"
    stages.append(KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=source, predictionCol="group"))
    return PipelineModel(stages=[prep, *Pipeline(stages=stages).fit(prep.transform(df)).stages])


def principal_components(df: DataFrame, features: FeatureSpec, k: int) -> tuple[DataFrame, DataFrame]:
    """(component, share) of the ``k`` strongest, and (component, feature, loading), of the prepared features.

    Tasks reduce their rows to the triangle of a QR decomposition, and triangles to one, in two rounds: products
    of columns, which square the error, are never formed.  A first column of ones takes the means out.  A
    component's largest loading is positive.
    """
    prep = fit_preparation(df, features)
    names = feature_names(prep, features)
    width = len(names) + 1
    rows = prepare(prep, df).select(F.concat(F.array(F.lit(1.0)), vector_to_array(FEATURES, "float64")).alias("x"))

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                r = np.linalg.qr(np.concatenate([r, matrix(batch.slice(at, BATCH).column(0), width)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["x"])

    first = rows.mapInArrow(triangle, "x array<double>")
    # shuffled, not coalesced: the first round keeps its tasks, and only triangles meet in the fewer ones of the second
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    second = first.repartition(parts).mapInArrow(triangle, "x array<double>").toArrow()  # parts x width rows at most
    r = np.linalg.qr(matrix(second.column(0).combine_chunks(), width), mode="r") if second.num_rows else np.zeros((0, width))
    _, s, v = np.linalg.svd(r[1:, 1:], full_matrices=False)
    v *= np.sign(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1))
    spark, total = df.sparkSession, float((s**2).sum()) or 1.0
    shares = [(i + 1, float(x * x / total)) for i, x in enumerate(s[:k])]
    loadings = [(i + 1, f, float(x)) for i, row in enumerate(v[:k]) for f, x in zip(names, row)]
    return spark.createDataFrame(shares, "component int, share double"), spark.createDataFrame(loadings, "component int, feature string, loading double")
