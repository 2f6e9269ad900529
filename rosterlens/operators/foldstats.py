"""Cross-validation of least squares from sums by fold.

One scan adds up the products of all pairs of columns in each fold.  The sums of a model's train rows are all sums
less those of its own fold, and so are its coefficients; its error on the fold is a quadratic form of the
fold's sums.  Nothing is fitted or scored on rows again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number
from ..schema import FeatureSpec
from .features import FEATURES, category_levels, feature_names, fit_preparation, prepare
from .sums import matrix, packed, square, summed, triangle


def fold_sums(rows: DataFrame, width: int, k: int) -> np.ndarray:
    """For each fold the products of all pairs of columns of rows of (fold, z), added up."""
    size = triangle(width)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        fold, z = batch.column(0).to_numpy(), matrix(batch.column(1), width)
        return np.concatenate([packed(z[fold == i].T @ z[fold == i]) for i in range(k)])

    return np.array([square(v, width) for v in summed(rows, k * size, part).reshape(k, size)])


def cross_validate_linear(df: DataFrame, features: FeatureSpec, label: str, fold: str, k: int) -> DataFrame:
    """(fold, n, rmse, r2) of least squares on the other folds, as ``cross_validate`` gives by refitting.

    Rows need all features and a label.  Levels that the train rows lack are as their first level, and a number
    that is constant there has no coefficient.
    """
    prep = fit_preparation(df, features)
    names, cats = feature_names(prep, features), category_levels(prep, features)
    y = number(label)
    middle = df.agg(F.avg(y)).first()[0] or 0.0
    vector = vector_to_array(FEATURES, "float64")
    z = F.concat(F.array(F.lit(1.0)), vector, F.array((y - F.lit(middle)).cast("double")))
    rows = prepare(prep, df.where(y.isNotNull())).select(F.col(fold).cast("int").alias("fold"), z.alias("z"))
    sums = fold_sums(rows, len(names) + 2, k)

    # every level as a column of its own: the first one is what the others leave of 1
    numeric, at = len(features.numeric), 1 + len(features.numeric)
    spread = [np.eye(len(names) + 2)[: 1 + numeric]]
    groups = []
    start = 1 + numeric
    for levels in cats.values():
        own = np.eye(len(names) + 2)[at : at + len(levels) - 1]
        spread += [np.eye(len(names) + 2)[[0]] - own.sum(axis=0), own]
        groups.append(range(start, start + len(levels)))
        at, start = at + len(levels) - 1, start + len(levels)
    to = np.concatenate([*spread, np.eye(len(names) + 2)[[-1]]])
    sums = to @ sums @ to.T
    scores = []
    for i, held in enumerate(sums):
        n = round(held[0, 0])
        if not n:
            continue
        train = sums.sum(axis=0) - held
        live = np.diag(train) > 0.5 / max(len(names), 1)
        spread_ = np.diag(train)[1 : 1 + numeric] - train[0, 1 : 1 + numeric] ** 2 / max(train[0, 0], 1)
        live[1 : 1 + numeric] = spread_ > 1e-9 * max(train[0, 0], 1)
        for g in groups:
            seen = [j for j in g if live[j]]
            live[seen[:1]] = False  # the first level there is the base
        x = np.flatnonzero(live[:-1])
        b = np.linalg.lstsq(train[np.ix_(x, x)], train[x, -1], rcond=1e-13)[0]
        error = held[-1, -1] - 2 * b @ held[x, -1] + b @ held[np.ix_(x, x)] @ b
        error = max(float(error), 0.0)
        total = float(held[-1, -1] - held[0, -1] ** 2 / held[0, 0])
        r2 = 1 - error / total if total > 0 else float(error == 0)
        scores.append((i, n, float(np.sqrt(error / n)), r2))
    return df.sparkSession.createDataFrame(scores, "fold int, n long, rmse double, r2 double")
