"""Feature preparation as an MLlib pipeline with scikit-learn's conventions.

Numerics: (x - mean) / population std, a constant column gives 0.  Categories: one column per level
except the first in sorted order; a missing or unseen level is all zeros.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FeatureSpec

FEATURES = "features"
#: Levels that a categorical feature may have: all of them are held by the driver and in every vector.
MAX_LEVELS = 10_000
#: Features up to which ``prepare`` writes the stages out as column expressions.
WRITTEN_OUT = 200
_NUM, _SCALED, _STD, _ALL = "_num", "_scaled", "_std", "_all_features"


def _idx(c: str) -> str:
    return f"_idx_{c}"


def _hot(c: str) -> str:
    return f"_hot_{c}"


def fit_preparation(df: DataFrame, spec: FeatureSpec) -> PipelineModel:
    """Fit on complete cases.  Output: one ``features`` vector, numerics first.

    A categorical column of (about) more than ``MAX_LEVELS`` levels is an error.
    """
    stages, parts, keep = [], [], []
    cats = list(spec.categorical)
    n, *levels = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in cats]).first()
    wide = [c for c, k in zip(cats, levels, strict=True) if k > MAX_LEVELS]
    if wide:
        raise ValueError(f"too many levels for a categorical feature: {', '.join(wide)}")
    if spec.numeric:
        # the scaler divides by the sample std; this factor turns it into the population one
        factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        stages += [
            VectorAssembler(inputCols=list(spec.numeric), outputCol=_NUM),
            StandardScaler(inputCol=_NUM, outputCol=_SCALED, withMean=True, withStd=True),
            ElementwiseProduct(inputCol=_SCALED, outputCol=_STD, scalingVec=[factor] * len(spec.numeric)),
        ]
        parts.append(_STD)
        keep += range(len(spec.numeric))
    if cats:
        stages += [
            StringIndexer(
                inputCols=cats,
                outputCols=[_idx(c) for c in cats],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=[_idx(c) for c in cats], outputCols=[_hot(c) for c in cats], dropLast=True
            ),
        ]
        parts += [_hot(c) for c in cats]
    fitted = Pipeline(stages=stages).fit(df)
    # the encoder left out the "unseen" slot; leave out the first level of every column as well
    at = len(spec.numeric)
    for labels in _labels(fitted):
        keep += range(at + 1, at + len(labels))
        at += len(labels)
    assemble = VectorAssembler(inputCols=parts, outputCol=_ALL)
    cut = VectorSlicer(inputCol=_ALL, outputCol=FEATURES, indices=list(keep))
    for stage in fitted.stages:
        if isinstance(stage, VectorAssembler):
            stage.setHandleInvalid("keep")  # fitted on complete rows; a missing input is NaN in the features
    return PipelineModel(stages=[*fitted.stages, assemble, cut])


def _labels(prep: PipelineModel) -> list[list[str]]:
    indexers = [s for s in prep.stages if isinstance(s, StringIndexerModel)]
    return [list(levels) for s in indexers for levels in s.labelsArray]


def prepare(prep: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``features`` and drop the helper columns.

    Up to ``WRITTEN_OUT`` features are computed by column expressions with the arithmetic of the stages, since a row
    is otherwise turned into a vector and back by each of them.
    """
    out = prep.transform(df)
    written = _written_out(prep)
    if written is None:
        return out.select(*df.columns, FEATURES)
    about = out.schema[FEATURES].metadata  # trees read there which features are 0 or 1
    return df.select(*df.columns, array_to_vector(F.array(*written)).alias(FEATURES, metadata=about))


def _written_out(prep: PipelineModel) -> list[Column] | None:
    """The features as doubles, in order; None if they are too many or the stages others than ``fit_preparation`` makes."""
    first = prep.stages[0] if prep.stages else None
    numeric = first.getInputCols() if isinstance(first, VectorAssembler) and first.getOutputCol() == _NUM else []
    indexers = [s for s in prep.stages if isinstance(s, StringIndexerModel)]
    levels = [(c, list(of)) for s in indexers for c, of in zip(s.getInputCols(), s.labelsArray, strict=True)]
    width = len(numeric) + sum(max(0, len(of) - 1) for _, of in levels)
    if not 0 < width <= WRITTEN_OUT or prep.stages[-1].getOutputCol() != FEATURES:
        return None
    steps = scaler_steps(prep, FeatureSpec(tuple(numeric), ()))
    out = []
    for c, (mean, times, again) in steps.items():
        x = F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        out.append((x - F.lit(mean)) * F.lit(times) * F.lit(again))
    for c, of in levels:
        out += [F.coalesce((F.col(c).cast("string") == F.lit(level)).cast("double"), F.lit(0.0)) for level in of[1:]]
    return out


def category_levels(prep: PipelineModel, spec: FeatureSpec) -> dict[str, list[str]]:
    """Sorted levels per categorical column, the dropped first one included."""
    return dict(zip(spec.categorical, _labels(prep), strict=True))


def feature_names(prep: PipelineModel, spec: FeatureSpec) -> list[str]:
    """``num__x`` and ``cat__col_level`` in the order of the feature vector."""
    names = [f"num__{c}" for c in spec.numeric]
    for c, levels in category_levels(prep, spec).items():
        names += [f"cat__{c}_{level}" for level in levels[1:]]
    return names


def scaling(prep: PipelineModel, spec: FeatureSpec) -> dict[str, tuple[float, float]]:
    """(mean, population std) per numeric column."""
    if not spec.numeric:
        return {}
    scaler = next(s for s in prep.stages if isinstance(s, StandardScalerModel))
    product = next(s for s in prep.stages if isinstance(s, ElementwiseProduct))
    factor = product.getScalingVec()[0]
    return {
        c: (float(m), float(s) / factor)
        for c, m, s in zip(spec.numeric, scaler.mean.toArray(), scaler.std.toArray(), strict=True)
    }


def scaler_steps(prep: PipelineModel, spec: FeatureSpec) -> dict[str, tuple[float, float, float]]:
    """(mean, multiplier, second multiplier) per numeric column, as the preparation applies them in turn."""
    if not spec.numeric:
        return {}
    scaler = next(s for s in prep.stages if isinstance(s, StandardScalerModel))
    factor = float(next(s for s in prep.stages if isinstance(s, ElementwiseProduct)).getScalingVec()[0])
    numbers = zip(spec.numeric, scaler.mean.toArray(), scaler.std.toArray(), strict=True)
    return {c: (float(m), 1.0 / float(s) if s else 0.0, factor) for c, m, s in numbers}


def feature_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Spread the feature vector into named double columns (for inspection)."""
    values = vector_to_array(FEATURES)
    return df.select(
        *[c for c in df.columns if c != FEATURES], *[values[i].alias(n) for i, n in enumerate(names)]
    )


def ordinal(df: DataFrame, col: str, order: list[str], out: str) -> DataFrame:
    """Text levels to 0, 1, 2, ... in the given order; other text becomes null."""
    code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col)) - 1
    return df.withColumn(out, F.when(code >= 0, code).cast("int"))
