"""Scores as columns.

A linear model is a small table (feature, mean, std, coefficient); written out as a ``Column`` it is
scored inside the same generated code as the rest of the query, and a what-if variant is the same
expression over other inputs.  Anything else is scored by its ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_col, clip
from ..schema import FeatureSpec
from .features import FEATURES, category_levels, feature_names, scaler_steps, scaling
from .trees import FlatTrees, blocks_of, joined


@dataclass(frozen=True)
class LinearScore:
    """A linear or logistic model: numeric terms (column, mean, std, coef), level terms
    (column, level, coef), and the link, ``logit`` or ``identity``."""

    intercept: float
    numeric: tuple[tuple[str, float, float, float], ...] = ()
    levels: tuple[tuple[str, str, float], ...] = ()
    link: str = "logit"
    bounds: tuple[float, float] | None = None

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([t[0] for t in self.numeric] + [t[0] for t in self.levels]))

    def terms(self, inputs: Mapping[str, Column] | None = None) -> list[tuple[str, Column]]:
        """(feature name, coefficient x prepared value) of every feature."""
        at = _lookup(inputs)
        out = []
        for c, mean, std, coef in self.numeric:
            x = at(c).cast("double")
            out.append((f"num__{c}", F.lit(coef) * ((x - mean) / std) if std else F.lit(0.0)))
        for c, level, coef in self.levels:
            hit = F.coalesce(at(c).cast("string") == level, F.lit(False))
            out.append((f"cat__{c}_{level}", F.when(hit, F.lit(coef)).otherwise(F.lit(0.0))))
        return out

    def margin(self, inputs: Mapping[str, Column] | None = None) -> Column:
        """Intercept plus all terms, with the scaling folded into one slope per column."""
        at = _lookup(inputs)
        live = [t for t in self.numeric if t[2]]
        const = self.intercept - sum(coef * mean / std for _, mean, std, coef in live)
        parts = [F.lit(coef / std) * at(c).cast("double") for c, _, std, coef in live]
        by_column: dict[str, list[tuple[str, float]]] = {}
        for c, level, coef in self.levels:
            by_column.setdefault(c, []).append((level, coef))
        for c, pairs in by_column.items():
            value = at(c).cast("string")
            chain = reduce(lambda w, p: w.when(value == p[0], F.lit(p[1])), pairs, F)
            parts.append(chain.otherwise(F.lit(0.0)))
        return reduce(lambda a, b: a + b, parts, F.lit(float(const)))

    def score(self, inputs: Mapping[str, Column] | None = None) -> Column:
        m = self.margin(inputs)
        y = 1.0 / (1.0 + F.exp(-m)) if self.link == "logit" else m
        return clip(y, *self.bounds) if self.bounds else y

    def clamped(self, low: float = 0.0, high: float = 1.0) -> LinearScore:
        return replace(self, bounds=(low, high))


#: Nodes up to which trees are written out as conditions; more of them are walked in Arrow batches.
WRITTEN_NODES = 400


@dataclass(frozen=True)
class TreeScore:
    """Trees as one column over the raw inputs: thresholds are on the inputs themselves, levels are 0/1 features.

    Like a ``LinearScore`` it can stand several times in a query, over changed inputs too, in one scan.  A row with a
    missing numeric input has no score.
    """

    trees: FlatTrees
    numeric: tuple[str, ...] = ()
    levels: tuple[tuple[str, str], ...] = ()
    bounds: tuple[float, float] | None = None

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.numeric, *(c for c, _ in self.levels)]))

    def score(self, inputs: Mapping[str, Column] | None = None) -> Column:
        at = _lookup(inputs)
        t = self.trees
        used = sorted({int(f) for f in t.feature if f >= 0})
        hits = {}
        for f in used:
            if f < len(self.numeric):
                hits[f] = at(self.numeric[f]).cast("double")
            else:
                c, level = self.levels[f - len(self.numeric)]
                hits[f] = F.coalesce(at(c).cast("string") == level, F.lit(False))
        y = self._written(hits) if len(t.feature) <= WRITTEN_NODES else self._walked(hits, used)
        whole = reduce(lambda a, b: a & b, [at(c).isNotNull() & ~F.isnan(at(c).cast("double")) for c in self.numeric], F.lit(True))
        y = F.when(whole, y)
        return clip(y, *self.bounds) if self.bounds else y

    def _written(self, hits: Mapping[int, Column]) -> Column:
        t = self.trees

        def node(i: int) -> Column:
            f = int(t.feature[i])
            if f < 0:
                return F.lit(float(t.value[i]))
            low = hits[f] <= float(t.threshold[i]) if f < len(self.numeric) else ~hits[f]
            return F.when(low, node(t.left[i])).otherwise(node(t.right[i]))

        return reduce(lambda a, b: a + b, [node(r) for r in t.roots], F.lit(float(t.base)))

    def _walked(self, hits: Mapping[int, Column], used: list[int]) -> Column:
        place = np.full(max(used) + 1, -1)
        place[used] = np.arange(len(used))
        t = replace(self.trees, feature=np.where(self.trees.feature >= 0, place[self.trees.feature], -1))
        shipped = SparkSession.active().sparkContext.broadcast(t)

        @F.pandas_udf("double")
        def walked(*x: pd.Series) -> pd.Series:
            return pd.Series(shipped.value.predict(np.column_stack([v.to_numpy(dtype=float) for v in x])))

        return walked(*[hits[f].cast("double") for f in used])


def tree_score(model: PipelineModel, spec: FeatureSpec) -> TreeScore:
    """Read a fitted forest or boosted pipeline (preparation, model) as a ``TreeScore``, equal in every comparison."""
    prep, fitted = model.stages
    t = joined(list(blocks_of(fitted)))
    raw = t.threshold.copy()
    for j, (c, (mean, by, factor)) in enumerate(scaler_steps(prep, spec).items()):
        prepared = lambda v: (v - mean) * by * factor  # noqa: B023, E731
        for i in np.flatnonzero(t.feature == j):
            raw[i] = _largest_up_to(prepared, t.threshold[i], mean + t.threshold[i] / (by * factor) if by else 0.0)
    levels = tuple((c, level) for c, all_ in category_levels(prep, spec).items() for level in all_[1:])
    return TreeScore(replace(t, threshold=raw), spec.numeric, levels)


def _largest_up_to(f, limit: float, start: float) -> float:
    """The largest number whose image under a growing function is at most ``limit``."""
    if f(start) == f(start + 1.0):  # a constant feature
        return np.inf if f(start) <= limit else -np.inf
    reach = max(abs(start), 1.0) * 1e-9
    low, high = start - reach, start + reach
    while f(low) > limit:
        low, reach = low - reach, 2 * reach
    while f(high) <= limit:
        high, reach = high + reach, 2 * reach
    while low < (middle := (low + high) / 2) < high:
        low, high = (middle, high) if f(middle) <= limit else (low, middle)
    return float(low)


def _lookup(inputs: Mapping[str, Column] | None):
    return lambda c: (inputs or {}).get(c, F.col(c))


def linear_score(model: PipelineModel, spec: FeatureSpec) -> LinearScore:
    """Read a fitted linear or logistic pipeline (preparation, model) as a ``LinearScore``."""
    prep, fitted = model.stages
    if not isinstance(fitted, (LogisticRegressionModel, LinearRegressionModel)):
        raise TypeError(f"no coefficients in {type(fitted).__name__}")
    coefs = [float(x) for x in fitted.coefficients.toArray()]
    scale = scaling(prep, spec)
    numeric = tuple((c, *scale[c], coefs[i]) for i, c in enumerate(spec.numeric))
    rest = iter(coefs[len(spec.numeric) :])
    levels = tuple(
        (c, level, next(rest)) for c, all_ in category_levels(prep, spec).items() for level in all_[1:]
    )
    link = "logit" if isinstance(fitted, LogisticRegressionModel) else "identity"
    return LinearScore(float(fitted.intercept), numeric, levels, link)


def add_scores(
    df: DataFrame,
    models: Mapping[str, LinearScore | TreeScore | PipelineModel],
    names: Mapping[str, str] | None = None,
    inputs: Mapping[str, Column] | None = None,
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Add one score column per model: probability of class 1, or the predicted value.

    ``names`` maps model to output column (default: the model's own name).  ``inputs`` replaces
    input columns for this scoring only.  All models are scored in one pass over the rows; models
    that share a preparation share its result.  A row with a missing numeric input has no score, in
    either form of a model.
    """
    names = names or {m: m for m in models}
    bounds = bounds or {}
    inline = {m: s for m, s in models.items() if isinstance(s, (LinearScore, TreeScore))}
    piped = {m: p for m, p in models.items() if m not in inline}
    scores = {names[m]: _bounded(s.score(inputs), bounds.get(m)) for m, s in inline.items()}
    out = df.withColumns(scores) if scores else df
    if not piped:
        return out
    changed = {c: e for c, e in (inputs or {}).items() if c in df.columns}
    kept = {f"_kept_{c}": F.col(c) for c in changed}
    if changed:
        out = out.withColumns(kept).withColumns(dict(changed))
    visible = list(out.columns)
    prepared_by, at = None, out
    for m, p in sorted(piped.items(), key=lambda kv: (kv[1].stages[0].uid, kv[0])):
        prep, fitted = p.stages
        if prep.uid != prepared_by:
            at = prep.transform(at.select(*visible)).select(*visible, FEATURES)
            prepared_by = prep.uid
        scored = fitted.transform(at)
        if isinstance(fitted, LogisticRegressionModel):
            y = vector_to_array(fitted.getProbabilityCol())[1]
        else:
            y = F.col(fitted.getPredictionCol())
        visible.append(names[m])
        whole = ~F.exists(vector_to_array(F.col(FEATURES)), F.isnan)
        at = scored.withColumn(names[m], F.when(whole, _bounded(y, bounds.get(m)))).select(*visible, FEATURES)
    restored = at.select(*visible)
    if changed:
        restored = restored.withColumns({c: F.col(f"_kept_{c}") for c in changed}).drop(*kept)
    return restored


def _bounded(y: Column, limits: tuple[float, float] | None) -> Column:
    return clip(y, *limits) if limits else y


def apply_threshold(p: Column | str, threshold: float) -> Column:
    return (as_col(p) >= F.lit(threshold)).cast("int")


def coefficient_table(model: PipelineModel, spec: FeatureSpec) -> DataFrame:
    """(feature, coef) of a fitted linear pipeline in feature order."""
    prep, fitted = model.stages
    names = feature_names(prep, spec)
    rows = [(n, float(c)) for n, c in zip(names, fitted.coefficients.toArray(), strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coef double")
