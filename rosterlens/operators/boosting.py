"""Gradient boosting with second-order splits, a leaf penalty, and rows and columns drawn for each tree.

Rows are binned once and kept as blocks of codes with their current predictions.  A level of a tree is one aggregate:
tasks add up gradients and hessians by node, feature and bin, Spark sums what occurs, and the driver picks the splits
from a table whose size depends on nodes, features and bins only.  Gradients are whole multiples of a small unit, so sums
and trees do not depend on the order in which rows come.  Several models, one for each left-out fold, grow level
by level in the same passes; a cross-validation takes as many jobs as one fit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number
from ..functions.small_tables import computed, cut_lineage
from ..schema import SEED, FeatureSpec
from .evaluate import regression_metrics
from .features import FEATURES, fit_preparation, prepare
from .trees import FlatTrees

#: Rounds after which the rows' predictions are written to the shared folder; until then tasks add the trees since.
CHECKPOINT_ROUNDS = 10
BLOCK_ROWS = 16_384
ALL = -1  # the fold of rows that no model leaves out
LEAST_GAIN = 1e-6
#: Rows that a task should have at least: every level is a pass of its own, and starting a task takes as long as many rows.
TASK_ROWS = 1 << 18
#: Cells of a level, 16 bytes each, that a task adds up over its blocks; of more it sends each block's own.
TASK_CELLS = 1 << 20
#: Levels of splits whose leaves have numbers of one byte.
BYTE_LEVELS = 8

BLOCKS = T.StructType(
    [
        T.StructField("codes", T.BinaryType()),  # a row of bytes for each feature
        T.StructField("y", T.BinaryType()),
        T.StructField("draw", T.BinaryType()),  # a hash of each row, for row sampling
        T.StructField("fold", T.BinaryType()),
        T.StructField("margin", T.BinaryType()),  # a row of predictions for each model
    ]
)


@dataclass(frozen=True)
class Settings:
    rounds: int = 600
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.9
    column_share: float = 0.9
    penalty: float = 1.0
    least_weight: float = 1.0  # of the hessians on either side of a split
    bins: int = 256
    seed: int = SEED


@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2i + 1 and 2i + 2; feature -1 where there is no split."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)  # codes up to this one go left
    value: np.ndarray = field(init=False)
    cover: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(n, -1), np.zeros(n, int)
        self.value, self.cover, self.gain = np.zeros(n), np.zeros(n), np.zeros(n)

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        ends, path = self.paths(codes)
        return ends.take(path)

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        """The value of the node that each row has come to."""
        ends, path = self.paths(codes)
        return self.value[ends].take(path)

    def paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes, and for each row the place of its own among them.

        Few levels are compared as a whole, a byte a row and node; each side of a split is picked from what lies below it.
        """
        split = np.flatnonzero(self.feature >= 0)
        levels = int(split[-1] + 1).bit_length() if len(split) else 0
        if levels > BYTE_LEVELS:
            return np.arange(len(self.feature)), self._walked(codes)
        ends: list[int] = [0] * 2**levels

        def below(node: int, left: int, first: int) -> np.ndarray | np.uint8:
            if self.feature[node] < 0:
                ends[first] = node
                return np.uint8(first)
            half = 2 ** (left - 1)
            low, high = below(2 * node + 1, left - 1, first), below(2 * node + 2, left - 1, first + half)
            right = np.negative((codes[self.feature[node]] > np.uint8(self.bin[node])).view(np.uint8))  # all bits or none
            return low ^ ((low ^ high) & right)

        path = below(0, levels, 0)
        return np.array(ends), np.broadcast_to(path, codes.shape[1])

    def _walked(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(codes.shape[1], np.int64)
        rows = np.arange(codes.shape[1])
        for _ in range(self.depth):
            f = self.feature[at]
            below = 2 * at + 1 + (codes[np.maximum(f, 0), rows] > self.bin[at])
            at = np.where(f >= 0, below, at)
        return at


def bin_edges(prepared: DataFrame, features: int, bins: int) -> list[list[float]]:
    """Upper edges of the bins of each feature, from the sketched quantiles of its values; one pass."""
    shares = [i / bins for i in range(1, bins + 1)]
    sketch = [F.percentile_approx(F.col("x")[i], shares, 10 * bins).alias(f"q{i}") for i in range(features)]
    row = prepared.select(vector_to_array(FEATURES).alias("x")).agg(*sketch).first()
    return [sorted(set(q or [])) [:-1] for q in row]


def blocked(prepared: DataFrame, label: str, edges: list[list[float]], fold: str | None, start: Sequence[float]) -> DataFrame:
    """The rows of a prepared frame as BLOCKS, with every model's starting prediction."""
    plain = [c for c, kind in prepared.dtypes if c != FEATURES and kind in ("string", "int", "bigint", "double", "float", "boolean", "date")]
    rows = prepared.select(
        vector_to_array(FEATURES, "float64").alias("x"),
        number(label).alias("y"),
        F.xxhash64(*plain).alias("draw"),
        (F.col(fold) if fold else F.lit(ALL)).cast("int").alias("fold"),
    ).where(F.col("y").isNotNull())
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(at, BLOCK_ROWS)
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                codes = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)
                y, draw, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                margin = np.repeat(np.array(start, float)[:, None], b.num_rows, axis=1)
                row = (codes, y.astype(float), draw.astype(np.int64), fold.astype(np.int32), margin)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], names=BLOCKS.names)

    return rows.mapInArrow(run, BLOCKS)


def arrays(batch: pa.RecordBatch, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    for codes, y, draw, fold, margin in zip(*(c.to_pylist() for c in batch.columns)):
        y = np.frombuffer(y)
        yield (
            np.frombuffer(codes, np.uint8).reshape(-1, len(y)), y, np.frombuffer(draw, np.uint64),
            np.frombuffer(fold, np.int32), np.frombuffer(margin).reshape(models, len(y)),
        )


def drawn(draw: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Rows of a round's sample, by a hash of their own."""
    with np.errstate(over="ignore"):
        x = (draw ^ np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)) < np.uint64(share * 2**53)


def drawn_columns(features: int, share: float, model: int, round_: int, seed: int) -> np.ndarray:
    n = max(1, int(share * features))
    return np.sort(np.random.default_rng([seed, round_, model]).permutation(features)[:n])


def margins(codes: np.ndarray, margin: np.ndarray, since: list[list[Tree]]) -> np.ndarray:
    """The predictions with the trees of some rounds added."""
    for trees in since:
        margin = margin + np.stack([t.values_of(codes) for t in trees])
    return margin


def level_sums(
    state: DataFrame, since: list[list[Tree]], trees: list[Tree], level: int, columns: list[np.ndarray], unit: float, round_: int, s: Settings
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each model: cells (node of the level, feature, bin), and the sums of gradients and hessians there.

    The gradient of half the squared error is prediction less label, its hessian one.
    """
    first, nodes = 2**level - 1, 2**level
    stride = [nodes * (int(c[-1]) + 1) * s.bins for c in columns]
    offset = np.cumsum([0, *stride])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, int(offset[-1])), np.int64) if offset[-1] <= TASK_CELLS else None
        for batch in batches:
            for codes, y, draw, fold, margin in arrays(batch, len(trees)):
                margin = margins(codes, margin, since)
                sample = drawn(draw, round_, s.seed, s.row_share) if s.row_share < 1 else np.ones(len(y), bool)
                cells, g, h = [], [], []
                for m, tree in enumerate(trees):
                    slot = tree.nodes_of(codes) - first
                    here = np.flatnonzero(sample & (fold != m) & (slot >= 0) & (slot < nodes))
                    grad = np.rint((margin[m, here] - y[here]) / unit)
                    base = slot[here] * s.bins
                    for f in columns[m]:
                        place = base + codes[f].take(here)
                        count = np.bincount(place, minlength=nodes * s.bins)
                        found = np.flatnonzero(count)
                        node, b = np.divmod(found, s.bins)
                        cells.append(offset[m] + (node * (columns[m][-1] + 1) + f) * s.bins + b)
                        h.append(count[found])
                        g.append(np.bincount(place, grad, nodes * s.bins)[found].astype(np.int64))
                cells, g, h = (np.concatenate(v) for v in (cells, g, h))
                if total is not None:
                    total[:, cells] += [g, h]  # a block has a cell once
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cells, g, h)], names=["cell", "g", "h"])
        if total is not None:
            found = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (found, *total[:, found])], names=["cell", "g", "h"])

    sums = state.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    table = sums.toArrow().sort_by("cell")  # nodes x features x bins at most
    cells, g, h = (table.column(c).to_numpy() for c in ("cell", "g", "h"))
    at = np.searchsorted(cells, offset)
    return [(cells[a:b] - offset[m], g[a:b] * unit, h[a:b]) for m, (a, b) in enumerate(zip(at, at[1:]))]


def grow(tree: Tree, level: int, cells: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> None:
    """Split the nodes of a level that gain by it, and set the weights of what they are split into.

    Of equal gains the first feature's lowest bin is taken.
    """
    features = int(columns[-1]) + 1
    node, rest = np.divmod(cells, features * s.bins)
    f, b = np.divmod(rest, s.bins)

    def weigh(i: int, g: float, h: float) -> None:
        tree.cover[i], tree.value[i] = h, -s.rate * g / (h + s.penalty)

    for n in np.unique(node):
        i = 2**level - 1 + int(n)
        here = node == n
        hist = np.zeros((2, features, s.bins))
        hist[0, f[here], b[here]], hist[1, f[here], b[here]] = g[here], h[here]
        hist = hist[:, columns]
        total_g, total_h = hist[:, 0].sum(axis=1)
        if not level:
            weigh(0, total_g, total_h)
        low_g, low_h = hist.cumsum(axis=2)[:, :, :-1]
        high_g, high_h = total_g - low_g, total_h - low_h
        gain = low_g**2 / (low_h + s.penalty) + high_g**2 / (high_h + s.penalty) - total_g**2 / (total_h + s.penalty)
        gain[(low_h < s.least_weight) | (high_h < s.least_weight)] = 0.0
        best = int(np.argmax(gain))
        if gain.flat[best] > LEAST_GAIN:
            at = divmod(best, gain.shape[1])
            tree.feature[i], tree.bin[i], tree.gain[i] = columns[at[0]], at[1], gain.flat[best]
            weigh(2 * i + 1, low_g[at], low_h[at])
            weigh(2 * i + 2, high_g[at], high_h[at])


def advanced(state: DataFrame, since: list[list[Tree]]) -> DataFrame:
    """The blocks with the trees of some rounds added to the predictions."""
    models = len(since[0]) if since else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [margins(codes, margin, since).tobytes() for codes, _, _, _, margin in arrays(batch, models)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], names=BLOCKS.names)

    return state.mapInArrow(run, BLOCKS) if since else state


@dataclass
class Boosted:
    """Fitted models, one for each left-out fold (or one of all rows), and the blocks with their predictions before
    the rounds ``since``."""

    edges: list[list[float]]
    start: list[float]
    trees: list[list[Tree]]
    state: DataFrame
    since: list[list[Tree]]

    def flat(self, model: int = 0) -> FlatTrees:
        """Nodes that are in use, tree by tree, with thresholds on the features' values."""
        parts, roots, n = [], [], 0
        for t in self.trees[model]:
            used, todo = [], [0]
            while todo:
                i = todo.pop()
                used.append(i)
                if t.feature[i] >= 0:
                    todo += [2 * i + 2, 2 * i + 1]
            place = {node: n + k for k, node in enumerate(used)}
            for node in used:
                f = int(t.feature[node])
                split = (place[2 * node + 1], place[2 * node + 2], self.edges[f][t.bin[node]]) if f >= 0 else (-1, -1, 0.0)
                parts.append((f, split[2], split[0], split[1], 0.0 if f >= 0 else t.value[node], t.cover[node]))
            roots.append(n)
            n += len(used)
        columns = [np.array(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 6
        kinds = (int, float, int, int, float, float)
        return FlatTrees(*(c.astype(k) for c, k in zip(columns, kinds)), np.array(roots, int), self.start[model])

    def gains(self, model: int = 0) -> np.ndarray:
        """Total gain by feature, as shares."""
        total = np.zeros(len(self.edges))
        for t in self.trees[model]:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return total / (total.sum() or 1.0)


def boost(prepared: DataFrame, label: str, s: Settings, fold: str | None = None, folds: int = 0) -> Boosted:
    """Boosted trees on the ``features`` vector; with ``fold`` one model for each of ``folds``, fitted on the others.

    Rows without a label are not used.  ``state`` stays persisted for the caller to read and release.
    """
    if not 2 <= s.bins <= 256:
        raise ValueError("bins are codes of one byte: 2 to 256")
    y = number(label)
    models = max(1, folds)
    part = [F.when(F.col(fold) != m, y) if folds else y for m in range(models)]
    n, low, high, *start = prepared.where(y.isNotNull()).agg(F.count(y), F.min(y), F.max(y), *[F.avg(p) for p in part]).first()
    if not n or any(v is None for v in start):
        raise ValueError("no rows to learn from")
    features = prepared.select(FEATURES).first()[0].size
    edges = bin_edges(prepared.where(y.isNotNull()), features, s.bins)
    # residuals are within a few spans of the label; sums of all rows stay within 62 bits, those of a block are exact
    span = 8.0 * (high - low) or 1.0
    unit = 2.0 ** math.ceil(math.log2(span * max(2.0**-34, n / 2.0**61)))
    start = [round(v / unit) * unit for v in start]
    tasks = max(prepared.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    state = blocked(prepared, label, edges, fold, start).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    found: list[list[Tree]] = []
    since: list[list[Tree]] = []
    for r in range(s.rounds):
        trees = [Tree(s.depth) for _ in range(models)]
        columns = [drawn_columns(features, s.column_share, m, r, s.seed) for m in range(models)]
        for level in range(s.depth):
            if level and not any((t.feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0).any() for t in trees):
                break
            for m, sums in enumerate(level_sums(state, since, trees, level, columns, unit, r, s)):
                grow(trees[m], level, *sums, columns[m], s)
        found.append(trees)
        since.append(trees)
        if len(since) == CHECKPOINT_ROUNDS:
            old, since, state = state, [], cut_lineage(advanced(state, since)).persist(StorageLevel.MEMORY_AND_DISK)
            old.unpersist()
    return Boosted(edges, start, [list(t) for t in zip(*found)], state, since)


def held_out_scores(fitted: Boosted) -> DataFrame:
    """(fold, n, rmse, r2) of every model on the rows it was not fitted on, from the predictions it left there."""
    models = len(fitted.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y, _, fold, margin in arrays(batch, models):
                own = np.flatnonzero(fold >= 0)
                columns = [pa.array(fold[own]), pa.array(y[own]), pa.array(margin[fold[own], own])]
                yield pa.RecordBatch.from_arrays(columns, names=["fold", "y", "p"])

    return regression_metrics(advanced(fitted.state, fitted.since).mapInArrow(run, "fold int, y double, p double"), "y", "p", ["fold"]).drop("mae")


def cross_validate_boosted(df: DataFrame, features: FeatureSpec, label: str, fold: str, k: int, s: Settings) -> DataFrame:
    """(fold, n, rmse, r2): all k models grown in the same passes over rows that are prepared and binned once.

    Trees do not depend on scaling; the bins are those of all rows.
    """
    rows = prepare(fit_preparation(df, features), df)
    fitted = boost(rows, label, s, fold, k)
    try:
        return computed(held_out_scores(fitted))
    finally:
        fitted.state.unpersist()


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a leaf's weight that counts", TypeConverters.toFloat)
    rowShare = Param(Params._dummy(), "rowShare", "share of the rows drawn for a tree", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "share of the features drawn for a tree", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "added to a leaf's hessian", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)

    def settings(self) -> Settings:
        get = self.getOrDefault
        return Settings(get("rounds"), get("depth"), get("rate"), get("rowShare"), get("columnShare"), get("penalty"), bins=get("bins"), seed=get("seed"))


class BoostedTrees(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """The boosting of this module as an estimator of the ``features`` vector."""

    @keyword_only
    def __init__(self, *, labelCol="label", rounds=600, depth=6, rate=0.05, rowShare=0.9, columnShare=0.9, penalty=1.0, bins=256, seed=SEED):
        super().__init__()
        self._setDefault(rounds=600, depth=6, rate=0.05, rowShare=0.9, columnShare=0.9, penalty=1.0, bins=256, seed=SEED, featuresCol=FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, prepared: DataFrame) -> BoostedTreesModel:
        fitted = boost(prepared, self.getLabelCol(), self.settings())
        fitted.state.unpersist()
        return BoostedTreesModel.of(fitted)


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    trees = Param(Params._dummy(), "trees", "nodes and gains as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol=FEATURES)

    @staticmethod
    def of(fitted: Boosted) -> BoostedTreesModel:
        t = fitted.flat()
        parts = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(t).items()}
        return BoostedTreesModel()._set(trees=json.dumps({"nodes": parts, "gains": fitted.gains().tolist()}))

    def flat_trees(self) -> FlatTrees:
        parts = json.loads(self.getOrDefault("trees"))["nodes"]
        kinds = {"feature": int, "left": int, "right": int, "roots": int}
        return FlatTrees(**{k: np.array(v, kinds.get(k, float)) if isinstance(v, list) else v for k, v in parts.items()})

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(json.loads(self.getOrDefault("trees"))["gains"])

    def _transform(self, df: DataFrame) -> DataFrame:
        shipped = df.sparkSession.sparkContext.broadcast(self.flat_trees())

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            return pd.Series(shipped.value.predict(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))
