"""Fitted trees as flat tables: predictions and Shapley values for many rows at a time.

A node is a row of a few arrays.  Prediction walks all trees at once.  Shapley values walk down and up each tree by
level.  The weight of a subset of size s out of m - 1 is the integral of t^s (1 - t)^(m-1-s) over [0, 1], so the sum over
all subsets is the integral of a product with one factor (1 - t) z + t o for each feature of the path: z is the
share of training rows that its splits let through, o is 1 if the row passes them.  Gauss-Legendre nodes integrate that
polynomial exactly.  Every factor is positive and none is ever divided by a share alone, so long paths lose no digits.

What a leaf adds depends only on which features of its path a row passes.  Trees of few features a path (``LeafTables``) have
those sums written out by leaf and pattern, and a row looks them up; the others walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.small_tables import shared_dir

#: Tree nodes that are read at a time, unless one tree has more.
BLOCK_NODES = 200_000
#: Doubles that one step of the Shapley recursion may hold, and all tables by leaf and pattern.
STEP_DOUBLES = 4 << 20
#: Rows that look their values up at a time.
LOOKUP_ROWS = 4096


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of some trees: a row goes left if its ``feature`` is at most ``threshold``; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # training rows (or their weight) that reach the node
    roots: np.ndarray
    base: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Base plus the sum of the leaves' values, for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.base + self.value[at].sum(axis=1)
            low = x[rows, f] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def expected(self) -> float:
        """Mean prediction over the training rows, tree by tree."""
        total = self.base
        for tree in self.layers():
            leaf = self.feature[tree.nodes] < 0
            nodes = tree.nodes[leaf]
            total += float(np.sum(self.value[nodes] * self.cover[nodes]) / self.cover[tree.nodes[0]])
        return total

    def layers(self) -> Iterator[Layers]:
        for root in self.roots:
            yield Layers.of(self, int(root))

    def explainers(self) -> list[LeafTables | Layers]:
        """For each tree of more than a leaf its tables while there is room for them, else its levels."""
        found, room = [], STEP_DOUBLES
        for root in self.roots:
            if self.feature[root] >= 0:
                tables = LeafTables.of(self, int(root), room)
                room -= tables.size if tables else 0
                found.append(tables or Layers.of(self, int(root)))
        return found

    def shapley(self, x: np.ndarray, explainers: list[LeafTables | Layers] | None = None) -> np.ndarray:
        """Values per row and feature; a row's sum is its prediction less the expectation."""
        phi = np.zeros_like(x, dtype=float)
        for tree in self.explainers() if explainers is None else explainers:
            step = tree.rows_at_once()
            for i in range(0, len(x), step):
                tree.add_shapley(self, x[i : i + step], phi[i : i + step])
        return phi


@dataclass
class LeafTables:
    """What each leaf adds to the values of its path's features, by the features that a row passes (a bit each)."""

    root: int
    place: np.ndarray  # by node: the bit of the feature that it splits by, -1 at leaves
    new: np.ndarray  # by node: no node above splits by that feature
    features: dict[int, list[int]]  # by leaf
    values: dict[int, np.ndarray]  # by leaf: (feature, pattern)
    size: int

    @classmethod
    def of(cls, t: FlatTrees, root: int, most: int) -> LeafTables | None:
        """The tables of a tree; None if they have more than ``most`` numbers."""
        place, new, paths, size = np.full(len(t.feature), -1), np.zeros(len(t.feature), bool), {}, 0
        todo = [(root, {})]  # the path's features in order, with the share of rows that their splits let through
        while todo:
            node, path = todo.pop()
            f = int(t.feature[node])
            if f < 0:
                paths[node] = path
                size += len(path) << len(path)
                if size > most:
                    return None
                continue
            new[node] = f not in path
            place[node] = len(path) if new[node] else list(path).index(f)
            for child in (int(t.left[node]), int(t.right[node])):
                todo.append((child, path | {f: path.get(f, 1.0) * t.cover[child] / t.cover[node]}))
        values = {leaf: t.value[leaf] * _by_pattern(np.array(list(path.values()))) for leaf, path in paths.items()}
        return cls(root, place, new, {leaf: list(path) for leaf, path in paths.items()}, values, size)

    def rows_at_once(self) -> int:
        return LOOKUP_ROWS

    def add_shapley(self, t: FlatTrees, x: np.ndarray, phi: np.ndarray) -> None:
        columns = np.ascontiguousarray(x.T)
        total = np.zeros(columns.shape)
        todo = [(self.root, np.zeros(len(x), np.intp))]
        while todo:
            node, passed = todo.pop()
            f, bit = t.feature[node], self.place[node]
            if f < 0:
                for of, values in zip(self.features[node], self.values[node]):
                    total[of] += values[passed]
                continue
            left = (columns[f] <= t.threshold[node]).astype(np.intp) << bit
            right = left ^ (1 << bit)
            if self.new[node]:
                todo += [(t.left[node], passed | left), (t.right[node], passed | right)]
            else:
                others = ~(1 << bit)
                todo += [(t.left[node], passed & (left | others)), (t.right[node], passed & (right | others))]
        phi += total.T


def _by_pattern(z: np.ndarray) -> np.ndarray:
    """Values of a leaf of weight one for each feature and pattern, from the shares that the features let through."""
    m = len(z)
    t, w = np.polynomial.legendre.leggauss(-(-m // 2))
    t, w = (t + 1) / 2, w / 2
    o = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    factors = (1 - t)[:, None, None] * z + t[:, None, None] * o
    rest = [np.delete(factors, j, axis=2).prod(axis=2) for j in range(m)]
    return np.stack([(o[:, j] - z[j]) * (w @ rest[j]) for j in range(m)])


@dataclass
class Layers:
    """One tree by level.  The children of a level's inner nodes are the next level, in pairs."""

    nodes: np.ndarray  # all nodes, level by level
    starts: list[int]  # where each level begins
    parent: np.ndarray  # places in ``nodes``
    before: np.ndarray  # place of the nearest node above that was split off by the same feature, 0 if none
    split: np.ndarray  # the feature that a node was split off by
    share: np.ndarray  # training rows that this feature's splits let through, down to the node
    points: int

    @classmethod
    def of(cls, t: FlatTrees, root: int) -> Layers:
        levels, parents = [np.array([root])], [np.zeros(1, int)]
        start, starts = 0, [0]
        while True:
            inner = np.flatnonzero(t.feature[levels[-1]] >= 0)
            if not len(inner):
                break
            up = levels[-1][inner]
            levels.append(np.stack([t.left[up], t.right[up]], axis=1).ravel())
            parents.append(np.repeat(inner + start, 2))
            start += len(levels[-2])
            starts.append(start)
        nodes, parent = np.concatenate(levels), np.concatenate(parents)
        starts.append(len(nodes))
        split = t.feature[nodes[parent]]
        split[0] = -1
        before = np.zeros(len(nodes), int)
        share, many = np.ones(len(nodes)), np.zeros(len(nodes), int)
        for a, b in zip(starts[1:-1], starts[2:]):
            here, up = np.arange(a, b), parent[a:b]
            seek, found = up.copy(), np.zeros(b - a, int)
            while True:  # up the path, all nodes of the level at once
                open_ = (seek > 0) & (found == 0)
                if not open_.any():
                    break
                hit = open_ & (split[seek] == split[here])
                found[hit] = seek[hit]
                seek = parent[seek]
            before[here] = found
            share[here] = share[found] * t.cover[nodes[here]] / t.cover[nodes[up]]
            many[here] = many[up] + (found == 0)
        return cls(nodes, starts, parent, before, split, share, max(1, -(-int(many.max()) // 2)))

    def rows_at_once(self) -> int:
        return max(1, STEP_DOUBLES // (len(self.nodes) * self.points))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By node and case: what the path's product is multiplied with, and what the feature's term grows by.

        Cases: the row left the feature's path above, at this node, or not at all.
        """
        t, w = np.polynomial.legendre.leggauss(self.points)
        t, w = (t + 1) / 2, w / 2
        z, above = self.share[:, None], self.share[self.before][:, None]
        out, inside = (1 - t) * z, (1 - t) * z + t
        out_above, in_above = (1 - t) * above, (1 - t) * above + t
        term = lambda o, z, f: (o - z) / f
        factor = np.stack([out / out_above, out / in_above, inside / in_above], axis=1)
        grows = np.stack(
            [
                term(0, z, out) - term(0, above, out_above),
                term(0, z, out) - term(1, above, in_above),
                term(1, z, inside) - term(1, above, in_above),
            ],
            axis=1,
        )
        return factor, grows * w

    def add_shapley(self, t: FlatTrees, x: np.ndarray, phi: np.ndarray) -> None:
        factor, grows = self.tables()
        n, features = x.shape
        passed = np.ones((n, len(self.nodes)), bool)
        case = np.empty((n, len(self.nodes)), np.int8)
        products = [np.ones((n, 1, self.points))]
        levels = list(zip(self.starts[:-1], self.starts[1:]))
        for (a, b), (up, _) in zip(levels[1:], levels):
            split, parent = self.split[a:b], self.parent[a:b]
            goes_left = x[:, split] <= t.threshold[self.nodes[parent]]
            goes_left[:, 1::2] ^= True
            above = passed[:, self.before[a:b]]
            passed[:, a:b] = above & goes_left
            case[:, a:b] = above.astype(np.int8) + passed[:, a:b]
            products.append(products[-1][:, parent - up] * factor[np.arange(a, b), case[:, a:b]])
        below = None
        for (a, b), product in zip(reversed(levels), reversed(products)):
            leaf = t.feature[self.nodes[a:b]] < 0
            sums = product * np.where(leaf, t.value[self.nodes[a:b]], 0.0)[:, None]
            if below is not None:
                sums[:, ~leaf] = below[:, 0::2] + below[:, 1::2]
            if a:
                gain = np.einsum("nvq,nvq->nv", sums, grows[np.arange(a, b), case[:, a:b]])
                place = np.arange(n)[:, None] * features + self.split[a:b]
                phi += np.bincount(place.ravel(), gain.ravel(), n * features).reshape(n, features)
            below = sums


def saved_trees(model, block_nodes: int = BLOCK_NODES) -> Iterator[FlatTrees]:
    """The trees of a fitted MLlib forest or boosted model, some at a time, from the node table of its saved form.

    Values are weighted as the model weights its trees, so that predictions of the blocks add up.
    """
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark).rstrip('/')}/trees-{model.uid}"
    model.write().overwrite().save(path)
    weights = np.array(model.treeWeights)
    if hasattr(model, "trees") and "Forest" in type(model).__name__:
        weights = weights / weights.sum()
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        "nodeData.id",
        F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.rawCount").cast("double").alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.numCategories").alias("categories"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.array_contains("nodeData.split.leftCategoriesOrThreshold", 0.0).alias("zero_left"),
    )
    sizes = dict(nodes.groupBy("tree").count().collect())  # a row a tree
    first = 0
    while first < len(weights):
        last, size = first + 1, sizes[first]
        while last < len(weights) and size + sizes[last] <= block_nodes:
            size += sizes[last]
            last += 1
        some = nodes.where(F.col("tree").between(first, last - 1)).toPandas().sort_values(["tree", "id"])
        yield _flat(some, weights)
        first = last


def blocks_of(model, block_nodes: int = BLOCK_NODES) -> Iterator[FlatTrees]:
    """The trees of a fitted model of this library or of MLlib, some at a time."""
    own = getattr(model, "flat_trees", None)
    return iter([own()]) if own else saved_trees(model, block_nodes)


def joined(blocks: list[FlatTrees]) -> FlatTrees:
    """Several blocks as one; their predictions add up."""
    offset = np.cumsum([0, *(len(b.feature) for b in blocks)])

    def moved(name: str) -> np.ndarray:
        return np.concatenate([np.where(getattr(b, name) >= 0, getattr(b, name) + o, -1) for b, o in zip(blocks, offset)])

    same = {c: np.concatenate([getattr(b, c) for b in blocks]) for c in ("feature", "threshold", "value", "cover")}
    return FlatTrees(**same, left=moved("left"), right=moved("right"), roots=moved("roots"), base=sum(b.base for b in blocks))


def _flat(nodes, weights: np.ndarray) -> FlatTrees:
    tree, inner = nodes["tree"].to_numpy(), nodes["left"].to_numpy() >= 0
    roots = np.flatnonzero(nodes["id"].to_numpy() == 0)
    offset = np.repeat(roots, np.diff(np.append(roots, len(nodes))))
    categories = nodes["categories"].fillna(-1).to_numpy()
    if (inner & (categories >= 0) & (categories != 2)).any():
        raise ValueError("only numeric and 0/1 features are expected in a prepared vector")
    indicator = categories == 2  # cut at one half
    swap = indicator & ~nodes["zero_left"].eq(True).to_numpy()
    left, right = (np.where(inner, offset + nodes[c].to_numpy(), -1) for c in ("left", "right"))
    return FlatTrees(
        feature=np.where(inner, nodes["feature"].fillna(-1).to_numpy(), -1).astype(np.int64),
        threshold=np.where(indicator, 0.5, nodes["cut"].fillna(0.0).to_numpy(dtype=float)),
        left=np.where(swap, right, left),
        right=np.where(swap, left, right),
        value=nodes["value"].to_numpy() * weights[tree],
        cover=nodes["cover"].to_numpy(),
        roots=roots,
    )
