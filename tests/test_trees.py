import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rosterlens.operators import features as P
from rosterlens.operators import models as M
from rosterlens.operators import trees as T


def grown(depth: int, features: int, rows: int, seed: int = 0) -> tuple[T.FlatTrees, np.ndarray]:
    """One tree of random splits at medians, and its rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, features))
    table = []

    def add(here: np.ndarray, level: int) -> int:
        i = len(table)
        table.append([-1, 0.0, -1, -1, rng.normal(), float(len(here))])
        f = int(rng.integers(features))
        cut = float(np.median(x[here, f]))
        low, high = here[x[here, f] <= cut], here[x[here, f] > cut]
        if level < depth and len(low) and len(high):
            table[i][:4] = [f, cut, add(low, level + 1), add(high, level + 1)]
        return i

    add(np.arange(rows), 0)
    feature, threshold, left, right, value, cover = map(np.array, zip(*table))
    return T.FlatTrees(feature.astype(int), threshold, left.astype(int), right.astype(int), value, cover, np.array([0])), x


def by_subsets(t: T.FlatTrees, x: np.ndarray) -> np.ndarray:
    """The definition: the expectation given a subset goes down both sides where the feature is not in it."""
    d = x.shape[1]

    def given(row, known, node):
        if t.feature[node] < 0:
            return t.value[node]
        f, a, b = t.feature[node], t.left[node], t.right[node]
        if f in known:
            return given(row, known, a if row[f] <= t.threshold[node] else b)
        return (given(row, known, a) * t.cover[a] + given(row, known, b) * t.cover[b]) / t.cover[node]

    phi = np.zeros(x.shape)
    for r, row in enumerate(x):
        at = {s: sum(given(row, s, root) for root in t.roots) for k in range(d + 1) for s in combinations(range(d), k)}
        for i in range(d):
            rest = [f for f in range(d) if f != i]
            for k in range(d):
                w = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                phi[r, i] += w * sum(at[tuple(sorted((*s, i)))] - at[s] for s in combinations(rest, k))
    return phi


@pytest.mark.parametrize(("depth", "features"), [(1, 2), (3, 1), (6, 5), (6, 3)])
def test_shapley_values_equal_the_definition(depth, features):
    t, x = grown(depth, features, 300)
    np.testing.assert_allclose(t.shapley(x[:8]), by_subsets(t, x[:8]), atol=1e-12)


def test_deep_trees_lose_no_digits(monkeypatch):
    t, x = grown(30, 17, 4000)
    got = t.shapley(x[:40])
    np.testing.assert_allclose(got.sum(axis=1) + t.expected(), t.predict(x[:40]), atol=1e-12)
    monkeypatch.setattr(T, "STEP_DOUBLES", 1)
    np.testing.assert_allclose(t.shapley(x[:5]), got[:5], atol=1e-14)


def test_a_tree_without_splits():
    t = T.FlatTrees(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.array([2.5]), np.array([9.0]), np.array([0]), 1.0)
    x = np.ones((3, 2))
    assert t.predict(x).tolist() == [3.5] * 3 and t.expected() == 3.5 and not t.shapley(x).any()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_saved_trees_predict_as_the_model(soldiers, kind):
    spec = P.FeatureSpec(("stress_score", "sleep_score", "fatigue"), ("rank", "morale"))
    learner = M.forest_learner("soldier_readiness", trees=5, depth=5) if kind == "forest" else M.boosted_learner("soldier_readiness", rounds=4, depth=3)
    prep, model = M.fit_regressor(soldiers.select("soldier_id", *spec.columns, "soldier_readiness"), spec, learner).stages
    rows = model.transform(P.prepare(prep, soldiers)).select(vector_to_array(F.col("features")).alias("x"), "prediction").collect()
    x = np.array([r.x for r in rows])
    blocks = list(T.saved_trees(model, block_nodes=30))
    assert len(blocks) > 1
    np.testing.assert_allclose(sum(b.predict(x) for b in blocks), [r.prediction for r in rows], atol=1e-12)
    if kind == "forest":
        used = sorted({int(f) for b in blocks for f in b.feature if f >= 0})
        got = sum(b.shapley(x[:2]) for b in blocks)
        want = sum(by_subsets(_renamed(b, used), x[:2][:, used]) for b in blocks)
        np.testing.assert_allclose(got[:, used], want, atol=1e-10)


def _renamed(t: T.FlatTrees, used: list[int]) -> T.FlatTrees:
    place = {f: i for i, f in enumerate(used)}
    return T.FlatTrees(np.array([place.get(int(f), -1) for f in t.feature]), t.threshold, t.left, t.right, t.value, t.cover, t.roots)


@pytest.mark.parametrize(("depth", "features"), [(1, 2), (3, 1), (6, 5), (7, 12)])
def test_tables_by_leaf_equal_the_recursion(depth, features):
    t, x = grown(depth, features, 300, seed=5)
    tables = t.explainers()
    assert [type(e) for e in tables] == [T.LeafTables]
    np.testing.assert_allclose(t.shapley(x, tables), t.shapley(x, list(t.layers())), atol=1e-12)


def test_trees_without_room_for_tables_walk(monkeypatch):
    t, x = grown(6, 5, 300)
    both = T.joined([t, t])
    monkeypatch.setattr(T, "STEP_DOUBLES", t.explainers()[0].size)
    assert [type(e) for e in both.explainers()] == [T.LeafTables, T.Layers]
    np.testing.assert_allclose(both.shapley(x[:20]), 2 * t.shapley(x[:20]), atol=1e-12)
