import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import newton as N
from rosterlens.operators import sums as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)) * [1, 5, 0.1, 1] + [0, 10, 3, 0]
    x[:, 3] = (x[:, 3] > 0).astype(float)
    slopes = np.array([[1, 0.1, 2, -1], [0, 0, 0, 0.5], [-3, 0, 0, 0], [0, 0, 0, 0]])
    y = (rng.uniform(size=(3000, 4)) < 1 / (1 + np.exp(-(x @ slopes.T - [5, 0, -2, 0])))).astype(float)
    y[:, 3] = 1.0  # one class
    used = rng.uniform(size=y.shape) < [0.8, 0.7, 1.0, 0.9]
    y = np.where(used, y, np.nan)
    rows = [(r.tolist(), [None if np.isnan(v) else float(v) for v in t]) for r, t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(5).persist()


def objective(x, y, b, std, standardised):
    """In features standardised on the rows themselves."""
    n, ones = len(y), y.sum()
    w = np.where(y > 0, n / (2 * ones), n / (2 * (n - ones)))
    m = b[0] + x @ b[1:]
    scale = np.ones(x.shape[1])
    scale[:standardised] = std[:standardised]
    return 0.5 * ((b[1:] * scale) ** 2).sum() + (w * (np.logaddexp(0, m) - y * m)).sum()


@pytest.mark.parametrize("standardised", [0, 3])
def test_all_targets_reach_their_optimum(table, standardised):
    x, y, frame = table
    moments = N.target_moments(frame, 4, 4)
    fits = N.fit_targets(frame, 4, moments, standardised)
    assert fits[3] is None
    for t in range(3):
        u = ~np.isnan(y[:, t])
        m = moments[t]
        assert (m.n, m.ones) == (u.sum(), y[u, t].sum())
        np.testing.assert_allclose(m.mean, x[u].mean(axis=0))
        np.testing.assert_allclose(m.std, x[u].std(axis=0), rtol=1e-9)
        b = np.concatenate([[fits[t].intercept], fits[t].coefficients])
        at = objective(x[u], y[u, t], b, m.std, standardised)
        assert at == pytest.approx(fits[t].objective)
        for i in range(5):
            for h in (1e-3, -1e-3):
                near = b.copy()
                near[i] += h
                assert objective(x[u], y[u, t], near, m.std, standardised) > at


def test_the_number_of_scans_does_not_grow_with_the_targets(table, monkeypatch):
    _, _, frame = table
    calls = []
    monkeypatch.setattr(N, "summed", lambda *a: calls.append(1) or S.summed(*a))
    moments = N.target_moments(frame, 4, 4)
    fits = N.fit_targets(frame, 4, moments)
    assert len(calls) == 1 + max(f.steps for f in fits if f) <= 12


def test_left_out_features_have_no_coefficient(table):
    x, y, frame = table
    moments = N.target_moments(frame, 4, 4)
    live = [np.array([True, False, True, True])] * 4
    fits = N.fit_targets(frame, 4, moments, 3, live=live)
    assert fits[0].coefficients[1] == 0.0 and fits[0].coefficients[0] != 0.0
    flat = frame.select(F.transform("x", lambda v: F.lit(2.0)).alias("x"), "y")
    same = N.fit_targets(flat, 4, N.target_moments(flat, 4, 4), 3)
    assert not same[0].coefficients.any() and same[0].intercept == pytest.approx(0.0, abs=1e-7)


def test_separable_rows_end(spark):
    rows = spark.createDataFrame(pd.DataFrame({"x": [[float(i)] for i in range(20)], "y": [[float(i > 9)] for i in range(20)]}))
    (fit,) = N.fit_targets(rows, 1, N.target_moments(rows, 1, 1), c=1e6)
    assert np.isfinite(fit.coefficients).all() and fit.coefficients[0] > 1


def test_sums():
    m = np.arange(9.0).reshape(3, 3)
    m = m + m.T
    assert (S.square(S.packed(m), 3) == m).all() and S.triangle(3) == 6
