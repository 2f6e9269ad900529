import math

import numpy as np
import pandas as pd
import pytest

from rosterlens.functions.student_t import beta_inc, chi2_tail_p, f_tail_p, two_sided_p
from rosterlens.operators import association as A


@pytest.mark.parametrize(
    "t, dof, p",
    [(2.228, 10, 0.05), (1.812, 10, 0.10), (3.169, 10, 0.01), (12.706, 1, 0.05), (1.984, 100, 0.05), (2.576, 1e6, 0.01)],
)
def test_t_table(t, dof, p):
    assert two_sided_p(t, dof) == pytest.approx(p, abs=2e-4)


def test_t_closed_forms():
    for t in (0.1, 1.0, 7.5):
        assert two_sided_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-12)
        assert two_sided_p(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert beta_inc(2, 3, 0) == 0 and beta_inc(2, 3, 1) == 1


def test_chi2_and_f_tables():
    assert chi2_tail_p(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert chi2_tail_p(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert chi2_tail_p(2.0, 2) == pytest.approx(math.exp(-1), rel=1e-12)
    assert f_tail_p(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert f_tail_p(2.978, 10, 10) == pytest.approx(0.05, abs=1e-4)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"g": ["Declining"] * 40 + ["improving"] * 70 + ["stable"] * 9 + ["one"], "y": np.r_[rng.normal(52, 9, 40), rng.normal(47, 4, 70), np.zeros(9), 3.0]}
    )
    return pdf, spark.createDataFrame(pdf).persist()


def test_welch(groups):
    pdf, df = groups
    hi, lo = pdf.y[pdf.g == "Declining"], pdf.y[pdf.g == "improving"]
    se = hi.var() / 40 + lo.var() / 70
    t = (hi.mean() - lo.mean()) / math.sqrt(se)
    dof = se**2 / ((hi.var() / 40) ** 2 / 39 + (lo.var() / 70) ** 2 / 69)
    got = A.welch_test(df, "g", "y", "declining", "Improving")
    assert got.t == pytest.approx(t) and got.dof == pytest.approx(dof)
    assert got.p_one_sided == pytest.approx(got.p_two_sided / 2)
    assert got.reject == (got.p_one_sided < 0.05) and got.decision == "Reject H0"
    back = A.welch_test(df, "g", "y", "improving", "declining", alpha=0.01)
    assert back.p_one_sided == pytest.approx(1 - got.p_one_sided) and back.decision == "Fail to reject H0"


def test_welch_p_against_simulation():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (20000, 8)), rng.normal(0, 3, (20000, 15))
    va, vb = a.var(1, ddof=1) / 8, b.var(1, ddof=1) / 15
    t = (a.mean(1) - b.mean(1)) / np.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / 7 + vb**2 / 14)
    p = np.array([two_sided_p(x, d) for x, d in zip(t[:4000], dof[:4000])])
    assert (p < 0.05).mean() == pytest.approx(0.05, abs=0.012)


def test_welch_with_too_small_groups(groups):
    _, df = groups
    assert A.welch_test(df, "g", "y", "one", "improving").p_one_sided is None
    assert A.welch_test(df, "g", "y", "absent", "improving").t is None


def v_by_hand(table, yates=False):
    o = np.asarray(table, float)
    n, (r, k) = o.sum(), o.shape
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / n
    gap = np.abs(o - e)
    if yates:
        gap = gap - np.minimum(0.5, gap)
    chi2 = (gap**2 / e).sum()
    phi2 = max(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
    d = min(r - (r - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1)
    return chi2, (math.sqrt(phi2 / d) if d > 0 else 0.0)


def from_table(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, line in enumerate(table) for j, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "x string, y string")


@pytest.mark.parametrize(
    "table, yates",
    [
        ([[12, 5], [3, 20]], True),
        ([[10, 0], [0, 12]], True),
        ([[5, 5], [5, 5]], True),
        ([[4, 0, 9, 2], [7, 3, 0, 5], [1, 8, 6, 0]], False),
        ([[4, 9, 2], [7, 3, 8]], False),
    ],
)
def test_cramers_v_by_hand(spark, table, yates):
    got = A.cramers_v(from_table(spark, table), [("x", "y")]).first()
    chi2, v = v_by_hand(table, yates)
    assert got.chi2 == pytest.approx(chi2, abs=1e-9) and got.v == pytest.approx(v, abs=1e-9)
    assert got.n == np.sum(table) and (got.r, got.k) == np.shape(table)


def test_cramers_v_of_one_level_and_missing(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y")], "x string, y string")
    got = A.cramers_v(df, [("x", "y")]).first()
    assert got.v == 0.0 and (got.r, got.k) == (1, 3)


def test_matrices_are_symmetric_and_bounded(soldiers):
    cols = ["rank", "morale", "low_morale", "brigade_level", "division_level", "nope"]
    m = A.association_matrix(soldiers, cols).toPandas().pivot(index="a", columns="b", values="v")
    assert m.shape == (5, 5) and np.allclose(m, m.T) and (np.diag(m) == 1).all()
    assert ((m >= 0) & (m <= 1 + 1e-9)).all().all()
    assert m.loc["brigade_level", "division_level"] > 0.95
    with pytest.raises(ValueError, match="not enough columns"):
        A.association_matrix(soldiers, ["rank", "nope"])
    pdf = soldiers.toPandas()
    nums = ["stress_score", "sleep_score", "soldier_readiness"]
    c = A.pearson_matrix(soldiers, nums).toPandas().pivot(index="a", columns="b", values="r")
    np.testing.assert_allclose(c.loc[nums, nums], pdf[nums].corr(), atol=1e-12)


def test_pearson_is_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, np.nan, 4, 7], "b": [2.0, np.nan, 3, 5, 1], "c": [1.0, 4, 2, 2, 9]})
    c = A.pearson_matrix(spark.createDataFrame(pdf), list("abc")).toPandas().pivot(index="a", columns="b", values="r")
    np.testing.assert_allclose(c, pdf.corr(), atol=1e-12)


def test_chi_square_and_anova(spark, groups):
    chi2, dof, p = A.chi_square_test(from_table(spark, [[4, 0, 9, 2], [7, 3, 0, 5], [1, 8, 6, 0]]), "x", "y")
    assert dof == 6 and p == pytest.approx(chi2_tail_p(chi2, 6))
    pdf, df = groups
    g = pdf.groupby("g")["y"]
    between = (g.size() * (g.mean() - pdf.y.mean()) ** 2).sum()
    within = ((pdf.y - g.transform("mean")) ** 2).sum()
    f, p = A.anova_test(df, "g", "y")
    assert f == pytest.approx((between / 3) / (within / (len(pdf) - 4))) and p < 1e-6
