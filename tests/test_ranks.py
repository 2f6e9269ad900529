import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators.ranks import roc_aucs


def brute(y, p):
    y, p = np.array(y), np.array(p)
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean() if a.size and b.size else None


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for m, n, digits in (("a", 2000, 1), ("b", 1500, 8), ("c", 40, 2), ("hot", 3000, 8)):
        p = np.round(rng.uniform(size=n), digits)
        if m == "hot":
            p[:2000] = 0.25  # one score holds most rows
        out += [(m, int(v), float(s)) for v, s in zip(rng.uniform(size=n) < p, p)]
    return out + [("one", 1, 0.3), ("one", 1, 0.4), ("zero", 0, 0.0), ("zero", 0, -0.0)]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_areas_equal_all_pairs(spark, rows, batch):
    frame = spark.createDataFrame(rows, "m string, y int, p double").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.model: (r.n, r.auc) for r in roc_aucs(frame, "m", "y", "p").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for m in {r[0] for r in rows}:
        y, p = zip(*[(r[1], r[2]) for r in rows if r[0] == m])
        assert got[m][0] == len(y) and got[m][1] == (None if m in ("one", "zero") else pytest.approx(brute(y, p), abs=1e-12))


def test_gaps_and_nothing(spark, rows):
    frame = spark.createDataFrame(rows[:500], "m string, y int, p double")
    gaps = frame.union(frame.select("m", F.lit(None), "p")).union(frame.select("m", "y", F.lit(None)))
    assert roc_aucs(gaps, "m", "y", "p").collect() == roc_aucs(frame, "m", "y", "p").collect()
    assert roc_aucs(frame.limit(0), "m", "y", "p").collect() == []
