import math

import numpy as np
from pyspark.sql import functions as F

from rosterlens.llm import topk


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != q and len(w) == len(v))[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = topk.quantized(frame)
    return sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), **more).collect()))


def test_ties_nulls_and_repeats(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=6) * (1 if i % 7 else 40)], 1) for i in range(300)]
    rows += [(i, [0.5] * 6, 1) for i in range(1000, 1080)]  # one very common vector
    rows += [rows[20], (40, [9.0] * 6, 2), (None, [1.0] * 6, 1), (60, None, 1), (61, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(62, [float("nan")] * 6, 1), (63, [float("inf")] * 6, 1), (80, [1.0, 2.0], 1), (81, [1.0, -2.0], 1), (2000, [], 1)]
    want = brute([(i, v) for i, v, _ in rows])
    got = run(spark, rows)
    assert sorted(x for x in got if x[0] != 2000) == sorted(x for x in want if x[0] != 2000)
    assert got == run(spark, rows, block_rows=5)


def test_fewer_than_k_and_no_rows(spark):
    rows = [(i, [float(i), 1.0], 0) for i in (0, 1, 2, 20)]
    assert run(spark, rows) == brute([(i, v) for i, v, _ in rows])
    assert run(spark, []) == []


def test_large_vectors_leave_all_scores_exact(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=5)], 1) for i in range(130)]
    big = [[3e13, 1.0, 1.0, 1.0, 1.0], [-3e13, 2.0, 0.0, 1.0, 1.0], [1e7] * 5, [-1e7] * 5, [3e15, 1.0, 1.0, 1.0, 1.0], [3e38] * 5, [-3e38, 1.0, 0.0, 0.0, 0.0]]
    rows += [(i, [float(np.float32(x)) for x in v], 1) for i, v in zip((200, 201, 220, 221, 240, 241, 242), big)]
    low, high = topk.LONG
    want = [(q, n, j, min(max(s, low), high)) for q, n, j, s in brute([(i, v) for i, v, _ in rows])]
    assert any(abs(s) == high for *_, s in want) and any(2**53 < abs(s) < 2**62 for *_, s in want)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "RARE_ROWS", 2)
    assert run(spark, rows, block_rows=3) == want


def test_columns_of_other_names(spark):
    rows = [(i, [float(i % 7), 1.0], 0) for i in range(50)]
    want = run(spark, rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = topk.quantized(frame).withColumns({c: F.lit("mine") for c in ("n", "norm", "q", "score", "rank", "query_id", "usual")})
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0")).collect())) == want
