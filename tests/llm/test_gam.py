import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import gam

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = gam.scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 40
    assert (got.predicted == got.quality).mean() > 0.95


def test_tables_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, len(gam.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.fit(x, y, rounds=60, n_pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_step_is_the_best_single_cut():
    r = np.random.default_rng(1)
    for _ in range(30):
        g, w = r.normal(size=9), r.uniform(0.5, 2, 9)
        got = gam.step(g, w, 2, 0.0)
        best = max(range(1, 9), key=lambda c: g[:c].sum() ** 2 / w[:c].sum() + g[c:].sum() ** 2 / w[c:].sum())
        want = np.where(np.arange(9) < best, g[:best].sum() / w[:best].sum(), g[best:].sum() / w[best:].sum())
        assert np.allclose(got, want)


def test_odd_rows_and_columns(spark, odd, clashing):
    labels = spark.createDataFrame([(4, 1), (8, 0), (9, 0), (20, 1), (20, 1), (21, None), (None, 1), (22, 7), (40, 1), (41, 1)], "doc_id long, quality int")
    got = gam.scores(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, gam.scores(clashing, labels).collect()))
    kept = gam.good_documents(clashing, labels)
    assert kept.columns == clashing.columns
    good = sorted(str(r.doc_id) for r in got if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == good


def test_labels_of_held_out_rows_are_not_read(spark, odd):
    rows = [(r.doc_id, int(r.doc_id % 2)) for r in odd.where("doc_id is not null").select("doc_id").distinct().collect()]
    one = spark.createDataFrame(rows, "doc_id long, quality int")
    flipped = one.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(repr, gam.scores(odd, x).collect())) for x in (one, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, 1)]])
def test_no_rows(spark, nothing, odd, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    assert gam.scores(nothing, labels).count() == 0
    assert gam.scores(odd, labels).count() == odd.count()
