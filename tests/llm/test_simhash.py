import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rosterlens.llm import simhash
from rosterlens.llm.components import components
from rosterlens.llm.storage import written

from .conftest import EXTRA, LOW


def brute_fingerprint(text):
    words = [w for w in (text or "").translate(LOW).encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(odd):
    for t in {r.text for r in odd.collect()}:
        if t is None or len(t) < 5000:
            assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


def test_components_of_random_graphs(spark):
    r = random.Random(8)
    for n, m in ((40, 30), (60, 200), (1, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(30)] if n == 40 else [])
        frame = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
        got = {x.node: x.root for x in components(frame).collect()}
        want = roots(n + 1, links)
        assert all(want[k] == v for k, v in got.items())
        assert set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_links_connect_what_is_near(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(30)]
    words = {w ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for w in base * 6} | set(base)
    words |= {(base[0] & ~0xFFFFFFFF) | r.getrandbits(32) for _ in range(40)}  # a segment that many share
    words = sorted(words)
    frame = spark.createDataFrame([(simhash.signed(w),) for w in words], "fp long")
    at = {simhash.signed(w): i for i, w in enumerate(words)}
    for bits, segments, size in ((2, 2, 256), (2, 2, 0), (2, 2, 5), (3, 2, 256), (3, 2, 0), (1, 4, 3), (0, 2, 256), (2, 4, 256)):
        near = [(i, j) for i in range(len(words)) for j in range(i) if (words[i] ^ words[j]).bit_count() <= bits]
        got = [(at[x.a], at[x.b]) for x in simhash.links(frame, bits, segments, size).collect()]
        assert set(map(frozenset, got)) <= set(map(frozenset, near))
        assert roots(len(words), got) == roots(len(words), near), (bits, segments, size)


def test_query_rows(odd, clashing):
    rows = odd.select("doc_id", "text").collect()
    fps = [brute_fingerprint(t) if t is None or len(t) < 5000 else simhash.fingerprint(t) % (1 << 64) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for k, (i, _) in zip(root, rows):
        least[k] = min(x for x in (least.get(k), i, 1 << 60) if x is not None)
    want = [(i, f"{f:016x}", None if least[k] == 1 << 60 else least[k]) for (i, _), f, k in zip(rows, fps, root)]
    for frame in (odd, clashing):
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in simhash.near_duplicates(frame).collect())
    keep = {}
    for (i, f, c), k in zip(want, root):
        if i == c:
            keep[k] = (i, f)
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(x) for x, _ in keep.values()) == sorted(str(r.doc_id) for r in kept.collect())
    assert kept.where(F.col(EXTRA[0]) != "mine").count() == 0


def test_no_rows(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def test_native_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("ab cd ef"))).first()[0]
    assert got == np.uint64(xxhash.xxh64_intdigest("ab cd ef", 42)).astype(np.int64)


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    """An explode is not counted in Spark's sizes: probes of 34 rows a fingerprint passed for a small table."""
    r = random.Random(10)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(9)) if i % 5 else "these are copies of one text") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(simhash, "written", seen)
    for size in (256, 0):
        fps = written(simhash.with_fingerprints(frame).select("fp").distinct())
        seen(simhash.links(fps, bucket_rows=size))
    seen(simhash.near_duplicates(frame))
    seen(simhash.one_of_each(frame))
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "Broadcast" in p]
