import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import lines
from rosterlens.llm.cuckoo import CuckooFilter

from .conftest import BLANKS, LOW


def brute(texts, least=10):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(BLANKS).translate(LOW)
    count = Counter(k for x in split for k in {key(line) for line in x})
    out = []
    for x in split:
        kept = [line for line in x if not (key(line) and count[key(line)] >= least)]
        out.append((len(x), len(x) - len(kept), "\n".join(kept)))
    return out


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    made = CuckooFilter.of(keys)
    assert made.contains(keys).all()
    assert CuckooFilter.from_bytes(made.to_bytes()).contains(r.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01
    made.delete(keys[2500:])
    assert not made.table.any()
    with pytest.raises(KeyError):
        made.delete(keys[:1])
    assert not CuckooFilter(4).insert(keys)


def test_query_rows(odd, clashing):
    rows = odd.select("doc_id", "text").collect()
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, d, k) in zip(rows, brute([t for _, t in rows]))]
    assert sum(d for _, _, d, _ in want) > 20
    for frame in (odd, clashing):
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in lines.digests(frame).collect())


def test_lines_beyond_the_filters_are_decided_by_the_counts(odd, monkeypatch):
    want = sorted(map(repr, lines.digests(odd).collect()))
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    assert want == sorted(map(repr, lines.digests(odd).collect()))


def test_documents_can_be_taken_out(odd):
    docs = odd.where("doc_id is not null")
    some, rest = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    direct = lines.empty_index(docs, 5, shards=4).insert(rest)
    back = lines.empty_index(docs, 5, shards=4).insert(some).insert(rest).delete(some)
    for name in ("counts", "filters"):
        table = [getattr(x, name) for x in (direct, back)]
        if name == "counts":
            assert sorted(map(repr, table[0].collect())) == sorted(map(repr, table[1].collect()))
    a, b = (sorted(map(repr, x.clean(docs).collect())) for x in (direct, back))
    assert a == b
    with pytest.raises(Exception, match="not in the index"):
        direct.delete(some).counts.collect()


def test_stage_keeps_rows_and_columns(clashing):
    done = lines.clean_documents(clashing)
    assert done.columns == clashing.columns and done.count() == clashing.count()
    texts = [r.text for r in clashing.select("text").collect()]
    want = sorted(repr(t if not d else k) for t, (_, d, k) in zip(texts, brute(texts)))
    assert want == sorted(repr(r.text) for r in done.collect())
    assert done.where(F.col("doc_id").between(20, 33) & (F.col("n_chars") != F.length("text"))).count() == 0


def test_longer_keys_and_no_rows(odd, nothing):
    assert lines.drop_frequent_lines(odd, 2, 2000).agg(F.sum("n_dropped")).first()[0] == 0
    assert lines.digests(nothing).count() == 0
    assert lines.clean_documents(nothing).count() == 0
