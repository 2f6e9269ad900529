import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import fim

TOKENS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(key, text):
    text = text or ""
    units = TOKENS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return key, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def same(docs, rows):
    assert sorted(repr(brute(*r)) for r in rows) == sorted(repr(tuple(r)) for r in fim.digests(docs).collect())


def test_query_rows(odd, clashing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    same(odd, rows)
    same(clashing, rows)


def test_random_texts(spark, monkeypatch):
    r = random.Random(3)
    parts = [*"ab  é日🙂<>PSM\n.", "word", "Word " * 30, "<P", "<S>", "x" * 200, "日本語" * 40, "# " * 90]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(2000)]
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_shared_passages_are_the_same_chunks():
    r = random.Random(1)
    words = lambda n: "".join(r.choice("abcdefgh  .") for _ in range(n)).encode()
    shared = words(20_000)
    texts = [words(500) + shared + words(300), words(1234) + shared]
    chunks = []
    for t in texts:
        ends = fim.chunk_ends(fim.borders(np.frombuffer(t, np.uint8)), 0, len(t))
        assert ends[-1] == len(t) and max(np.diff([0, *ends])) <= fim.LONGEST
        chunks.append({t[a:b] for a, b in zip([0, *ends], ends)})
    assert sum(map(len, chunks[0] & chunks[1])) > 0.8 * len(shared)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab " * 20_000, "é" * 9000, "\n" * 9000, "aé" * 5000, "<" * 5000])
def test_every_cut(text):
    raw, units = text.encode(), TOKENS.findall(text)
    (c,) = fim.chunked([raw], fim.Summaries())
    assert c.tokens[-1] == len(units) and c.chars[-1] == len(text)
    for n in {0, 1, len(units) // 3, len(units) // 2, len(units) - 1, len(units)}:
        head = "".join(units[:n])
        assert c.cut(n) == (len(head.encode()), len(head))


def test_memo_that_overflows_changes_nothing(monkeypatch):
    raws = [(f"some words {i} " * 300).encode() for i in range(40)] * 2
    whole = [c.tokens for c in fim.chunked(raws, fim.Summaries())]
    monkeypatch.setattr(fim, "MEMO_BYTES", 5000)
    monkeypatch.setattr(fim, "PORTION", 100)
    small = fim.Summaries()
    assert whole == [c.tokens for c in fim.chunked(raws, small)] and small.held <= 5000 + fim.LONGEST


def test_restored_from_output_and_form(spark):
    rows = [("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<S>a<P>b<M>c", "bca"), ("plain", "<P>x", "<P>x"), ("psm", "<P><S><M>", ""), ("psm", "<P><<S>S><M>P", "<PS>")]
    got = spark.createDataFrame(rows, "form string, output string, want string").where(fim.restored(F.col("form"), F.col("output")) != F.col("want"))
    assert got.collect() == []


def test_nothing(nothing):
    assert fim.digests(nothing).collect() == []
