import re
from collections import Counter

from pyspark.sql import functions as F

from rosterlens.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_measures_equal_brute_force(odd, clashing):
    want = sorted(repr((i, *brute(t))) for i, t, *_ in odd.collect())
    for docs in (odd, clashing):
        got = rules.verdicts(docs).drop("kept").collect()
        assert sorted(repr(tuple(r)) for r in got) == want


def test_hosts_are_shrunk_and_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    bad = " ".join(["# $ %"] * 40)
    rows = [(i, good, f"h{i % 10}") for i in range(200)] + [(1000 + i, bad, "junk") for i in range(60)]
    rows += [(2000, good, "junk"), (3000, bad, "new"), (4000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert got[2000].host_rejected and not got[2000].kept and not got[2000].base_failed
    assert all(got[i].kept for i in range(200)) and got[4000].kept
    rates = rules.host_rates(rules.measures(docs).select("host", F.when(F.col("n_symbols") * 10 > F.col("n_words"), 1).otherwise(0).alias("bad")), ["bad"])
    rate = {r.host: r.bad for r in rates.collect()}
    total = 61 / 263
    assert total < rate["new"] < 1 and rate["h0"] < total


def test_no_rows(nothing):
    assert rules.verdicts(nothing).count() == 0
