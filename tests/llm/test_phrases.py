import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import phrases
from rosterlens.llm.storage import written

from .conftest import LOW


def brute(rows, least=30, longest=4, top=2000, inside=80):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        often = [p for p in f if len(p) > 1 and f[p] >= least]
        longer = Counter()
        for p in often:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], f[p])
        scored = []
        for p in often:
            if longer[p] and 100 * longer[p] >= inside * f[p]:
                continue
            s, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return out


def same(frame, want, **options):
    assert sorted(want) == sorted(tuple(r) for r in phrases.collocations(frame, **options).collect())


def rows_of(frame):
    return [tuple(r) for r in frame.select("lang", "text").collect()]


def test_odd_rows(odd, clashing):
    clashing = clashing.withColumns({c: F.lit("mine") for c in ("block", "shard", "words", "phrase", "f", "n", "key")})
    want = brute(rows_of(odd))
    assert len(want) > 50
    same(odd, want)
    same(clashing, want)


@pytest.fixture(scope="module")
def random_rows():
    r = random.Random(11)
    words = [*"abcdefgh", "é", "日本", "It's", "#", "\x0bx", "new york", "New\tYork city", "in spite of the"]
    return [(r.choice(["en", "EN", "fr", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", "  ", ". ", "\n", "\t"]) for _ in range(r.randint(0, 60)))) for _ in range(900)]


@pytest.mark.parametrize("options", [{}, {"block_chars": 2000, "shards": 7}, {"top": 9, "shards": 1}, {"least": 5, "longest": 3, "inside_percent": 50}])
def test_random_texts(spark, random_rows, options):
    frame = spark.createDataFrame(random_rows, "lang string, text string").repartition(6)
    named = {"inside_percent": "inside"}
    want = brute(random_rows, **{named.get(k, k): v for k, v in options.items() if k not in ("block_chars", "shards")})
    assert len(want) > 20
    same(frame, want, **options)


def test_a_phrase_of_one_shard_is_found(spark):
    rows = [("en", "rare phrase here")] * 30 + [("en", f"w{i} v{i} other words") for i in range(3000)]
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    same(frame, brute(rows), block_chars=3000)


def test_hashes_that_meet_change_no_count(spark, random_rows, monkeypatch):
    few = lambda a, b: (a * 31 + b) % 509
    rows = random_rows[:300]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    monkeypatch.setattr(phrases, "mixed", few)
    same(frame, brute(rows, least=10), least=10)


def test_nothing(nothing):
    assert phrases.collocations(nothing).collect() == []


def test_no_task_holds_many_blocks(spark, monkeypatch):
    """Rows of blocks have megabytes: a task must not hold all of a file's when it writes or reads it."""
    paths = []

    def seen(df, *args, **options):
        out = written(df, *args, **options)
        paths.append((out.columns, out.inputFiles()))
        return out

    monkeypatch.setattr(phrases, "written", seen)
    docs = spark.createDataFrame([("en", f"some words and number {i}") for i in range(60)], "lang string, text string").coalesce(1)
    phrases.frequent(docs, least=2, block_chars=20)
    blocks = [f for columns, files in paths if "words" in columns for f in files]
    groups = [m.row_group(i).num_rows for m in (pq.read_metadata(f.removeprefix("file:")) for f in blocks) for i in range(m.num_row_groups)]
    assert sum(groups) == 60
    assert max(groups) <= 8
