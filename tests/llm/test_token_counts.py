import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rosterlens.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, text):
    return len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_rows(odd, clashing, library):
    want = sorted(repr((i, *(s := brute(library, t)), s[1] > 512)) for i, t, *_ in odd.collect())
    for frame in (odd, clashing):
        assert want == sorted(repr(tuple(r)) for r in tc.over_limit(frame, PATH).collect())


def test_random_texts_in_small_blocks(spark, library):
    r = random.Random(7)
    parts = [*"ab  e's'\n\t\r\x1c\x85\xa0th1٣½é日🙂|<>.,!\x00", "<|endoftext|>", "'re", " the", " \n", "    ", "ing", " word word "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(3000)]
    docs = spark.createDataFrame([(str(i % 2900), t, i) for i, t in enumerate(texts)], "doc_id string, text string, n int").repartition(5)
    got = tc.token_counts(docs, PATH, block_chars=3000).collect()
    want = [(str(i % 2900), *brute(library, t)) for i, t in enumerate(texts)]
    assert sorted(want) == sorted(map(tuple, got))


def test_pre_tokens_meet_in_buckets(odd, library):
    docs = odd.selectExpr("doc_id key", "text")
    packets = tc.frequencies(docs, PATH, block_chars=2000).selectExpr("block", "inline(packets)")
    sizes = {(r.block, r.bucket): tc.unpressed_numbers(r.sizes).tolist() for r in tc.piece_sizes(packets, PATH).collect()}
    bucket: dict = {}
    found = 0
    for r in packets.collect():
        pieces = tc.unpacked(r.pieces)
        assert sizes[r.block, r.bucket] == [len(library.encode(p, add_special_tokens=False).ids) for p in pieces]
        assert all(bucket.setdefault(p, r.bucket) == r.bucket for p in pieces)
        found += len(pieces)
    assert found > 1.5 * len(bucket) and len(set(bucket.values())) > 100


def test_memo_that_overflows_changes_nothing(odd, library, monkeypatch):
    monkeypatch.setattr(tc, "MEMO_ENTRIES", 3)
    sizes = tc.Sizes(tc.codec(tc.content(PATH)))
    pieces = [" a", "word", "<|endoftext|>", " longer", "x" * 99, " a", "word", "q"]
    assert [sizes[p] for p in pieces] == [len(library.encode(p, add_special_tokens=False).ids) for p in pieces] and len(sizes) <= 3


def test_long_pieces(spark, library):
    texts = ["a" * 50_000, " " * 5000, "x y " * 30_000, "=" * 9000, "\n" * 3000, " a", "a ", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((i, *brute(library, t)) for i, t in enumerate(texts)) == sorted(map(tuple, tc.token_counts(docs, PATH).collect()))


def test_nothing(nothing):
    assert tc.over_limit(nothing, PATH).collect() == []
    assert tc.over_limit(nothing, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
