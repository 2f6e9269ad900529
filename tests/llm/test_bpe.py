import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rosterlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, text[:60]
    assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_random_texts_equal_the_library(codec, library):
    r = random.Random(5)
    parts = [*"ab  e's'\n\t\r\x1c\x85\xa0th1٣½é日🙂|<>.,!\x00", "<|endoftext|>", "'re", " the", " \n", "    ", "ing"]
    for _ in range(5000):
        same(codec, library, "".join(r.choice(parts) for _ in range(r.randint(0, 16))))


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5000, "ab" * 10_000, "\n" * 3000, "日本" * 4000, "=" * 9000])
def test_long_pieces_equal_the_library(codec, library, text):
    same(codec, library, text)


def test_memo_that_overflows_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 7)
    with open(PATH, encoding="utf-8") as f:
        small = bpe.Codec(f.read())
    same(small, library, "many different words are encoded here, again and again, and many are forgotten " * 5)


def test_query_rows(odd, clashing, library):
    want = []
    for i, t, *_ in odd.collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for docs in (odd, clashing):
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.digests(docs, PATH).collect())


def test_no_rows(nothing):
    assert bpe.digests(nothing, PATH).count() == 0
