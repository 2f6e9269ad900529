import hashlib
import random
import re

import numpy as np
import pytest

from rosterlens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_patterns_equal_plain_ones():
    r = random.Random(2)
    for _ in range(8000):
        text = "".join(r.choice("aZ9.@+- %_1250()é\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text


def test_repeats_are_labelled_alike(field):
    text = "Call +1 (459) 555-9246 now. Later (459) 555-9246 again, and 4111 1111 1111 1111."
    [(base, spans)] = pii.find_all([text], field)
    assert base == brute(text) and set(base) <= set(spans)
    assert any(text[a:b] == "(459) 555-9246" and k == 3 for a, k, b in spans)
    assert "555" not in pii.redacted(text, spans)


def test_numbers_that_are_not_personal_stay(field):
    text = "In 1998 there were 300 of 4512 items, version 2.0.1, at 12:30; see page 7 and 300.1.1.2 or #42."
    assert pii.find_all([text], field)[0][1] == []


def test_marginals_on_a_chain_are_exact(field):
    r = np.random.default_rng(3)
    x = r.normal(size=(4, pii.D)) / 5
    seen = np.array([-1, 2, -1, -1])
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[2, 3]])
    node, n = x @ field.node, pii.N
    total = np.zeros((4, n))
    for y in np.ndindex(n, n, n, n):
        if y[1] == 2:
            s = sum(node[i, y[i]] for i in (0, 2, 3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + (field.skip[y[2]] if y[2] == y[3] else 0)
            for i in range(4):
                total[i, y[i]] += np.exp(s)
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(field.marginals(x, seen, chain, skip), want, atol=1e-3)


@pytest.mark.parametrize("text", ["a" * 100_000, "1" * 100_000, "1." * 50_000, "@" * 50_000, "a@" * 50_000, "+1" * 50_000])
def test_long_runs_are_linear(field, text):
    base, spans = pii.find_all([text], field)[0]
    assert base == spans and (len(base) == 12_500 if text[:3] == "1.1" else not base)


def test_query_rows(odd, clashing, field):
    got = sorted(repr(tuple(r)) for r in pii.find(odd, field).collect())
    assert got == sorted(repr(tuple(r)) for r in pii.find(clashing, field).collect())
    want = []
    for i, t, *_ in odd.collect():
        base = brute(t or "")
        want.append((i, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(pii.told(base).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:-1]) for r in pii.find(odd, field).collect())


def test_redaction_keeps_rows_and_columns(clashing, field):
    done = pii.redact(clashing, field)
    assert done.columns == clashing.columns and done.count() == clashing.count()
    row = done.where("doc_id = 7").first()
    assert row.text == "Mail [EMAIL] or [PHONE] or [IP]" and row.n_chars == len(row.text)
    same = {repr(tuple(r)) for r in clashing.where("doc_id <> 7").collect()}
    assert {repr(tuple(r)) for r in done.where("doc_id <> 7").collect()} == same


def test_no_rows(nothing):
    assert pii.spans(nothing).count() == 0
    assert pii.redact(nothing, pii.EMPTY).count() == 0


def test_word_with_many_spans_takes_the_longest():
    text = ",".join(f"a{i}@b.c" for i in range(12)) + ",longest.of.all.addresses@example.com +1-202-555-0100"
    words = pii.words_of(text, pii.base_spans(text))
    assert words.seen.tolist() == [1, 4]


def added(text, kinds):
    """Spans added if the field labels the words as given."""
    base = pii.base_spans(text)
    w = pii.words_of(text, base)
    labels = np.where(w.seen >= 0, w.seen, kinds)
    return [text[a:b] for a, _, b in pii.added_spans(text, w, labels, base)]


@pytest.mark.parametrize("again", ["5551234567", "555.123.4567", "555 123 4567", "555 123 4567 555"])
def test_repeats_need_no_punctuation(again):
    want = again.removesuffix(" 555")
    assert added(f"Call +15551234567 or {again} then", 4) == [want]
    assert added(f"Call {again} then", 4) == []


def test_shorter_runs_are_tried():
    assert added("card 4222222222222 1234 end", 3) == ["4222222222222"]
    assert added("card 77 4222222222222 end", 3) == ["4222222222222"]


@pytest.mark.parametrize("again", ["5551234567", "555.123.4567", "555 123 4567"])
def test_bare_repeats_are_masked(field, again):
    text = f"Call +15551234567 now. In 1998 {again}, again."
    assert pii.redacted(text, pii.find_all([text], field)[0][1]) == "Call [PHONE] now. In 1998 [PHONE], again."
