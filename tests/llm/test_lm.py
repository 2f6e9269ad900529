import math
import zlib
from collections import Counter

import pytest

from rosterlens.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b" end"]


def fold(i):
    return -1 if i is None else zlib.crc32(str(i).encode()) % 10


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(b))


@pytest.mark.parametrize("block", [1000, 1 << 30])
def test_scores_equal_dictionaries(odd, clashing, block):
    docs = [(r.doc_id, tokens(r.text)) for r in odd.select("doc_id", "text").collect()]
    single, pair, start = Counter(), Counter(), 0
    for i, t in docs:
        if fold(i) > 0:
            single.update(t)
            pair.update(zip([None, *t], t))
            start += 1
    n, v = sum(single.values()), len(single)
    dealt, blocks = lm.blocked(odd, block)
    answers, totals = lm.counted(dealt, 2, 2 * blocks)
    assert (totals.tokens, totals.types) == (n, v)
    mix = lm.weights(lm.statistics(dealt, answers, 2), totals, 2)
    assert abs(mix.sum(axis=1) - 1).max() < 1e-9
    want = {}
    for i, t in docs:
        score = 0.0
        for u, w in zip([None, *t], t):
            context = single[u] if u else start
            m = mix[context.bit_length() if context else lm.unseen(2, 1)]
            score += math.log10(m[0] / (v + 1) + m[1] * single[w] / n + m[2] * pair[u, w] / max(context, 1))
        base = sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[i] = (fold(i) == 0, len(t), sum(w in single for w in t), n, base, score)
    for frame in (odd, clashing):
        got = lm.scores(frame, block_chars=block).collect()
        assert len(got) == len(docs)
        for r in got:
            assert tuple(r)[1:5] == want[r.doc_id][:4]
            assert close(r.base_score, want[r.doc_id][4]) and close(r.score, want[r.doc_id][5])


def test_held_out_text_is_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.scores(docs).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]
    longer = lm.scores(docs, order=3, block_chars=400_000).where("held_out").groupBy().sum("score").first()
    assert longer[0] > got[0]


def test_no_rows(nothing):
    assert lm.scores(nothing).count() == 0


def test_rows_of_one_id_or_none_are_spread_over_blocks(spark):
    same = [(7, "one two three " * 20, "en", "a", 1)] * 300
    shared = [(7 if i % 2 else None, f"text {i} of many words " * 10, "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(same + shared, "doc_id long, text string, lang string, source string, n_chars long")
    dealt, blocks = lm.blocked(docs, 5000)
    sizes = dealt.groupBy("block").agg({"copies": "sum"}).collect()
    chars = dealt.selectExpr("block", "copies * (length(text) + 1) c").groupBy("block").sum("c").collect()
    assert sum(r[1] for r in sizes) == 600 and len(sizes) > blocks // 2
    assert max(r[1] for r in chars) < 6 * 5000
    small, whole = (sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in lm.scores(docs, block_chars=b).collect()) for b in (5000, 1 << 30))
    assert len(small) == 600 and small == whole


def test_packets_are_read_as_written():
    import numpy as np

    for a in ([], [0, 0], [0, 255], [256, 1, 0], [2**63 - 1, 3]):
        [back] = lm.unpacked([lm.packed(np.array(a, np.uint64))])
        assert back.tolist() == a


def test_registered_model_is_of_order_three(spark, tmp_path):
    from rosterlens.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (sorted((r.doc_id, round(r.score, 6)) for r in d.collect()) for d in (queries.op5_interpolated_lm(spark, str(tmp_path)), lm.scores(docs, order=3)))
    assert got == want


def test_probabilities_sum_to_one_after_any_words(odd):
    docs = [t for i, t in ((r.doc_id, tokens(r.text)) for r in odd.select("doc_id", "text").collect()) if fold(i) > 0]
    grams = [Counter(), Counter(), Counter()]
    for t in docs:
        for k in range(3):
            padded = [None] * k + t
            grams[k].update(tuple(padded[i : i + k + 1]) for i in range(len(t)))
    n, v = sum(grams[0].values()), len(grams[0])
    dealt, _ = lm.blocked(odd, 100_000)
    answers, totals = lm.counted(dealt, 3, 4)
    mix = lm.weights(lm.statistics(dealt, answers, 3), totals, 3)
    contexts = [Counter(), Counter()]
    for k in (1, 2):
        for g, c in grams[k].items():
            contexts[k - 1][g[:-1]] += c
    for words in ((b"of", b"many"), (b"never", b"text"), (b"text", b"never"), (b"never", b"written")):
        pair, both = contexts[0][words[1:]], contexts[1][words]
        m = mix[both.bit_length() if both else lm.unseen(3, 2 if pair else 1)]
        total = m[0]  # v known words and one for all others
        for (w,), c in grams[0].items():
            total += m[1] * c / n + m[2] * grams[1][(words[1], w)] / max(pair, 1) + m[3] * grams[2][(*words, w)] / max(both, 1)
        assert abs(total - 1) < 1e-9


def test_classes_of_estimates_give_the_weights_of_exact_ones():
    import numpy as np

    r = np.random.default_rng(3)
    totals = lm.Totals(100_000, 5000, 0, 0)
    count = np.floor(2.0 ** r.uniform(0, 12, 20_000))
    exact = np.stack([count, r.uniform(0.001, 1, 20_000), r.uniform(0.01, 1, 20_000) * (r.uniform(size=20_000) < 0.6)], axis=1)
    classes = np.where(exact > 0, np.rint(lm.STEPS * np.log2(np.maximum(exact, 1e-9))), -1000)
    n = r.integers(1, 50, 20_000).astype(float)
    fine = np.where(exact > 0, lm.STEPS * np.log2(np.maximum(exact, 1e-9)), -1000)
    assert np.abs(lm.learned(classes, n, totals) - lm.learned(fine, n, totals)).max() < 0.01
