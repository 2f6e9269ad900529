import random
from collections import defaultdict

from rosterlens.llm import packing


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [b for b in bins if b["room"] >= n and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if fits:
            room = min(b["room"] for b in fits)
            b = min((b for b in fits if b["room"] == room), key=lambda b: b["since"])
        else:
            b = {"no": len(bins), "room": capacity, "s": set(), "c": set(), "since": 0}
            bins.append(b)
        b["room"] -= n
        b["since"] = len(out)
        b["s"].add(s)
        b["c"].add(c)
        out.append(b["no"])
    return out


def test_best_fit_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(0, 60)
        rows = sorted(((r.randint(0, 20), r.randint(-1, 6), r.randint(-1, 9)) for _ in range(n)), reverse=True)
        columns = [list(x) for x in zip(*rows)] or [[], [], []]
        assert packing.best_fit(*columns, 20) == brute(*columns, 20)


def test_every_word_is_in_one_piece_and_no_bin_conflicts(odd, clashing):
    docs = {(r.doc_id, r.text): r.source for r in odd.collect()}
    for frame in (odd, clashing):
        rows = packing.pack_documents(frame, capacity=64, group_pieces=500).collect()
        words = defaultdict(int)
        bins = defaultdict(list)
        for r in rows:
            words[r.doc_id] += r.n_words
            bins[r.bin_group, r.bin].append(r)
        want = defaultdict(int)
        for i, t, *_ in odd.collect():
            want[i] += len((t or "").encode().split())
        assert words == want
        source = {i: s for (i, _), s in docs.items()}
        for inside in bins.values():
            assert sum(r.n_words for r in inside) <= 64
            named = [source[r.doc_id] for r in inside if source[r.doc_id] is not None]
            assert len(named) == len(set(named))
        full = packing.bins(packing.pack_documents(frame, capacity=64, group_pieces=500))
        assert full.groupBy().sum("filled").first()[0] == sum(want.values())


def test_same_rows_same_bins(odd):
    one, two = (sorted(map(repr, packing.pack_documents(d, 64, 500).collect())) for d in (odd, odd.repartition(7)))
    assert one == two


def test_odd_lengths(spark, nothing):
    items = spark.createDataFrame([(1, None, None, None), (2, -5, "a", "x"), (3, 7, "a", "x"), (4, 4, None, None)], "doc_id long, length long, source string, cluster string")
    got = {(r.doc_id, r.piece): r for r in packing.pack(items, 4).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (3, 1), (4, 0)}
    assert [got[3, k].length for k in (0, 1)] == [4, 3] and got[3, 1].start == 4
    assert packing.pack_documents(nothing).count() == 0


def test_rows_of_one_id_or_none_are_spread_over_groups(spark):
    from collections import Counter

    rows = [(7, 3, "a", "x")] * 400 + [(7 if i % 2 else None, 3, f"s{i}", f"t{i}") for i in range(400)]
    items = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster string")
    got = packing.pack(items, 64, 50).collect()
    sizes = Counter(r.bin_group for r in got)
    assert sum(sizes.values()) == 800 and len(sizes) == 16 and max(sizes.values()) < 100
    again = packing.pack(items.repartition(5), 64, 50).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
