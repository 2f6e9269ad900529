import random

import corpus_pipeline as p
from rosterlens.llm import gam, lines, packing, pii, simhash
from rosterlens.llm.common import table

from .test_lines import brute as brute_lines
from .test_simhash import roots


def documents(spark, folder):
    """A small corpus: plain texts, junk, frequent lines, copies and near copies, personal data."""
    r = random.Random(1)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(160):
        t = "\n".join(text(40) for _ in range(3))
        if i % 4 == 0:
            t = " ".join(w + r.choice(["###", "%%%", "$$$"]) for w in t.split())
        elif i % 5 == 0:
            t = f"Read our terms before you go on.\n{t}"
        labels.append((i, int(i % 4 > 0), 0))
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(200 + i, rows[7][1], "en", "s0", 1) for i in range(5)]
    rows += [(300, "\n".join(text(40) for _ in range(3)) + " Write to bob.7@mail.example.com now.", "en", "s1", 1), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_equals_its_parts(spark, tmp_path):
    documents(spark, str(tmp_path))
    folder = str(tmp_path)
    docs = table(spark, folder, "documents")
    model = gam.train(docs, table(spark, folder, "labels"))
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if model.score(__import__("numpy").array([gam.features(r["text"])]))[0] >= gam.THRESHOLD]
    good = {r["doc_id"] for r in rows}
    assert sum(i % 4 > 0 for i in good if i < 160) == 120 and sum(i % 4 == 0 for i in good if i < 160) < 4
    for r, (_, d, k) in zip(rows, brute_lines([r["text"] for r in rows])):
        r["text"] = k if d else r["text"]
    fps = [simhash.fingerprint(r["text"]) % (1 << 64) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for k, r in zip(root, rows):
        least[k] = min(least.get(k, 1 << 60), r["doc_id"])
    rows = [r for k, r in zip(root, rows) if least[k] == r["doc_id"]]
    assert not any(200 <= r["doc_id"] < 205 for r in rows)
    kept = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    field = pii.train(kept)
    texts = [r["text"] for r in rows]
    for r, (_, spans) in zip(rows, pii.find_all(texts, field)):
        r["text"] = pii.redacted(r["text"], spans) if r["text"] is not None else None
    assert any("[EMAIL]" in (r["text"] or "") for r in rows)
    masked = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    want = sorted(map(repr, packing.pack_documents(masked).collect()))
    assert want == sorted(map(repr, p.run(spark, folder).collect()))


def test_stages_keep_the_columns(spark, tmp_path, clashing):
    spark.createDataFrame([(4, 1, 0), (8, 0, 0), (9, 0, 0), (20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, clashing, str(tmp_path)).columns == clashing.columns
    assert p.STAGES[-1][1](spark, clashing, str(tmp_path)).count() >= clashing.count()


def test_stages_take_empty_tables(spark, tmp_path, nothing):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_lines_module_is_what_the_stage_uses(odd, spark):
    assert sorted(map(repr, p.line_dedup(spark, odd, "").collect())) == sorted(map(repr, lines.clean_documents(odd).collect()))
