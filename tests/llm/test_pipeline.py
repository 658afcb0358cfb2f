"""The stages against brute force on a small corpus, and the corpus end to end."""

import numpy as np
import pytest

import corpus_pipeline as cp
from tidemark.llm import simhash


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = ["the", "river", "over", "stone", "light", "was", "and", "house", "green", "walk", "they", "of", *[f"w{i}" for i in range(2000)]]
    say = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    root = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(700):
        text = "\n".join(say(int(rng.integers(8, 60))) for _ in range(int(rng.integers(1, 6))))
        bad = i % 6 == 0
        if bad:
            text = "!! ".join(text.upper().split())
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, int(not bad), 0))
    base = [r for r in rows if r[0] % 6]
    for k in range(40):  # near copies, on one line each, of a document of one line
        words_ = rows[6 * k + 1][1].replace("\n", " ").split() * 4
        rows[6 * k + 1][1] = " ".join(words_)
        words_[k % len(words_)] = "changed"
        rows.append([1000 + k, " ".join(words_), "en", "s1", 0])
    items = [(k, say(30)) for k in range(5)]
    for k, (_, t) in enumerate(items):
        rows.append([2000 + k, say(40) + " " + t + " " + say(40), "en", "s0", 0])
    del base
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    good = cp.classify(spark, docs, sf)
    assert good.columns == names
    kept = {r.doc_id for r in good.collect()}
    want = {i for i in range(700) if i % 6}
    assert len(want - kept) <= 0.03 * len(want) and len([d for d in kept if d < 700 and d % 6 == 0]) <= 6
    lines = cp.dedup_lines(spark, docs, sf)
    assert lines.columns == names and lines.count() == docs.count() and lines.where("n_chars <> char_length(text)").count() == 0
    near = cp.dedup_near(spark, docs, sf)
    assert near.columns == names
    left = {r.doc_id for r in near.collect()}
    sets = {r.doc_id: {hash(tuple(w[i : i + 5])) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in docs.collect()}
    for k in range(40):
        a, b = sets[6 * k + 1], sets[1000 + k]
        if len(a & b) / len(a | b) >= 0.85:
            assert 1000 + k not in left and 6 * k + 1 in left
    assert {d for d in sets if d < 700} <= left | {6 * k + 1 for k in range(40)}
    clean = cp.decontaminate_documents(spark, docs, sf)
    assert clean.columns == names and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {2000 + k for k in range(5)}


def test_run(spark, sf):
    got = cp.run(spark, sf)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    rows = got.collect()
    ids = {r.doc_id for r in rows}
    assert not ids & {2000 + k for k in range(5)} and len(ids) > 400
    assert simhash.similar_radius(0.8, 192) == 38


def test_stages_on_odd_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_words int, c int, component_id int"
    odd = [(None, None, None, None, None, 1.0, 0, 1, 1, 1), (1, "", "en", "s", 0, 1.0, 0, 1, 1, 1), (1, "", "en", "s", 0, 1.0, 0, 1, 1, 1), (None, "the river was green over the stone and they walk", "en", "s", 5, 1.0, 0, 1, 1, 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, f in cp.STAGES[:-1]:
            docs_out = f(spark, docs, sf)
            assert docs_out.columns == docs.columns
            assert all((r.score, r.predicted, r.n_words, r.c, r.component_id) == (1.0, 0, 1, 1, 1) for r in docs_out.collect())
        assert cp.pack(spark, docs, sf).count() == len(rows)
