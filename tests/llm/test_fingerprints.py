import hashlib

import numpy as np
import pytest

from tidemark.llm import fingerprints as fp


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(500)]
    return ["\n".join(" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(int(rng.integers(1, 12)))) for _ in range(n)]


def test_peeling_recovers_the_differences():
    rng = np.random.default_rng(1)
    a, b = [], []
    for n, d in ((0, 0), (5, 0), (40, 2), (40, 30), (1000, 1), (1000, 900), (0, 300), (3000, 3000)):
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        a.append(np.unique(np.concatenate([common, rng.integers(0, 2**63, d, dtype=np.uint64)])))
        b.append(np.unique(np.concatenate([common, rng.integers(0, 2**63, d // 2, dtype=np.uint64)])))
    for x, y, (only_x, only_y) in zip(a, b, fp.differences(a, b)):
        assert only_x.tolist() == np.setdiff1d(x, y).tolist() and only_y.tolist() == np.setdiff1d(y, x).tolist()
    for x, y, got in zip(a, b, fp.likeness(a, b)):
        assert got == pytest.approx(len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) if len(np.union1d(x, y)) else 1.0)


def test_equal_texts_and_edits():
    ts = texts(30)
    sets, prints = fp.sketch_documents([*ts, *ts, None, ""])
    assert prints[:30] == prints[30:60] and len(set(prints[:30])) == 30 and prints[60] == prints[61]
    t = ts[0] + " w1" * 200
    assert fp.likeness([fp.digests(t)], [fp.digests(t + " more words")])[0] > 0.8


@pytest.mark.parametrize("range_rows", [4096, 3])
def test_next_document(spark, range_rows):
    ts = texts(50, 3) + [None, "", "word " * 40_000]
    rows = [(i * 5 % 211, t, 1, "x") for i, t in enumerate(ts)] + [(None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r int, h string").repartition(3)
    f = lambda ids, a, b: {"doc_id": ids, "t": a, "n": b}
    got = fp.map_with_next(docs, f, "doc_id long, t string, n string", range_rows=range_rows, batch=7).collect()
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    want = {r[0]: (r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)}
    assert len(got) == len(rows) and {r.doc_id: (r.t, r.n) for r in got} == want


def test_one_document_repeated_ids_and_none(spark):
    f = lambda ids, a, b: {"d": ids, "t": a, "n": b}
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = fp.map_with_next(docs, f, "d long, t string, n string").collect()
    assert sorted((str(r.d), r.t) for r in got) == [("1", "a"), ("1", "a"), ("1", "b"), ("None", "c"), ("None", "c")]
    assert [tuple(r) for r in fp.map_with_next(docs.where("text = 'b'"), f, "d long, t string, n string").collect()] == [(1, "b", "b")]
    assert fp.map_with_next(docs.limit(0), f, "d long, t string, n string").count() == 0


def test_query_against_brute_force(spark, tmp_path):
    ts = texts(40, 9)
    spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fp.op9_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == 40
    for i, t in enumerate(ts):
        n = ts[(i - 1) % 40]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b, c = set(fp.digests(t).tolist()), set(fp.digests(e).tolist()), set(fp.digests(n).tolist())
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))


def test_compare_versions_and_columns(spark):
    docs = spark.createDataFrame([(1, "one two\nthree", "one two\nfour", 9)], "id long, old string, new string, fingerprint int")
    r = fp.compare_versions(docs, ["id"], "old", "new").first()
    assert len(r.removed) == len(r.added) == 1 and r.likeness == pytest.approx(1 / 3)
    assert fp.document_fingerprints(docs, "id", "old").columns == ["id", "old", "new", "fingerprint"]


def test_a_key_that_very_many_rows_repeat(spark):
    """Its rows are dealt out to ranges of its own, and the order stays whole."""
    rows = [(None, "same")] * 400 + [(5, "five")] * 90 + [(i, f"t{i}") for i in range(10, 60)] + [(7, "x"), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    f = lambda ids, a, b: {"doc_id": ids, "t": a, "n": b}
    from collections import Counter

    got = Counter(tuple(r) for r in fp.map_with_next(docs, f, "doc_id long, t string, n string", range_rows=20, batch=7).collect())
    assert sum(got.values()) == len(rows)
    assert got[None, "same", "same"] == 399 and got[None, "same", "t59"] == 1 and got[5, "five", "five"] == 89 and got[5, "five", "same"] == 1
    keys = fp._cuts(docs.selectExpr("coalesce(doc_id, -9223372036854775808) AS d", "xxhash64(text) AS h", "octet_length(text) AS size"), 20)
    assert (keys[0] == -(2**63)).sum() > 5
