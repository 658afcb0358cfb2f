from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffix_dedup as sd


def brute(rows, width):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((d, len(r), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(b for b, g in zip(r, gone) if not g)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300) | st.text("ab", max_size=300).map(str.encode))
def test_suffix_array_and_prefixes(raw):
    t = np.frombuffer(raw, np.uint8)
    words = sd.words_at(t)
    sa, rank = sd.suffix_array(t, words)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert sa.tolist() == want and rank[sa].tolist() == list(range(len(raw)))
    lcp = sd.common_prefixes(t, sa, rank, words, lanes=7)
    for k in range(1, len(want)):
        a, b = raw[want[k - 1] :], raw[want[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    t = rng.integers(97, 100, 3000).astype(np.uint8)
    t[2000:2400] = t[100:500]
    a, b, m = sd.runs_of(t, np.array([0, 1500]), np.array([1500, 3000]), 40, 8)
    anchor = {i: int(h) for x, y, h in zip(a.tolist(), b.tolist(), m.tolist()) for i in range(x, y + 1)}
    assert sorted(anchor) == [*range(0, 1461), *range(1500, 2961)]
    for i in range(100, 461):
        assert anchor[i] == anchor[i + 1900]


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "be", "cé", "delta", "ü", "fox", "g", "hotel"]
    make = lambda n: " ".join(rng.choice(words, n))
    shared = [make(20) for _ in range(4)]
    texts = []
    for i in range(60):
        t = [make(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            t += [shared[int(rng.integers(4))][: int(rng.integers(20, 100))], make(int(rng.integers(1, 12)))]
        texts.append(" ".join(t))
    texts += [texts[3], texts[3], "ab" * 300, "x" * 90, "", None, make(3), texts[5][10:-3], make(3000)]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[7]), (0, texts[0])]


@pytest.mark.parametrize("options", [{}, {"shard_runs": 2, "shard_bytes": 300, "most_shards": 99}, {"shard_runs": 2, "shard_bytes": 300, "most_shards": 1}])
def test_against_brute_force(spark, options):
    rows = corpus(4)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, d string, removed int").repartition(4)
    got = sd.remove_repeats(docs, width=40, gram=8, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got), key=key) == sorted(brute(rows, 40), key=key)


def test_production_width(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(900)]
    make = lambda n: " ".join(rng.choice(words, n))
    p = make(120)
    rows = [(i, f"{make(200)} {p[: 150 + 40 * i]} {make(90)}") for i in range(12)] + [(50, make(40_000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sd.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    for d, n, spans, kept in brute(rows, 200):
        assert (got[d].n_bytes, got[d].n_spans, got[d].n_removed) == (n, len(spans), sum(b - a for a, b in spans))


def test_rows_of_one_id_are_told_apart(spark):
    """Null ids with texts whose 32-bit hashes are equal."""
    from pyspark.sql import functions as F

    tail = " ".join(f"w{i}" for i in range(60))
    hashed = spark.range(200_000).select("id", F.hash(F.concat(F.col("id").cast("string"), F.lit(" " + tail))).alias("h"))
    a, b = sorted(hashed.groupBy("h").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").first().ids)[:2]
    rows = [(None, f"{a} {tail}"), (None, f"{b} {tail}"), (1, f"{a} {tail}")]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=len(tail) + 3 + len(str(min(a, b)))).collect()
    assert sorted((r.doc_id is None, len(r.kept) > 0) for r in got) == sorted((d is None, len(k) > 0) for d, _, _, k in brute(rows, len(tail) + 3 + len(str(min(a, b)))))


def hot_runs(n, seed):
    """Runs of one notice within texts of their own."""
    rng = np.random.default_rng(seed)
    notice = rng.integers(97, 123, 250).astype(np.uint8).tobytes()
    return [rng.integers(97, 123, int(rng.integers(20, 60))).astype(np.uint8).tobytes() + notice[: int(rng.integers(190, 220))] for _ in range(n)]


@pytest.mark.parametrize("clash", [False, True])
def test_equal_windows_are_found_by_hash(monkeypatch, clash):
    """One sort of hashes finds what suffix arrays do; where unequal windows share a hash, suffix arrays decide."""
    parts = hot_runs(40, 3)
    seen = [Counter(w for p in some for w in {p[i : i + 200] for i in range(len(p) - 199)}) for some in (parts[:15], parts[15:])]
    asked = []
    plain, hashes = sd.suffix_array, sd.window_hashes
    monkeypatch.setattr(sd, "suffix_array", lambda *a: asked.append(1) or plain(*a))
    if clash:
        monkeypatch.setattr(sd, "window_hashes", lambda t, width: hashes(t, width) % np.uint64(3))
    want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - 199) if seen[0][p[i : i + 200]] + seen[1][p[i : i + 200]] > 1}
    shard = sd.Shard(parts)
    assert {(k, i) for k, a, b in shard.ranges(shard.repeated()) for i in range(a, b + 1)} == want and want
    a, b = sd.Shard(parts[:15]), sd.Shard(parts[15:])
    for one, hit, k0, other in zip((a, b), a.shared_with(b), (0, 15), seen[::-1]):
        got = {(k0 + k, i) for k, x, y in one.ranges(hit) for i in range(x, y + 1)}
        assert got == {(k, i) for k, p in enumerate(parts) if (k >= 15) == bool(k0) for i in range(len(p) - 199) if other[p[i : i + 200]]} and got
    assert bool(asked) == clash


def test_unequal_windows_of_one_hash_are_noticed(monkeypatch):
    monkeypatch.setattr(sd, "gram_hashes", lambda t, gram=32: np.zeros(max(0, len(t) - gram + 1), np.uint64))
    assert sd.equal_windows(np.frombuffer(b"abcdefgh" * 9, np.uint8), np.arange(40), 20) is None


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
