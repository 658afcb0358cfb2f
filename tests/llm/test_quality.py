import zlib

import numpy as np
import pytest

from tidemark.llm import quality


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "river", "over", "stone", "light", "was", "and", "house", "green", "walk", "they", "of"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, int(rng.integers(5, 120))))
        bad = i % 5 == 0
        text = " ".join(w).capitalize() + "."
        if bad:
            text = "!! ".join(w).upper() if i % 2 else " ".join(x for y in w for x in [y] * 6)
        rows.append((i, text))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.classify_quality(docs, lab).select("*", quality.held_out().alias("held_out")).collect()
    assert len(out) == len(rows)
    y = dict(labels)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_prior_is_estimated():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for share in (0.3, 0.6, 0.85):
        k = int(4000 * share)
        assert abs(quality.estimate_prior(p[:2000], np.concatenate([p[2000 : 2000 + k // 2], n[: (4000 - k) // 2]])) - share) < 0.08


def test_risk_does_not_turn_negative():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (50, 5)).astype(np.float32)
    u = np.concatenate([rng.normal(1, 1, (50, 5)), rng.normal(-1, 1, (50, 5))]).astype(np.float32)
    model = quality.fit_pu(p, u, 0.5, epochs=200)
    g = model.logit(u[50:])
    assert (g < 0).mean() > 0.7 and np.isfinite(g).all()


def test_edges(spark):
    rows, labels = corpus(200)
    rows += [(None, "x"), (3, None), (3, ""), (4, rows[4][1]), (4, rows[4][1]), (900, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 0.5, 9) for r in rows], "doc_id long, text string, score double, predicted int")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0), (7, 1)], "doc_id long, quality int")
    out = quality.classify_quality(docs, lab)
    assert sorted(out.columns) == ["doc_id", "predicted", "score", "text"] and out.count() == len(rows)
    assert quality.classify_quality(docs.limit(0), lab).count() == 0
    assert {r.predicted for r in quality.classify_quality(docs, lab.limit(0)).collect()} == {1}


def test_long_texts_are_compressed_whole():
    for text in ("buy cheap pills now ! " * 12_000, "buy cheap pills now ! " * 120_000):  # 264,000 and 2.6 million bytes
        assert abs(quality.features(text)[13] - len(zlib.compress(text.encode(), 1)) / len(text)) < 1e-3
        assert quality.features(text)[13] < 0.02


def test_scores_against_brute_force(spark):
    """Spark's scores are the network's, written out for each text; an id that is repeated counts once in training."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)))) + ("." if i % 2 else " !!!! $$")) for i in range(120)] + [(500, None), (501, ""), (None, "no id")]
    docs = spark.createDataFrame(rows + [(0, f"again {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(120)], "doc_id long, quality int")
    m = quality.train(docs, labels, max_positive=40, max_unlabelled=60)
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    for d, t in rows:
        z = (quality.features(t).astype(float) - m.mean) / m.scale
        hidden = [max(0.0, sum(min(6.0, max(-6.0, a)) * w for a, w in zip(z, m.layers[0][:, j])) + m.layers[1][j]) for j in range(len(m.layers[1]))]
        logit = sum(h * w for h, w in zip(hidden, m.layers[2])) + m.layers[3]
        assert got[d] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)
