"""Line dedup and decontamination against brute force and on odd tables."""

import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import decontaminate as dc
from tidemark.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, min_docs):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    ident = lambda d: 2**63 - 1 if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(ident(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == ident(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = np.random.default_rng(0)
    pool = ["Shared line number %d here" % i for i in range(12)] + ["short", "É un peu LONG non-ascii", "\x85 not ascii space \x85", "  Padded Shared Line \t", "padded shared line\r"]
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 9))
        rows.append((int(i * 7 % 61), "\n".join([str(rng.choice(pool)) if rng.random() < 0.6 else f"own line {i} {j} of its own" for j in range(n)])))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, "Shared line number 1 here\nand more that is mine"), (None, "Shared line number 1 here"), (0, rows[0][1]), (0, "another text under the same id\nanother text under the same id")]
    rows.append((503, "\n".join(f"long document line {i % 5000} " for i in range(30_000))))
    return rows


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_against_brute_force(spark, min_docs):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, i, "x", 5) for i, r in enumerate(rows)], "doc_id long, text string, row int, pos string, n_lines int").repartition(5)
    got = ld.drop_shared_lines(docs, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "row", "pos", "n_lines", "n_dropped"]
    found = {r.row: (r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert found == dict(enumerate(brute_lines(rows, min_docs)))
    assert ld.drop_shared_lines(docs.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = [False] * len(words), set()
    for k, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        if k is None or not w:
            continue
        n = min(width, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit[i : i + n] = [True] * n
                found.add(str(k))
    return len(words), hit, sorted(found)


def benchmark_rows():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)] + ["Ärger", "x2", "naïve"]
    items = [(k, " ".join(rng.choice(vocab, int(rng.integers(11, 25))))) for k in range(8)] + [(20, "tiny item"), (21, ""), (22, None), (None, "no id at all"), (23, "one, TWO; three!"), (10, "w1 w2 w3 w4 w5")]
    rows = []
    for i in range(50):
        t = list(rng.choice(vocab, int(rng.integers(0, 60))))
        if i % 3 == 0:
            w = items[i % 8][1].split()
            a = int(rng.integers(0, len(w) - 10 + 1))
            t[3:3] = w[a : a + 10 + i % 4]
        if i % 5 == 0:
            t += ["Tiny", "ITEM"]
        rows.append((i, " ".join(t)))
    rows += [(60, None), (61, ""), (62, "..."), (None, items[0][1]), (0, rows[0][1]), (63, "w9 " * 50_000 + items[1][1]), (64, "One -- two (three)")]
    return rows, items


@pytest.mark.parametrize("options", [{}, {"block_words": 60}, {"block_words": 25}])
def test_benchmark_against_brute_force(spark, options):
    rows, items = benchmark_rows()
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, row int, items string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.row: r for r in dc.find_benchmark(docs, bench, **options).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        n, hit, found = brute_hits(t, items)
        mask = [False] * n
        for s in got[i].hit_spans:
            mask[s["first"] : s["last"] + 1] = [True] * (s["last"] - s["first"] + 1)
        assert (got[i].doc_id, got[i].n_words, mask, got[i]["items"]) == (d, n, hit, found)


def test_removal_of_documents_and_spans(spark):
    rows, items = benchmark_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = [r for r in rows if not any(brute_hits(r[1], items)[1])]
    assert sorted(map(str, (tuple(r) for r in dc.decontaminate(docs, bench).collect()))) == sorted(map(str, clean))
    odd = docs.selectExpr("doc_id", "text", "'a' as n_words", "7 as items")
    assert dc.decontaminate(odd, bench).where("n_words <> 'a' or items <> 7").count() == 0
    cut = dc.decontaminate(docs, bench, "span")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert dc.cut_words("Keep this: One -- two, (three) and that.", [(2, 5)]) == "Keep this: ) and that."
    assert dc.find_benchmark(docs, bench.limit(0)).where("size(hit_spans) > 0").count() == 0
    assert dc.find_benchmark(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, "other")


def test_rows_of_a_hot_line_are_split(spark):
    """One line in every document: its rows go to several tasks of the join."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        docs = spark.range(6000).selectExpr("id AS doc_id", "concat('licence of all documents\n', id, ' a line of its own') AS text").repartition(6)
        plans, real = {}, ld.stage

        def watched(df, name):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return real(df, name)

        ld.stage = watched
        try:
            got = ld.drop_shared_lines(docs)
        finally:
            ld.stage = real
        assert got.where("n_dropped = 1").count() == 5999
        assert "skew=true" in plans["dropped-lines"]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
