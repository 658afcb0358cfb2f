import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_store as ts
from tidemark.llm import tokens

PATH = tokens.default_path()


def test_cuts_cover_and_move_little():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 60_000).astype(np.uint32)
    ends = ts.cut_points(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and (sizes[:-1] >= ts.LEAST).all() and (sizes <= ts.MOST).all() and 300 < sizes.mean() < 800
    edited = np.concatenate([ids[:30_000], [7], ids[30_000:]]).astype(np.uint32)
    again = ts.cut_points(edited)
    a = {ids[s:e].tobytes() for s, e in zip([0, *ends], ends)}
    b = {edited[s:e].tobytes() for s, e in zip([0, *again], again)}
    assert len(b - a) <= 3
    assert ts.cut_points(ids[:0]) == [] and ts.cut_points(ids[:1]) == [1]
    same = np.zeros(10_000, np.uint32)
    assert ts.cut_points(same)[-1] == 10_000


def test_crc_joined():
    rng = np.random.default_rng(1)
    runs = [[0, 4], [8, 0], [400, 4, 12, 8192], [1], [5, 7, 100_000]]
    parts = [[rng.bytes(n) for n in r] for r in runs]
    flat = [p for r in parts for p in r]
    first = np.cumsum([0] + [len(r) for r in runs])[:-1]
    got = ts.crc32_joined(np.array([zlib.crc32(p) for p in flat]), np.array([len(p) for p in flat]), first)
    assert got.tolist() == [zlib.crc32(b"".join(r)) for r in parts]


def test_round_trip_and_damage(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    long = " ".join(rng.choice(words, 9000))
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 2000)))) for _ in range(40)] + [None, "", long, long + " end", "start " + long, "a<|endoftext|>b"]
    rows = [(i * 7 % 101, t, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", "x", "y"), (0, texts[0], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, digest string").repartition(3)
    folder = str(tmp_path / "store")
    ts.write_store(docs, PATH, folder)
    lib = Tokenizer.from_file(PATH)
    want = sorted((2**63 - 1 if d is None else d, tuple(lib.encode(t or "", add_special_tokens=False).ids + [0])) for d, t, *_ in rows)
    got = sorted((2**63 - 1 if r.doc is None else r.doc, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in ts.read_documents(spark, folder).collect())
    assert got == want
    index = sorted(tuple(r) for r in ts.read_index(spark, folder).collect())
    assert index == sorted(tuple(r) for r in ts.read_index(spark, folder, whole=False).collect())
    start = 0
    for (d, s, n, c), (d2, ids) in zip(sorted(index, key=lambda r: r[1]), want):
        assert (d, s, n) == (d2, start, len(ids)) and c == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    chunks = ts._chunks(spark, folder).select("digest").collect()
    assert len(chunks) == len({bytes(r.digest) for r in chunks})
    digests = spark.read.parquet(f"{folder}/recipes").selectExpr("explode(digests) d")
    assert digests.distinct().count() == len(chunks) < digests.count()
    # a recipe that is changed no longer matches the manifest
    changed = str(tmp_path / "changed")
    import shutil

    shutil.copytree(folder, changed)
    r = spark.read.parquet(f"{folder}/recipes").selectExpr("part", "pos", "doc - 1 as doc", "text_hash", "n_tokens", "local_start", "digests", "sizes")
    shutil.rmtree(f"{changed}/recipes")
    r.write.parquet(f"{changed}/recipes")
    with pytest.raises(Exception, match="manifest"):
        ts.read_index(spark, changed)


@pytest.mark.parametrize("held_bytes", [1 << 26, 1])
def test_chunks_used_once_know_their_place(spark, tmp_path, held_bytes):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words, n))
    long = make(6000)
    texts = [make(2500) for _ in range(12)] + [long, long + " end", "a " * 9000, "", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3 + [(None, texts[1]), (None, texts[1]), (None, make(900)), (None, ""), (None, "")]
    folder = str(tmp_path / "store")
    ts.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, folder, held_bytes=held_bytes)
    uses: dict[bytes, list] = {}
    for r in spark.read.parquet(f"{folder}/recipes").collect():
        for k, d in enumerate(r.digests):
            uses.setdefault(bytes(d), []).append((r.doc, r.text_hash, k))
    stored = spark.read.parquet(f"{folder}/rows").where("kind = 'chunk'").collect()
    assert len(stored) == len(uses) == len({bytes(r.digest) for r in stored})
    placed = {bytes(r.digest): [(r.doc, r.text_hash, r.k)] for r in stored if r.k is not None}
    if held_bytes > 1:
        assert placed == {d: u for d, u in uses.items() if len(u) == 1} and 0 < len(placed) < len(uses)
    else:  # given out before the partition's end
        assert not placed
    lib = Tokenizer.from_file(PATH)
    want = sorted((2**63 - 1 if d is None else d, zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, t in rows)
    got = ts.read_index(spark, folder).collect()
    assert sorted((r.doc, r.ids_crc32) for r in got) == want
    assert sorted(map(tuple, got)) == sorted(map(tuple, ts.read_index(spark, folder, whole=False).collect()))


@pytest.mark.parametrize("which", ["k IS NOT NULL", "k IS NULL", "k > 0"])
def test_missing_and_damaged_chunks(spark, tmp_path, which):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (40, 3000, 50, 5000)]
    folder = str(tmp_path / "store")
    ts.write_store(spark.createDataFrame([*enumerate(texts), (9, texts[1])], "doc_id long, text string"), PATH, folder)
    rows = spark.read.parquet(f"{folder}/rows")
    hit = rows.where(f"kind = 'chunk' AND {which}").first().digest
    flip = "unhex(concat(hex(substring(payload, 1, length(payload) - 1)), 'FF'))"
    for k, change in enumerate([rows.where(F.coalesce(F.col("digest") != hit, F.lit(True))), rows.withColumn("payload", F.when(F.col("digest") == hit, F.expr(flip)).otherwise(F.col("payload")))]):
        changed = str(tmp_path / f"changed{k}")
        shutil.copytree(folder, changed, ignore=shutil.ignore_patterns("rows"))
        change.write.parquet(f"{changed}/rows")
        with pytest.raises(ValueError, match="manifest"):
            ts.read_index(spark, changed)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ts.write_store(docs, PATH, str(tmp_path / "s"))
    assert ts.read_index(spark, str(tmp_path / "s")).count() == 0
    assert ts.read_documents(spark, str(tmp_path / "s")).count() == 0
