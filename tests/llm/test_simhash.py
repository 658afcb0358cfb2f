import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints, key=lambda d: (d is None, d))
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                if x != y:
                    lo, hi = sorted((x, y), key=lambda d: (d is None, d))
                    root[hi] = lo
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_planes_against_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = np.repeat(base, 12)
    for i in range(len(values)):
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            values[i] ^= np.uint64(1) << np.uint64(b)
    group = np.sort(rng.integers(0, 9, len(values)))
    got = set()
    for i, j in simhash.near_pairs(values, group, radius):
        got |= set(zip(i.tolist(), j.tolist()))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if group[i] == group[j] and bin(int(values[i] ^ values[j])).count("1") <= radius}
    assert got == want


def test_fingerprint():
    for text in (None, "", " \t", "One", "a B", "a b c", "x " * 50, "é Ä b\x0bc d\x85e f"):
        assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_components(spark, bucket):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for c in range(12):
        text = list(rng.choice(words, 150))
        for _ in range(6):
            t = list(text)
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            rows.append(" ".join(t))
    rows += ["", None, "  ", "tiny", "tiny"]
    data = [(i * 3, t, "x", 1) for i, t in enumerate(rows)] + [(None, rows[0], "x", 2), (0, rows[0], "again", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, f string, component long")
    got = simhash.near_duplicates(docs, width=3, similarity=None, bucket=bucket).collect()
    assert len(got) == len(data)
    prints = {i * 3: brute_print(t) for i, t in enumerate(rows)} | {None: brute_print(rows[0])}
    want = brute_components(prints)
    for r in got:
        assert r.fingerprint % 2**64 == prints[r.doc_id]
        assert r.component_id == want[r.doc_id]
    kept = simhash.keep_one(docs, width=3, similarity=None, bucket=bucket)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want.values()})


@pytest.mark.parametrize("bucket", [4096, 8])
def test_similarity(spark, bucket):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    rows, groups = [], []
    for g in range(40):
        text = list(rng.choice(words, 400))
        for k in range(5):
            t = list(text)
            for at in rng.choice(400, 2 * k, replace=False):  # each change touches five of some 400 shingles
                t[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(t)))
            groups.append(g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    assert all(groups[d] == groups[c] for d, c in got.items())
    assert sum(got[d] == d for d in got) <= 44
    assert simhash.keep_one(docs, bucket=bucket).count() == sum(got[d] == d for d in got)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other words stand here")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).collect()] == [None] * 3
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == ["a b c d", "other words stand here"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def _pair(rng, same, only):
    """Texts whose sets of five-word shingles have ``same`` in common and ``only`` each of their own."""
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    head = say(same + 4)
    return " ".join(head + say(only)), " ".join(head + say(only))


def test_exactly_from_0_8_on(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(500):
        same, only = [(160, 20), (159, 20), (180, 12), (130, 25)][k % 4]  # J = 0.8, 0.799, 0.882, 0.722
        rows += [(2 * k, (p := _pair(rng, same, only))[0]), (2 * k + 1, p[1])]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (same / (same + 2 * only) < 0.8)}
    chain = [f"c{x}" for x in range(700)]  # each of these is only like its neighbours
    rows += [(2000 + k, " ".join(chain[20 * k : 20 * k + 300])) for k in range(20)]
    want |= {2000 + k: 2000 for k in range(20)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_keys_meet():
    rng = np.random.default_rng(6)
    for _ in range(2000):
        v = rng.integers(0, 2**64, 360, dtype=np.uint64)
        assert (simhash.table_keys(v[:324]) == simhash.table_keys(v[36:])).any()  # 288 / 360 = 0.8
