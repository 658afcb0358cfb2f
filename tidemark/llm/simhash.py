"""Near-duplicates: by SimHash, compared over vertical bit planes, or by exact Jaccard similarity of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, connected_components, from_id, keyed, local_roots, map_arrow, map_rows, read, stage

BITS = 64
#: Blocks of the fingerprint; two that differ in r bits agree on all but r blocks.
_EDGES = (0, 11, 22, 33, 43, 54, 64)
#: A bucket with more fingerprints than this is compared in pieces, two at a time.
BUCKET = 4096
#: Lanes of a block that is abandoned as one: 64 words of 64 lanes.
_BLOCK = 64
#: Candidates by MinHash: so many tables, each keyed by so many minima.
TABLES, MINIMA = 48, 6
_FACTORS, _OFFSETS = np.random.default_rng(20).integers(0, 2**32, (2, TABLES * MINIMA, 1), dtype=np.uint32) | np.array([1, 0], np.uint32)[:, None, None]


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a text, repeats included.

    A-Z are lower-cased; words are split at ASCII white space; a text of fewer words
    than ``width`` is one shingle, and one without words has none.
    """
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    if len(said) <= width:
        shingles = [b" ".join(said)]
    elif width == 3:
        shingles = [b"%b %b %b" % w for w in zip(said, said[1:], said[2:])]
    else:
        shingles = [b" ".join(w) for w in zip(*(said[i:] for i in range(width)))]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of ``shingle_hashes``, 64 bits; without words it is zero."""
    return _majority(shingle_hashes(text, width))


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """The MinHash keys of a shingle set, one for each of ``TABLES``.

    Two sets of Jaccard similarity J share one key at least with probability
    1 - (1 - J^6)^48: at 0.8 all but 5 in 10 million pairs do.
    """
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TABLES * MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024] * _FACTORS + _OFFSETS).min(axis=1), out=least)
    k = np.arange(TABLES, dtype=np.uint64)
    for x in least.reshape(TABLES, MINIMA).T.astype(np.uint64):
        k = (k ^ x) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
    return k


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64 for each word, lanes / 64): plane b holds bit b of every value, 64 values to a word."""
    values = values[:, None] if values.ndim == 1 else values
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    pad = -len(values) % 64
    bits = np.concatenate([bits, np.zeros((pad, bits.shape[1]), np.uint8)]) if pad else bits
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _shift(planes: np.ndarray, words: np.ndarray, by: int) -> np.ndarray:
    """Words ``words`` of every plane as they'd be after moving all lanes down by ``by``."""
    far, near = words + by // 64, by % 64
    n = planes.shape[-1]
    low = np.where(far < n, planes[..., np.minimum(far, n - 1)], np.uint64(0))
    if not near:
        return low
    high = np.where(far + 1 < n, planes[..., np.minimum(far + 1, n - 1)], np.uint64(0))
    return (low >> np.uint64(near)) | (high << np.uint64(64 - near))


def near_pairs(values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of one group whose values differ in ``radius`` bits or fewer.

    ``values`` has a column for each 64 bits.  ``group`` is sorted.  At distance d all lanes are compared with the lanes d
    further at once: the planes' differences are added into bitwise counters by
    carry-save addition, which stick when they pass the radius, and a block of lanes
    is abandoned once all of its counters have passed it.
    """
    n = len(values)
    if n < 2:
        return
    planes = planes_of(values)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    left = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # lanes of the group that follow each lane
    width = max(1, radius.bit_length())
    active_words = np.arange(planes.shape[1])
    for d in range(1, int(sizes.max())):
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[:n] = left >= d
        live = np.packbits(lanes, bitorder="little").view("<u8")
        words = active_words = active_words[live[active_words] != 0]
        over = ~live[words]
        counters = [np.zeros(len(words), np.uint64) for _ in range(width)]
        for b in range(len(planes)):
            carry = planes[b][words] ^ _shift(planes[b], words, d)
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            if radius + 1 < 1 << width:  # the counters can hold more than the radius
                over |= _above(counters, radius)
            if b % 8 == 7 and b + 1 < len(planes):
                blocks = np.add.reduceat(over != ~np.uint64(0), np.arange(0, len(over), _BLOCK)) > 0 if len(over) else np.zeros(0, bool)
                if not blocks.all():
                    keep = np.repeat(blocks, _BLOCK)[: len(over)]
                    words, over, counters = words[keep], over[keep], [c[keep] for c in counters]
                if not len(words):
                    break
        if len(words):
            ok = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").astype(bool)
            i = (words[:, None] * 64 + np.arange(64)).ravel()[ok]
            if len(i):
                yield i, i + d


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than ``radius``."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for c in reversed(range(len(counters))):
        if radius >> c & 1:
            same &= counters[c]
        else:
            more |= same & counters[c]
            same &= ~counters[c]
    return more


def links_of(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group: pairs of first words, at most one a value."""
    a, b, held = [], [], 0
    names = values[:, 0] if values.ndim > 1 else values
    for i, j in near_pairs(values, group, radius):
        a.append(names[i])
        b.append(names[j])
        held += len(i)
        if held > 4 * len(values) + 1_000_000:
            v, r = local_roots(np.concatenate(a), np.concatenate(b))
            a, b, held = [v], [r], len(v)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    v, r = local_roots(np.concatenate(a), np.concatenate(b))
    keep = v != r
    return v[keep], r[keep]


def _link_batches(radius: int, words: int = 1, lanes: int = 1 << 18):
    """Rows (k, f, ...) sorted by k, as streams: whole buckets are gathered up to ``lanes`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            same = np.zeros(len(k), bool)
            same[1:] |= k[1:] == k[:-1]
            same[:-1] |= k[1:] == k[:-1]
            a, b = links_of(f[same], k[same], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        ks, fs, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ks.append(batch.column(0).to_numpy())
            fs.append(np.stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(words)], axis=1))
            held += batch.num_rows
            if held >= lanes:
                k, f = np.concatenate(ks), np.concatenate(fs)
                end = int(np.searchsorted(k, k[-1]))  # the last bucket may go on
                if end:
                    yield links(k[:end], f[:end])
                ks, fs, held = [k[end:]], [f[end:]], 0
        if held:
            yield links(np.concatenate(ks), np.concatenate(fs))

    return run


def link_fingerprints(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints (column f) within ``radius`` bits.

    Any two such fingerprints end up in one component of the links; within a bucket
    only a spanning forest is returned.  Fingerprints that differ in 3 bits agree on
    3 of 6 blocks at least, so they meet in one of 20 tables keyed by three blocks
    (some 33 bits).  A bucket of more than ``bucket`` fingerprints is cut into pieces
    by hash, and each two pieces are compared in a task of their own, so that no
    task ever gathers more than two pieces: nothing is capped or skipped.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    keys = []
    for t, blocks in enumerate(combinations(range(6), 3)):
        keys.append(_key(t, [("f", _EDGES[b], _EDGES[b + 1] - _EDGES[b]) for b in blocks]))
    return _link_tables(prints, ["f"], keys, radius, bucket)


def similar_radius(similarity: float, bits: int) -> int:
    """Bits in which sets of this Jaccard similarity differ on average, and 1.9 deviations more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 1.9 * np.sqrt(bits * p * (1 - p)))


def link_similar(rows: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links (a, b) that join every two shingle sets which share a MinHash key and have this Jaccard similarity.

    ``rows`` has (d, h, s, n, keys): document, hash of its text, key and size of its
    shingle set, and MinHash keys; ``texts`` is (__tm_d, h, __tm_t).  Every link is
    verified on the whole sets.  First each set is compared with the smallest key of
    each of its buckets; then all pairs of a bucket that these links haven't joined
    are compared.  Nothing is capped or skipped.
    """
    whole = Window.partitionBy("k")
    met = rows.select("s", "n", F.explode("keys").alias("k")).withColumn("lo", F.min(F.struct("s", "n")).over(whole)).withColumn("hi", F.max("s").over(whole))
    met = stage(met.where("lo.s <> hi").select("k", "s", "n", F.col("lo.s").alias("lo"), F.col("lo.n").alias("lo_n")).distinct(), "minhash-met")
    of = rows.groupBy("s").agg(F.min(F.struct("d", "h")).alias("of")).join(met.select("s").distinct(), "s").select("s", F.col("of.d").alias("__tm_d"), F.col("of.h").alias("h"))
    found = texts.join(of, ["__tm_d", "h"]).select("s", "__tm_t")
    sets = stage(map_rows(found, ["s", "__tm_t"], lambda c: {"s": c["s"], "v": [_shingle_set(shingle_hashes(t, width)).view(np.int64) for t in c["__tm_t"]]}, "s long, v array<long>").dropDuplicates(["s"]), "minhash-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("s").alias("a"), F.col("v").alias("va")), "a").join(sets.select(F.col("s").alias("b"), F.col("v").alias("vb")), "b")
        c = F.size(F.array_intersect("va", "vb"))
        return stage(x.where(c / (F.size("va") + F.size("vb") - c) >= similarity).select("a", "b"), "minhash-links")

    likely = F.least("n", "lo_n") / F.greatest("n", "lo_n") >= similarity  # the sizes allow it
    links = verified(met.where("s <> lo").where(likely).select(F.col("s").alias("a"), F.col("lo").alias("b")).distinct())
    roots = connected_components(links)
    left = met.join(roots, F.col("s") == F.col("node"), "left").select("k", "s", "n", "lo", F.coalesce("root", "s").alias("c"))
    left = left.withColumn("c0", F.min("c").over(whole)).withColumn("c1", F.max("c").over(whole)).where("c0 <> c1 AND s <> lo").select("k", "s", "n", "c")
    left = stage(left, "minhash-left")
    other = left.select("k", *[F.col(x).alias(f"{x}2") for x in ("s", "n", "c")])
    pairs = left.join(other, "k").where("s < s2 AND c <> c2").where(F.least("n", "n2") / F.greatest("n", "n2") >= similarity)
    return links.unionByName(verified(pairs.select(F.col("s").alias("a"), F.col("s2").alias("b")).distinct()))


def _shingle_set(h: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; texts without words have one of their own."""
    return np.unique(h) if len(h) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def _key(table: int, slices: list[tuple[str, int, int]]) -> F.Column:
    k = F.lit(table).cast("long")
    for name, at, size in slices:
        k = F.shiftleft(k, size).bitwiseOR(F.shiftrightunsigned(F.col(name), at).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
    return k


def _link_tables(prints: DataFrame, cols: list[str], keys: list[F.Column], radius: int, bucket: int) -> DataFrame:
    """Compare all fingerprints that share a key; very large buckets in pieces, two by two."""
    banded = prints.select(*cols, F.explode(F.array(*keys)).alias("k"))
    hot = banded.groupBy("k").count().where(F.col("count") > bucket).select("k", F.ceil(F.col("count") * 2 / bucket).cast("int").alias("n"))
    hot = stage(hot, "hot")
    if hot.isEmpty():
        plain, pieces = banded, None
    else:
        plain = banded.join(hot, "k", "left_anti")
        c = F.pmod(F.xxhash64("f"), F.col("n"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1))
        pieces = banded.join(hot, "k").withColumn("c", c).withColumn("o", other)
        pieces = pieces.select(F.xxhash64("k", F.least("c", "o"), F.greatest("c", "o")).alias("k"), *cols)
    out = None
    for part in (plain, pieces):
        if part is not None:
            got = map_arrow(part.select("k", *cols).repartition("k").sortWithinPartitions("k"), _link_batches(radius, len(cols)), "a long, b long")
            out = got if out is None else out.unionByName(got)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float | None = 0.8, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per document: (id, text_hash, fingerprint long, class_print, component_id).

    With ``similarity``, documents are linked whose sets of ``width``-word shingles have
    that Jaccard similarity or more, computed on the whole sets; of pairs at 0.8, MinHash
    tables miss 5 in 10 million, and none is linked below it.  With None, those are linked, without
    exception, whose 64-bit fingerprints differ in ``radius`` bits or fewer, in buckets
    of ``bucket``.  ``component_id`` is the smallest id that links reach, and
    ``class_print`` stands for the component: its smallest fingerprint or, with
    ``similarity``, its smallest key of a shingle set.  Texts that are null, empty or
    blank have fingerprint zero and are linked like any other.  A null id takes part,
    orders last, and is returned as null (a component of null ids only has a null
    component_id).  Repeated rows each come back.  Copies count as one fingerprint, or
    set, throughout; only distinct ones are compared.
    """
    if similarity is not None and similarity < 0.8:
        raise ValueError("similarity is 0.8 or more: the MinHash tables are made for that")

    def prints(c):
        out = {"d": c["__tm_d"], "h": c["h"], "f": [fingerprint(t, width) for t in c["__tm_t"]]} if similarity is None else {"d": c["__tm_d"], "h": c["h"], "f": [], "s": [], "n": [], "keys": []}
        for t in c["__tm_t"] if similarity is not None else ():
            h = shingle_hashes(t, width)
            v = _shingle_set(h)
            out["f"].append(_majority(h))
            out["s"].append(xxhash.xxh64_intdigest(v.tobytes()))
            out["n"].append(len(v))
            out["keys"].append(table_keys(v).view(np.int64))
        return out | {x: np.array(out[x], np.uint64).view(np.int64) for x in ("f", "s") if x in out}

    base = keyed(docs, id_col, text_col).select("__tm_d", F.xxhash64("__tm_t").alias("h"), "__tm_t")
    rows = stage(map_rows(base, ["__tm_d", "h", "__tm_t"], prints, "d long, h long, f long" + (", s long, n int, keys array<long>" if similarity is not None else "")), "simhash")
    node = "f" if similarity is None else "s"
    nodes = stage(rows.groupBy(node).agg(F.min("d").alias("d")), "simhash-distinct")
    links = link_fingerprints(nodes.select("f"), radius, bucket) if similarity is None else link_similar(rows, base, similarity, width)
    roots = connected_components(links)
    held = nodes.join(roots, nodes[node] == roots["node"], "left").select(nodes[node], "d", F.coalesce("root", nodes[node]).alias("root"))
    held = stage(held, "simhash-roots")
    least = held.groupBy("root").agg(F.min("d").alias("component"))
    by_print = held.select(node, "root").join(least, "root")
    got = rows.select(*{"d": 0, "h": 0, "f": 0, node: 0}).join(by_print, node)
    return got.select(from_id(F.col("d")).alias(id_col), F.col("h").alias("text_hash"), F.col("f").alias("fingerprint"), F.col("root").alias("class_print"), from_id(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: that of the smallest id.

    Of several rows of that id the one of the smallest text hash stays; of rows that
    repeat it with the same text, any one.  All columns of ``docs`` are passed on.
    """
    names = docs.columns
    found = near_duplicates(docs, id_col, text_col, **options)
    found = found.select("class_print", F.coalesce(id_col, F.lit(NULL_ID)).alias("__tm_d"), F.col("text_hash").alias("__tm_h"))
    found = found.groupBy("class_print", "__tm_d", "__tm_h").agg(F.count("*").alias("__tm_n"))
    best = found.groupBy("class_print").agg(F.min(F.struct("__tm_d", "__tm_h", "__tm_n")).alias("b")).select("b.*")
    mine = docs.select(F.struct(*names).alias("__tm_r"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__tm_d"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__tm_h"))
    kept = mine.join(best, ["__tm_d", "__tm_h"])
    single = kept.where("__tm_n = 1")
    repeated = kept.where("__tm_n > 1").dropDuplicates(["__tm_d", "__tm_h"])
    return single.unionByName(repeated).select("__tm_r.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "documents"), width=3, similarity=None)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
