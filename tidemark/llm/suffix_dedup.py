"""Removal of repeated byte strings by anchors, hashes and suffix arrays.

Two equal strings of ``width`` bytes have the same smallest hash of a ``gram``-byte
substring (winnowing: Schleimer and others, 2003).  So the windows of a text fall into
runs that share that anchor, equal windows meet under one anchor hash, and only
anchors that occur twice matter.  Of these, equal runs need no comparison; the distinct
runs of an anchor go to one shard, whose windows are sorted by hash; those with equal
hashes are compared byte by byte.  Should unequal ones share a hash, the shard's suffix
array (Larsson-Sadakane refinement) and common prefixes (Kasai) show which windows occur
twice.  An anchor with many distinct runs is spread over several shards, which meet two by
two; with very many, its windows are counted by their digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_id, keyed, map_arrow, read, stage

WIDTH, GRAM = 200, 32
#: Distinct runs of one anchor in a shard; more are spread over several shards.
SHARD_RUNS = 8192
#: Shards of one anchor up to which they are merged two by two.
MOST_SHARDS = 8
#: Bytes of the runs that make up a shard.
SHARD_BYTES = 1 << 21
_U = np.uint64


# --- anchors ---------------------------------------------------------------------


def gram_hashes(t: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place."""
    h = (t.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    step, factor = 1, 0x5851F42D4C957F2D
    while step < gram:
        h = h[:-step] * _U(factor) + h[step:]
        factor, step = factor * factor % 2**64, 2 * step
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def anchor_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the smallest of h[i : i + span], the leftmost of equal ones."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1

    def merge(by: int):
        right = value[by:] < value[:-by]
        return np.where(right, value[by:], value[:-by]), np.where(right, place[by:], place[:-by])

    while 2 * size <= span:
        value, place = merge(size)
        size *= 2
    if size < span:
        value, place = merge(span - size)
    return place


def runs_of(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first window, last window, anchor hash) of the texts t[starts[k] : ends[k]] on end."""
    if len(t) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    h = gram_hashes(t, gram)
    place = anchor_places(h, width - gram + 1)
    valid = np.zeros(len(place) + 1, np.int8)
    long = ends - starts >= width
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    p = place[windows]
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return windows[new], windows[np.concatenate([new[1:] - 1, [len(windows) - 1]])], h[p[new]]


# --- equal windows -----------------------------------------------------------------


def window_hashes(t: np.ndarray, width: int, block: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place, in blocks that stay in the cache."""
    n = len(t) - width + 1
    out = np.empty(max(n, 0), _U)
    half = 1 << (width.bit_length() - 1)  # two of these cover a window
    for at in range(0, n, block):
        g = gram_hashes(t[at : min(at + block, n) + width - 1], half)
        k = len(g) - (width - half)
        h = g[:k] * _U(0xD1342543DE82EF95) + g[width - half :]
        out[at : at + block] = h ^ (h >> _U(32))
    return out


def equal_windows(t: np.ndarray, at: np.ndarray, width: int, side: np.ndarray | None = None) -> np.ndarray | None:
    """Whether the ``width`` bytes from each of the places ``at`` are also those from another, of another side if sides are given.

    Windows are sorted by hash, and neighbours of one hash are compared byte by byte:
    None if any differ, as the hashes then don't tell.
    """
    hit = np.zeros(len(at), bool)
    if not len(at):
        return hit
    h = window_hashes(t, width)[at]
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    step = min(width, 8)
    if step == 8:
        t = np.ascontiguousarray(np.ndarray((len(t) - 7,), "<u8", np.ascontiguousarray(t), 0, (1,)))
    for k in [*range(0, width - step + 1, step), width - step] if step == 8 else range(width):
        if (t[a + k] != t[b + k]).any():
            return None
    if side is None:
        found = np.zeros(len(at), bool)
        found[1:] |= same
        found[:-1] |= same
    else:
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        sides = side[order]
        both = np.minimum.reduceat(sides, first) != np.maximum.reduceat(sides, first)
        found = np.repeat(both, np.diff(np.concatenate([first, [len(at)]])))
    hit[order[found]] = True
    return hit


# --- suffix arrays -----------------------------------------------------------------


def words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, big-endian; zeros follow the end."""
    w = np.zeros(len(t), _U)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    for j in range(8):
        w = (w << _U(8)) | padded[j : j + len(t)]
    return w


def suffix_array(t: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of all suffixes by Larsson-Sadakane refinement.

    Suffixes are sorted by their first 8 bytes; then, doubling the depth, each group
    that is still tied is sorted by the ranks of what follows, and only such groups.
    """
    n = len(t)
    words = words_at(t) if words is None else words
    sa = np.argsort(words, kind="stable")
    key = words[sa]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if n else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else group
    rank = np.empty(n, np.int64)
    rank[sa] = first[group]
    slots = np.arange(n)
    depth = 8
    while True:
        r = rank[sa[slots]]
        tied = np.zeros(len(slots), bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots, r = slots[tied], r[tied]
        if not len(slots):
            return sa, rank
        at = sa[slots]
        after = at + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(r * (n + 2) + follow, kind="stable")
        at, r2, follow = at[order], r[order], follow[order]
        sa[slots] = at
        new = np.concatenate([[True], (r2[1:] != r2[:-1]) | (follow[1:] != follow[:-1])])
        rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        depth *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, rank: np.ndarray, words: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order (Kasai and others).

    Texts are cut into lanes that advance side by side; each lane carries its common
    length, less one, from a suffix to the next.
    """
    n = len(t)
    out = np.zeros(n, np.int64)  # by place, then by rank
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    size = -(-n // lanes)
    i = np.arange(0, n, size)
    stop = np.minimum(i + size, n)
    length = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        a, b = i + length, j + length
        inside = (j >= 0) & (a < n) & (b < n)
        ca, cb = np.minimum(a, n - 1), np.clip(b, 0, n - 1)
        eight = inside & (words[ca] == words[cb]) & (a + 8 <= n) & (b + 8 <= n)
        one = inside & ~eight & (t[ca] == t[cb])
        length = length + np.where(eight, 8, one)
        over = ~(eight | one)
        out[i[over]] = length[over]
        length[over] = np.maximum(length[over] - 1, 0)
        i = i + over
        go = i < stop
        if not go.all():
            i, stop, length = i[go], stop[go], length[go]
    return out[sa]


def _compare(words_a: np.ndarray, a: np.ndarray, words_b: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """-1, 0, 1 as the ``width`` bytes from a in one text are below, equal to or above those from b in another."""
    out = np.zeros(len(a), np.int8)
    tied = np.arange(len(a))
    offsets = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    for k in offsets:
        x, y = words_a[np.minimum(a[tied] + k, len(words_a) - 1)], words_b[np.minimum(b[tied] + k, len(words_b) - 1)]
        out[tied] = np.where(x < y, -1, (x > y).astype(np.int8))
        tied = tied[x == y]
        if not len(tied):
            break
    return out


class Shard:
    """Distinct runs on end, each closed with a byte that UTF-8 lacks, and, where it is asked for, their suffix array."""

    def __init__(self, parts: list[bytes], width: int = WIDTH) -> None:
        self.width = width
        self.t = np.frombuffer(b"".join(x for p in parts for x in (p, b"\xff")), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.windows = sizes - width + 1

    @cached_property
    def words(self) -> np.ndarray:
        return words_at(self.t)

    @cached_property
    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        return suffix_array(self.t, self.words)

    @property
    def sa(self) -> np.ndarray:
        return self._order[0]

    @property
    def rank(self) -> np.ndarray:
        return self._order[1]

    def repeated(self) -> np.ndarray:
        """For each place whether a window from it also starts elsewhere in the shard."""
        at = self.places()
        if (equal := equal_windows(self.t, at, self.width)) is not None:
            hit = np.zeros(len(self.t), bool)
            hit[at] = equal
            return hit
        lcp = common_prefixes(self.t, self.sa, self.rank, self.words) >= self.width
        hit = np.zeros(len(self.t), bool)
        hit[self.sa[lcp]] = True
        hit[self.sa[:-1][lcp[1:]]] = True
        return hit

    def places(self) -> np.ndarray:
        """Where all windows start."""
        owner = np.repeat(np.arange(len(self.starts)), self.windows)
        return self.starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)

    def shared_with(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """For each place of either shard whether a window from it also starts in the other."""
        here, there = self.places(), other.places()
        both = np.concatenate([here, there + len(self.t)])
        equal = equal_windows(np.concatenate([self.t, other.t]), both, self.width, np.repeat(np.array([0, 1], np.int8), [len(here), len(there)]))
        if equal is None:
            return self.found_in(other), other.found_in(self)
        hits = np.zeros(len(self.t), bool), np.zeros(len(other.t), bool)
        hits[0][here], hits[1][there] = equal[: len(here)], equal[len(here) :]
        return hits

    def found_in(self, other: Shard) -> np.ndarray:
        """For each place whether a window from it also starts in another shard: a binary search in its suffix array."""
        hit = np.zeros(len(self.t), bool)
        q = self.places()
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(other.sa), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            above = _compare(self.words, q[live], other.words, other.sa[mid], self.width) > 0
            low[live] = np.where(above, mid + 1, low[live])
            high[live] = np.where(above, high[live], mid)
        at = np.minimum(low, len(other.sa) - 1)
        hit[q] = (low < len(other.sa)) & (_compare(self.words, q, other.words, other.sa[at], self.width) == 0)
        return hit

    def ranges(self, hit: np.ndarray) -> list[tuple[int, int, int]]:
        """The (run, first, last) windows of the stretches of hits."""
        at = self.places()
        valid = np.zeros(len(hit) + 2, np.int8)
        valid[at + 1] = hit[at]
        edge = np.diff(valid)  # bytes without a window lie between two runs
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        run = np.searchsorted(self.starts, first, "right") - 1
        return list(zip(run.tolist(), (first - self.starts[run]).tolist(), (last - self.starts[run]).tolist()))


# --- over documents -------------------------------------------------------------

_RUN = "d long, x long, m long, s long, a int, b int"


def _find_runs(width: int, gram: int, block: int = 1 << 18):
    """Documents (d, x, text) to their runs; long ones in blocks that overlap by a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, int, bytes]] = []
        held = 0

        def out() -> pa.RecordBatch:
            raw = b"".join(p[3] for p in parts)
            size = np.array([len(p[3]) for p in parts], np.int64)
            starts = np.cumsum(size) - size
            first, last, m = runs_of(np.frombuffer(raw, np.uint8), starts, starts + size, width, gram)
            owner = np.searchsorted(starts + size, first, "right")
            digest = xxhash.xxh3_64_intdigest
            s = np.fromiter((digest(raw[a : b + width]) for a, b in zip(first.tolist(), last.tolist())), _U, len(first))
            shift = starts[owner] - np.array([p[2] for p in parts], np.int64)[owner]
            cols = [np.array([p[0] for p in parts], np.int64)[owner], np.array([p[1] for p in parts], np.int64)[owner], m.view(np.int64), s.view(np.int64), (first - shift).astype(np.int32), (last - shift).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "x", "m", "s", "a", "b"])

        for batch in batches:
            for d, x, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < width:
                    continue
                for at in range(0, len(raw) - width + 1, block):
                    piece = raw[at : at + block + width - 1]
                    parts.append((d, x, at, piece))
                    held += len(piece)
                    if held >= block:
                        yield out()
                        parts, held = [], 0
        if parts:
            yield out()

    return run


def _zipped(docs: DataFrame, *more: str) -> DataFrame:
    """(d, x, z, ...): the texts compressed, for a shuffle, and other long columns."""
    names = ["d", "x", "z", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                z = [zip_.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, pa.binary()), *part.columns[3:]], names=names)

    return map_arrow(docs.select("d", "x", "t", *more), run, ", ".join(["d long, x long, z binary", *(f"{c} long" for c in more)]))


def _extract(width: int):
    """Rows (z, list of a, b, m, s, c, n) to one row a run, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        names = ["d", "x", "a", "m", "s", "c", "n", "t"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for d, x, z, wanted in zip(*(part.column(i).to_pylist() for i in range(4))):
                    raw = unzip.decompress(z)
                    rows += [(d, x, w["a"], w["m"], w["s"], w["c"], w["n"], raw[w["a"] : w["b"] + width]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)

    return run


def _search(width: int, size: int):
    """Rows (k, side, d, x, a, c, t) sorted by k and side to the repeated windows (d, x, a, b) of runs that occur once.

    Groups of side 2 are whole anchors or single shards of one: their windows are
    compared with each other, many groups at once.  Groups with sides 0 and 1 are two
    shards of one anchor, compared with one another.
    """
    names, types = ["d", "x", "a", "b"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def found(rows: list[tuple], shard: Shard, hit: np.ndarray) -> list[tuple]:
        return [(rows[k][2], rows[k][3], rows[k][4] + a, rows[k][4] + b) for k, a, b in shard.ranges(hit) if rows[k][5] == 1]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=names)

    def within(rows: list[tuple]) -> pa.RecordBatch:
        shard = Shard([r[6] for r in rows], width)
        return batch_of(found(rows, shard, shard.repeated()))

    def across(rows: list[tuple]) -> pa.RecordBatch:
        left, right = [r for r in rows if not r[1]], [r for r in rows if r[1]]
        a, b = Shard([r[6] for r in left], width), Shard([r[6] for r in right], width)
        in_a, in_b = a.shared_with(b)
        return batch_of(found(left, a, in_a) + found(right, b, in_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        ready: list[tuple] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal group, ready, held
            sides = {r[1] for r in group}
            if sides == {0, 1}:
                yield across(group)
            elif sides == {2} and len(group) > 1:
                ready += group
                held += sum(len(r[6]) for r in group)
                if held >= size:
                    yield within(ready)
                    ready, held = [], 0
            group = []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if group and row[0] != group[0][0]:
                    yield from close()
                group.append(row)
        yield from close()
        if ready:
            yield within(ready)

    return run


def _windows(width: int):
    """Rows (d, x, a, c, t) of runs to one row (d, x, a, c, u, v) a window, with a 128-bit digest in two halves."""
    names = ["d", "x", "a", "c", "u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(4).to_pylist()
                uv = np.frombuffer(b"".join([digest(t[k : k + width]) for t in texts for k in range(len(t) - width + 1)]), "<i8").reshape(-1, 2)
                each = np.array([len(t) - width + 1 for t in texts])
                d, x, a, c = (np.repeat(part.column(i).to_numpy(), each) for i in range(4))
                a += (np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (d, x, a, c, uv[:, 0].copy(), uv[:, 1].copy())], names=names)

    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_runs: int = SHARD_RUNS, shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS) -> DataFrame:
    """(d, x, a, b): stretches of windows of documents (d, x, text t) that also start elsewhere.

    Anchors of up to ``shard_runs`` distinct runs are compared in one shard, of up to
    ``most_shards`` times as many in shards that meet two by two.  Beyond that, pairs of
    shards would grow as the square: the windows of such an anchor's runs are counted by
    their digests, in rows that grow in proportion.
    """
    runs = stage(map_arrow(docs.select("d", "x", "t"), _find_runs(width, gram), _RUN), "runs")
    # small sides of joins are staged, so that AQE sees two exchanges and splits a hot anchor
    often = stage(runs.groupBy("m").count().where(F.col("count") > 1).select("m"), "often")
    shared = stage(runs.join(often, "m"), "shared-runs")
    # the distinct runs of each anchor, with one occurrence, how often each occurs, and how many there are
    distinct = shared.groupBy("m", "s").agg(F.count("*").alias("c"), F.min(F.struct("d", "x", "a", "b")).alias("r"))
    distinct = stage(distinct.select("m", "s", "c", "r.*"), "distinct-runs")
    whole = shared.join(distinct.where("c > 1").select("m", "s"), ["m", "s"]).select("d", "x", "a", "b")
    mixed = stage(distinct.groupBy("m").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 AND least = 1").select("m", "n"), "mixed")
    wanted = distinct.join(mixed, "m").groupBy("d", "x").agg(F.collect_list(F.struct("a", "b", "m", "s", "c", "n")).alias("w"))
    texts = _zipped(docs).join(wanted.hint("shuffle_hash"), ["d", "x"])
    got = stage(map_arrow(texts.select("d", "x", "z", "w"), _extract(width), "d long, x long, a int, m long, s long, c long, n long, t binary"), "run-bytes")
    plain = got.where(F.col("n") <= shard_runs).select(F.col("m").alias("k"), F.lit(2).alias("side"), "d", "x", "a", "c", "t")
    shards = F.ceil(F.col("n") / shard_runs)
    piece = got.where((F.col("n") > shard_runs) & (shards <= most_shards)).withColumn("p", F.pmod(F.col("s"), shards)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
    pieces = piece.select(F.xxhash64("m", F.least("p", "o"), F.greatest("p", "o")).alias("k"), F.when(F.col("p") == F.col("o"), 2).otherwise((F.col("p") > F.col("o")).cast("int")).alias("side"), "d", "x", "a", "c", "t")
    single = map_arrow(plain.unionByName(pieces).repartition("k").sortWithinPartitions("k", "side"), _search(width, shard_bytes), "d long, x long, a int, b int")
    out = whole.unionByName(single)
    hot = got.where(shards > most_shards).select("d", "x", "a", "c", "t")
    if not hot.isEmpty():
        windows = map_arrow(hot, _windows(width), "d long, x long, a int, c long, u long, v long")
        twice = stage(windows.groupBy("u", "v").count().where(F.col("count") > 1).select("u", "v"), "hot-windows")
        out = out.unionByName(windows.where("c = 1").join(twice, ["u", "v"]).select("d", "x", "a", F.col("a").alias("b")))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """(id, n_bytes, removed spans of bytes, kept bytes) of every document.

    Every byte that a ``width``-byte string covers which also starts anywhere else in
    the table, or elsewhere in the same text, goes; strings are judged on the input.
    Matches never cross documents.  Null and empty texts have no bytes; null ids are
    returned as null; rows that repeat an id and text repeat each other's bytes; an
    empty table gives no rows.  Other columns are left out.
    """
    # a row is known by 128 bits of its id and text
    base = keyed(docs, id_col, text_col).select(F.xxhash64("__tm_d", "__tm_t").alias("d"), F.xxhash64("__tm_t", "__tm_d").alias("x"), F.col("__tm_t").alias("t"), F.col("__tm_d").alias("i"))
    spans = stage(repeated_windows(base, width, **options).groupBy("d", "x").agg(F.collect_set(F.struct("a", "b")).alias("w")), "repeats")
    rows = _zipped(base, "i").join(spans.hint("shuffle_hash"), ["d", "x"], "left").select("i", "z", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), [[], [], [], []]
                for d, z, w in zip(*(part.column(i).to_pylist() for i in range(3))):
                    raw = unzip.decompress(z)
                    gone = _merge(w or [], width)
                    kept, last = [], 0
                    for a, b in gone:
                        kept.append(raw[last:a])
                        last = b
                    for o, v in zip(out, (d, len(raw), [{"start": a, "end": b} for a, b in gone], b"".join([*kept, raw[last:]]))):
                        o.append(v)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3], pa.binary())], names=["d", "n_bytes", "removed", "kept"])

    got = map_arrow(rows, cut, "d long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return got.select(from_id(F.col("d")).alias(id_col), "n_bytes", "removed", "kept")


def _merge(windows: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal byte spans [start, end) that the windows a to b cover."""
    out: list[list[int]] = []
    for a, b in sorted((w["a"], w["b"] + width) for w in windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
