"""Content-addressed store of token ids: unique chunks, document recipes, Merkle manifests.

Layout of a store folder:

``rows/``      of kind "chunk", one row per distinct chunk: digest (SHA-256), n ids, payload,
               and its place (doc, text_hash, k) if it is known to be used only there;
               of kind "doc", the recipes as they were cut, before they are ordered
``recipes/``   one row per document, range-sorted by id: part, pos, doc, text_hash,
               n_tokens, local_start, digests, sizes, again (a repeated id and text)
``manifest/``  one row per part of the recipes: n_docs, n_tokens, base (ids of all
               parts before it), Merkle root; and the root over all parts (part -1)

A chunk's payload is its ids as little-endian unsigned integers of 2 bytes (4 where an
id needs them), behind a format byte; Parquet compresses pages of them together.  The
digest is that of the ids as little-endian unsigned 32-bit integers, so it doesn't depend
on the payload.
"""

from __future__ import annotations

import gc
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import compute as pc

from . import tokens
from .common import from_id, keyed, map_arrow, map_rows, read, shared_dir

LEAST, MEAN, MOST, WINDOW = 128, 512, 2048, 16


def cut_points(ids: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST, window: int = WINDOW) -> list[int]:
    """Ends of the content-defined chunks of an id stream.

    A rolling hash of the last ``window`` ids ends a chunk where its low bits are zero
    (one place in ``mean - least`` or so, ``least`` ids at least, ``most`` at most); a
    change moves only the cuts near it.
    """
    n = len(ids)
    ends: list[int] = []
    at = 0
    if n > least:
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step, factor = 1, 0x5851F42D4C957F2D
        while step < window:  # the hash of twice as many ids from two that adjoin
            h[step:] = h[step:] + h[:-step] * np.uint64(factor)
            factor, step = factor * factor % 2**64, step * 2
        h ^= h >> np.uint64(32)
        where = np.flatnonzero(h % np.uint64(max(1, mean - least)) == 0) + 1
        for p in where.tolist():
            while p - at > most:
                at += most
                ends.append(at)
            if p - at >= least:
                at = p
                ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def pack_ids(ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


# --- crc32 of joined chunks -------------------------------------------------


@lru_cache(1)
def _shift_tables(powers: int = 40) -> np.ndarray:
    """[k][byte][value]: how a crc32 register's bytes move past 2^k zero bytes."""
    step = [0xEDB88320] + [1 << b for b in range(31)]  # one zero bit
    for _ in range(3):
        step = [_times(step, r) for r in step]
    out = np.zeros((powers, 4, 256), np.uint32)
    for k in range(powers):
        for byte in range(4):
            for b in range(8):
                out[k, byte, 1 << b : 2 << b] = out[k, byte, : 1 << b] ^ np.uint32(step[8 * byte + b])
        step = [_times(step, r) for r in step]
    return out


def _times(matrix: list[int], v: int) -> int:
    x = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            x ^= row
        v >>= 1
    return x


def crc32_joined(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each run of strings on end, from the crc32 and length of each string.

    ``first``: where each run begins.  A string's part in the result is its crc32 moved
    past the bytes that follow it in its run.
    """
    crc = crc.astype(np.uint32)
    total = np.add.reduceat(n_bytes, first)
    upto = np.cumsum(n_bytes)
    runs = np.diff(np.concatenate([first, [len(crc)]]))
    after = np.repeat(upto[first] - n_bytes[first] + total, runs) - upto
    for k, t in enumerate(_shift_tables()):
        at = np.flatnonzero(after >> k & 1)
        if len(at):
            v = crc[at]
            crc[at] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return np.bitwise_xor.reduceat(crc, first)


# --- Merkle trees -------------------------------------------------------------


def leaf(doc: int, text_hash: int, sizes: list[int], digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\0" + struct.pack("<qqq", doc, text_hash, len(sizes)) + struct.pack(f"<{len(sizes)}q", *sizes) + b"".join(digests)).digest()


class Tree:
    """A Merkle root of leaves that come one by one, in memory of log2 of their number."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, bytes]] = []

    def add(self, digest: bytes) -> None:
        level = 0
        while self.parts and self.parts[-1][0] == level:
            digest, level = hashlib.sha256(b"\1" + self.parts.pop()[1] + digest).digest(), level + 1
        self.parts.append((level, digest))

    def root(self) -> bytes:
        parts = [d for _, d in self.parts]
        if not parts:
            return hashlib.sha256(b"").digest()
        while len(parts) > 1:
            parts[-2:] = [hashlib.sha256(b"\1" + parts[-2] + parts[-1]).digest()]
        return parts[0]


# --- writing --------------------------------------------------------------------

_ROWS = "kind string, key long, digest binary, n int, payload binary, doc long, text_hash long, k int, digests array<binary>, sizes array<int>"


def _encode(path: str, end_id: int, held: int = 1 << 17):
    """Documents to recipe rows, a row with its place for each chunk that is new to the task, and a bare one when it comes again."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, twice = tokens.encoder(path), set(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {f.name: [] for f in schema}
                add = lambda **x: [out[k].append(x.get(k)) for k in out]
                for doc, h, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    ids = np.append(enc.encode(text), np.uint32(end_id)).astype("<u4")
                    digests, sizes, start = [], [], 0
                    for end in cut_points(ids):
                        chunk = ids[start:end]
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in seen:
                            if len(seen) >= held:  # forgetting costs a copy in the shuffle, nothing else
                                seen.clear()
                                twice.clear()
                            seen.add(digest)
                            add(kind="chunk", key=int.from_bytes(digest[:8], "little", signed=True), digest=digest, n=len(chunk), payload=pack_ids(chunk), doc=doc, text_hash=h, k=len(sizes))
                        elif digest not in twice:
                            twice.add(digest)
                            add(kind="again", key=int.from_bytes(digest[:8], "little", signed=True), digest=digest)
                        digests.append(digest)
                        sizes.append(end - start)
                        start = end
                    add(kind="doc", key=h ^ doc, doc=doc, text_hash=h, digests=digests, sizes=sizes)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return run


def _first_of_each(most: int):
    """One row of each chunk, with its place if no other row has its digest, and all recipes.

    All rows of a digest are in one partition.  It is held back, up to ``most`` bytes;
    chunks that are given out before its end lose their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        twice: set[bytes] = set()
        given: set[bytes] = set()
        held: list[tuple[pa.RecordBatch, list]] = []
        size = 0

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            for batch, digests in held:
                keep, shared = [], []
                for d, chunk in zip(digests, batch.column("payload").is_valid().to_pylist()):
                    keep.append(d is None or chunk and d not in given)
                    shared.append(d is not None and (not last or d in twice))
                    if chunk:
                        given.add(d)
                shared = pa.array(shared)
                columns = [pc.if_else(shared, pa.scalar(None, c.type), c) if name in ("doc", "text_hash", "k") else c for name, c in zip(batch.schema.names, batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))
            held.clear()

        for batch in batches:
            digests = batch.column("digest").to_pylist()
            for d in digests:
                if d is not None:
                    (twice if d in seen else seen).add(d)
            held.append((batch, digests))
            size += batch.nbytes
            if size >= most:
                yield from give(False)
                size = 0
        yield from give(True)

    return run


def write_store(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, held_bytes: int = 1 << 26) -> None:
    """Write the ids of every whole text, each closed with ``end_id``, as a store in ``folder``.

    One shuffle carries each task's new chunks, by digest, and the recipes; a chunk
    that many documents share comes once from each task, so no key is hot.  Chunks of
    partitions over ``held_bytes`` may be stored without their place, which costs the
    reader a second shuffle of them and nothing else.  Null and
    empty texts are the end id alone; null ids order last; repeated rows have a recipe
    each; an empty table makes a store without rows.
    """
    base = keyed(docs, id_col, text_col).select("__tm_d", F.xxhash64("__tm_t").alias("h"), "__tm_t")
    rows = map_arrow(base, _encode(path, end_id), _ROWS)
    rows = map_arrow(rows.repartition("key"), _first_of_each(held_bytes), _ROWS)
    rows.drop("key").write.option("compression", "zstd").parquet(f"{folder}/rows")
    spark = docs.sparkSession
    every = spark.read.schema("digest binary, n int, payload binary, doc long, text_hash long, digests array<binary>, sizes array<int>, kind string").parquet(f"{folder}/rows")
    recipes = every.where("kind = 'doc'").select("doc", "text_hash", "digests", "sizes").repartitionByRange("doc", "text_hash").sortWithinPartitions("doc", "text_hash")
    recipes = map_arrow(recipes, _number, _RECIPE)
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _manifest(spark, folder).coalesce(1).write.parquet(f"{folder}/manifest")


_RECIPE = "part int, pos long, doc long, text_hash long, n_tokens long, local_start long, digests array<binary>, sizes array<int>, again boolean"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, length and start (within the part) of each recipe of a sorted part, and whether it repeats the one before."""
    from pyspark import TaskContext

    part, pos, start, before = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        n = np.array([sum(s) for s in batch.column(3).to_pylist()], np.int64)
        starts = start + np.cumsum(n) - n
        k = batch.num_rows
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        again = [a == b for a, b in zip([before, *keys], keys)]
        before = keys[-1] if keys else before
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, part, np.int32)), pa.array(np.arange(pos, pos + k)), batch.column(0), batch.column(1), pa.array(n), pa.array(starts), batch.column(2), batch.column(3), pa.array(again, pa.bool_())],
            names=["part", "pos", "doc", "text_hash", "n_tokens", "local_start", "digests", "sizes", "again"],
        )
        pos, start = pos + k, start + int(n.sum())


def _roots(leaves: DataFrame) -> DataFrame:
    """Rows (part, pos, leaf, n_tokens): the Merkle root of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, docs, n = None, Tree(), 0, 0
        out: list[tuple] = []
        for batch in batches:
            for part, lf, k in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if part != now:
                    if docs:
                        out.append((now, docs, n, tree.root()))
                    now, tree, docs, n = part, Tree(), 0, 0
                tree.add(lf)
                docs, n = docs + 1, n + k
        if docs:
            out.append((now, docs, n, tree.root()))
        for r in out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), pa.array([r[1]], pa.int64()), pa.array([r[2]], pa.int64()), pa.array([r[3]], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    return map_arrow(leaves.repartition("part").sortWithinPartitions("part", "pos"), run, "part int, n_docs long, n_tokens long, root binary")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    def leaves(c):
        return {"part": c["part"], "pos": c["pos"], "leaf": [leaf(*x) for x in zip(c["doc"], c["text_hash"], c["sizes"], c["digests"])], "n_tokens": c["n_tokens"]}

    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    parts = _roots(map_rows(recipes, ["part", "pos", "doc", "text_hash", "sizes", "digests", "n_tokens"], leaves, "part int, pos long, leaf binary, n_tokens long"))
    rows = sorted(tuple(r) for r in parts.collect())  # one row for each part, as many as the write had tasks
    out, base, tree = [], 0, Tree()
    for part, docs, n, root in rows:
        out.append((part, docs, n, base, root))
        base += n
        tree.add(bytes(root))
    out.append((-1, sum(r[1] for r in rows), base, 0, tree.root()))
    return spark.createDataFrame(out, "part int, n_docs long, n_tokens long, base long, root binary")


# --- reading --------------------------------------------------------------------


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    schema = "digest binary, n int, payload binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/rows").where("kind = 'chunk'").select("digest", "n", "payload")


def checked_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, crc) of every stored chunk, unpacked and held against its digest."""

    def check(c):
        out = []
        for digest, n, payload in zip(c["digest"], c["n"], c["payload"]):
            ids = unpack_ids(payload)
            if len(ids) != n or hashlib.sha256(ids).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            out.append(zlib.crc32(ids))
        return {"digest": c["digest"], "n": c["n"], "crc": out}

    return map_rows(_chunks(spark, folder), ["digest", "n", "payload"], check, "digest binary, n int, crc long", rows=2048)


def _uses(spark: SparkSession, folder: str) -> DataFrame:
    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    return recipes.select("part", "pos", "doc", "text_hash", "local_start", F.posexplode("digests").alias("k", "digest"))


def _joined(doc: int | None, chunks: list[dict]) -> tuple[list[np.ndarray], list[bytes]]:
    """The chunks of a document in order, each held against its digest, and the digests."""
    out, digests = [], []
    for x in sorted(chunks, key=lambda x: x["k"]):
        ids = unpack_ids(x["payload"]) if x["payload"] is not None else None
        if ids is None or hashlib.sha256(ids).digest() != x["digest"]:
            raise ValueError(f"a chunk of document {doc} is missing or damaged")
        out.append(ids)
        digests.append(x["digest"])
    return out, digests


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text_hash, k, payload) in order to (doc, text_hash, n_tokens, crc, leaf) of every document."""
    names, types = ["doc", "text_hash", "n_tokens", "crc", "leaf"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    now, last, crc, sizes, digests = None, -1, 0, [], []
    out: list[tuple] = []

    def given() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=names)
        out.clear()
        return got

    for batch in batches:
        for doc, h, k, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (doc, h) != now:
                if now:
                    out.append((*now, sum(sizes), crc, leaf(*now, sizes, digests)))
                now, last, crc, sizes, digests = (doc, h), -1, 0, [], []
            if k != last:
                ids = unpack_ids(payload)
                crc = zlib.crc32(ids, crc)
                sizes.append(len(ids))
                digests.append(hashlib.sha256(ids).digest())  # a damaged or missing chunk changes the leaf, and so the root
                last = k
        yield given()
    if now:
        out.append((*now, sum(sizes), crc, leaf(*now, sizes, digests)))
    yield given()


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    """(part, pos, doc, local_start, n_tokens, crc, leaf) of every document, its ids put together again from its chunks.

    A chunk that is used once goes straight to its document; others are looked up by
    digest first.  A repeated id and text is put together once.
    """
    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    chunks = spark.read.schema("kind string, digest binary, payload binary, doc long, text_hash long, k int").parquet(f"{folder}/rows").where("kind = 'chunk'")
    uses = recipes.where("again IS NULL OR NOT again").select("doc", "text_hash", F.posexplode("digests").alias("k", "digest"))
    shared = uses.join(chunks.where("k IS NULL").select("digest", "payload"), "digest")
    columns = ["doc", "text_hash", "k", "payload"]
    every = chunks.where("k IS NOT NULL").select(columns).unionByName(shared.select(columns))
    ordered = every.repartition("doc", "text_hash").sortWithinPartitions("doc", "text_hash", "k")
    built = map_arrow(ordered, _streams, "doc long, text_hash long, n_tokens long, crc long, leaf binary")
    found = recipes.select("part", "pos", "doc", "text_hash", "local_start").join(built, ["doc", "text_hash"], "left")
    # a document without any chunk has a leaf that no manifest holds
    return found.select("part", "pos", "doc", "local_start", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "crc", F.coalesce("leaf", F.lit(b"")).alias("leaf"))


def read_index(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document, from the stored files.

    With ``whole`` each document's id stream is put together again from its chunks, whose
    digests are taken anew for the leaves, and so is its crc32.  Without, each stored chunk is
    checked once, and a document's crc32 is computed from those of its chunks.  Either way
    every Merkle root, over leaves rebuilt from what was read, is held against the
    manifest; a missing or damaged chunk, recipe or part raises.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    uses = _uses(spark, folder)
    group = ["part", "pos", "doc", "text_hash", "local_start"]
    schema = "part int, pos long, doc long, local_start long, n_tokens long, crc long, leaf binary"

    def join(c):
        out = {k: c[k] for k in ("part", "pos", "doc", "local_start")} | {"n_tokens": [], "leaf": []}
        crc, size, first = [], [], []
        for doc, h, cs in zip(c["doc"], c["text_hash"], c["cs"]):
            cs.sort(key=lambda x: x["k"])
            sizes = [x["n"] for x in cs]
            if None in sizes:
                raise ValueError(f"a chunk of document {doc} is missing")
            first.append(len(crc))
            crc += [x["crc"] for x in cs]
            size += sizes
            out["n_tokens"].append(sum(sizes))
            out["leaf"].append(leaf(doc, h, sizes, [x["digest"] for x in cs]))
        out["crc"] = crc32_joined(np.array(crc, np.int64), 4 * np.array(size, np.int64), np.array(first)).tolist() if crc else []
        return out

    if whole:
        built = _whole(spark, folder)
    else:
        chunks = checked_chunks(spark, folder).select(F.col("digest").alias("held"), "n", "crc")
        found = uses.join(chunks, uses["digest"] == chunks["held"], "left").groupBy(*group).agg(F.collect_list(F.struct("k", "digest", "n", "crc")).alias("cs"))
        built = map_rows(found, [*group, "cs"], join, schema)
    built_path = f"{folder}/read-{uuid.uuid4().hex[:8]}"
    built.write.option("compression", "zstd").parquet(built_path)
    built = spark.read.schema(built.schema).parquet(built_path)
    roots = _roots(built.select("part", "pos", "leaf", "n_tokens")).withColumnsRenamed({"n_docs": "d", "n_tokens": "t", "root": "r"})
    held = manifest.where("part >= 0")
    differ = held.join(roots, "part", "full").where(~(F.col("root").eqNullSafe(F.col("r")) & F.col("n_docs").eqNullSafe(F.col("d")) & F.col("n_tokens").eqNullSafe(F.col("t"))))
    bad = [r.part for r in differ.select("part").limit(5).collect()]
    if bad:
        raise ValueError(f"parts {bad} don't match the manifest")
    bases = F.broadcast(held.select("part", "base"))  # one row for each part
    out = built.join(bases, "part")
    return out.select("doc", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, text_hash, ids little-endian uint32) of every document, put together again from its chunks."""
    whole = _uses(spark, folder).join(_chunks(spark, folder), "digest", "left").groupBy("part", "pos", "doc", "text_hash").agg(F.collect_list(F.struct("k", "digest", "payload")).alias("cs"))

    def join(c):
        return {"doc": c["doc"], "text_hash": c["text_hash"], "ids": [b"".join(x.tobytes() for x in _joined(doc, cs)[0]) for doc, cs in zip(c["doc"], c["cs"])]}

    return map_rows(whole, ["doc", "text_hash", "cs"], join, "doc long, text_hash long, ids binary", rows=64).select(from_id(F.col("doc")).alias("doc"), "text_hash", "ids")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex[:10]}"
    write_store(read(spark, sf_dir, "documents"), tokens.default_path(), folder)
    # the writing's shuffle files go with the plans that refer to them: now, not whenever the driver's heap is full
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return read_index(spark, folder).select(from_id(F.col("doc")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
