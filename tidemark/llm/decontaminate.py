"""Removal of benchmark passages from training documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_arrow, map_rows, read, stage

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, letters and non-ASCII characters, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WindowIndex:
    """Hash set of benchmark windows, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int) -> None:
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        self.by_length: dict[int, dict[bytes, list[int]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words or item is None:
                continue
            at = len(self.items)
            self.items.append(str(item))
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int32)
            size = min(width, len(ids))
            table = self.by_length.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                owners = table.setdefault(ids[i : i + size].tobytes(), [])
                if not owners or owners[-1] != at:
                    owners.append(at)
        self.hashes = {n: np.unique(_hash(np.frombuffer(b"".join(t), np.int32).reshape(-1, n))) for n, t in self.by_length.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Mask of hit words (None: no hit), and the items (indexes) that occur."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        hit, found = None, set()
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, table in self.by_length.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(bad[n:] == bad[:-n])  # windows wholly of benchmark words
            if not len(starts):
                continue
            h = _hash(np.lib.stride_tricks.sliding_window_view(ids, n)[starts])
            known = self.hashes[n]
            starts = starts[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            for s in starts.tolist():
                owners = table.get(ids[s : s + n].tobytes())  # the exact check of a hash hit
                if owners:
                    if hit is None:
                        hit = np.zeros(len(ids), bool)
                    hit[s : s + n] = True
                    found.update(owners)
        return hit, found


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words [start, end) of each span and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def _scanner(held, text_at: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: WindowIndex = held.value
        for batch in batches:
            cols: list[list] = [[], [], []]
            for text in batch.column(text_at).to_pylist():
                words = words_of(text)
                mask, found = index.scan(words)
                cols[0].append(len(words))
                cols[1].append([] if mask is None else [{"first": a, "last": b - 1} for a, b in _runs(mask)])
                cols[2].append(sorted(index.items[i] for i in found))
            new = [pa.array(c, type=schema.field(len(schema) - 3 + i).type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=schema)

    return run


def _scan(docs: DataFrame, text_col: str, items: list[tuple], width: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, width))
    added = StructType.fromDDL("__tm_n long, __tm_s array<struct<first:int,last:int>>, __tm_i array<string>")
    schema = StructType(docs.schema.fields + added.fields)
    return map_arrow(docs, _scanner(held, docs.columns.index(text_col), to_arrow_schema(schema)), schema)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """``docs`` with n_words, hit_spans (first and last word of maximal hit runs) and items.

    A window is ``width`` consecutive words of an item; a shorter item, but not an
    empty one, is one window.  A hash set of the windows goes to every executor; hits
    are verified word by word.  Its size is checked first: a benchmark of more than
    ``block_words`` words is cut into blocks, each scanned in a pass of its own over
    all documents, whose rows are numbered for that, and the passes are merged.  Long
    items are cut into pieces that overlap by a window less a word, so that no block
    exceeds the bound.

    Null or empty texts have no words; null item ids are left out; items that repeat
    an id count once; an empty benchmark hits nothing.  Every column of ``docs`` is
    passed on (n_words, hit_spans, items and items' helper names are replaced);
    repeated rows each come back.
    """
    docs = docs.drop("n_words", "hit_spans", "items")
    names = docs.columns
    bench = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null")
    words = F.coalesce(F.octet_length("t"), F.lit(0)) / 2 + 1  # a word takes two bytes or more, with what follows it
    if (bench.agg(F.sum(words)).first()[0] or 0) <= block_words:
        scanned = _scan(docs, text_col, [tuple(r) for r in bench.collect()], width)
    else:
        tagged = stage(docs.withColumn("__tm_k", F.monotonically_increasing_id()), "decontaminate")  # numbers that are settled once staged
        both = None
        for block in _blocks(bench, width, block_words):
            one = _scan(tagged.select("__tm_k", text_col), text_col, [tuple(r) for r in block.collect()], width).drop(text_col)
            both = one if both is None else both.unionByName(one.where(F.size("__tm_s") > 0))
        merged = both.groupBy("__tm_k").agg(F.max("__tm_n").alias("__tm_n"), F.flatten(F.collect_list("__tm_s")).alias("__tm_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__tm_i")))).alias("__tm_i"))
        merged = map_rows(merged, ["__tm_k", "__tm_n", "__tm_s", "__tm_i"], lambda c: c | {"__tm_s": [_union_spans(s) for s in c["__tm_s"]]}, "__tm_k long, __tm_n long, __tm_s array<struct<first:int,last:int>>, __tm_i array<string>")
        scanned = tagged.join(merged, "__tm_k")
    return scanned.select(*names, F.col("__tm_n").alias("n_words"), F.col("__tm_s").alias("hit_spans"), F.array_distinct("__tm_i").alias("items"))


def _blocks(bench: DataFrame, width: int, block_words: int) -> Iterator[DataFrame]:
    """The items (i, t) in blocks of ``block_words`` words at most."""
    most = max(width, block_words // 16)

    def cut(c):
        out = {"i": [], "t": [], "n": []}
        for i, t in zip(c["i"], c["t"]):
            words = words_of(t)
            for at in range(0, len(words) - width + 1, most - width + 1) if len(words) > most else [0]:
                piece = words[at : at + most]
                out["i"].append(i)
                out["t"].append(b" ".join(piece).decode("utf-8", "surrogatepass"))
                out["n"].append(len(piece))
        return out

    pieces = stage(map_rows(bench.select(F.col("i").cast("string").alias("i"), "t"), ["i", "t"], cut, "i string, t string, n long").where("n > 0").distinct(), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    buckets = 64 * (-(-total // block_words)) or 1
    while True:
        bucket = F.pmod(F.xxhash64("i", "t"), F.lit(buckets))
        sizes = {r.b: r.n for r in pieces.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}  # 64 rows or so a block
        if max(sizes.values(), default=0) <= block_words:
            break
        buckets *= 4
    held, n = [], 0
    for b in sorted(sizes):
        if held and n + sizes[b] > block_words:
            yield pieces.where(bucket.isin(held)).select("i", "t")
            held, n = [], 0
        held.append(b)
        n += sizes[b]
    yield pieces.where(bucket.isin(held)).select("i", "t")


def _union_spans(spans):
    out: list[list[int]] = []
    for s in sorted((s["first"], s["last"]) for s in spans):
        if out and s[0] <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def hit_words() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "document", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without what the benchmark holds: whole documents, or the hit spans.

    ``action`` is "document" (rows with a hit go) or "span" (their hit words, and
    what stands between these, are cut out of the text).  Edge cases as in
    ``find_benchmark``; the columns are those of ``docs``.
    """
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("__tm_r"), F.col(text_col).alias("__tm_t"))
    found = find_benchmark(packed, benchmark, "__tm_t", **options)
    if action == "document":
        return found.where(F.size("hit_spans") == 0).select("__tm_r.*")
    if action == "span":
        text_at = names.index(text_col)
        schema = StructType([*docs.schema.fields[:text_at], StructField(text_col, StringType()), *docs.schema.fields[text_at + 1 :]])
        arrow = to_arrow_schema(schema)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [cut_words(t, [(x["first"], x["last"] + 1) for x in s]) if s else t for t, s in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:text_at], pa.array(new, pa.string()), *b.columns[text_at + 1 : len(names)]], schema=arrow)

        return map_arrow(found.select("__tm_r.*", "hit_spans"), cut, schema)
    raise ValueError(f"action is {action!r}, neither document nor span")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_benchmark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, n, s FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)"""
