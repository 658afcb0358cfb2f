"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document's units are its paragraphs (lines that aren't blank), long ones cut where
their content says so.  Every unit, with its occurrence number among equal units, has a
64-bit digest, and the document is the set of these digests.  A sketch of m cells holds
for each cell the count, the sum (xor) of the digests, and the sum of a check hash of
each.  Two sketches subtract cell by cell; peeling cells of a single digest recovers the
digests on either side.  If it gets stuck, both are sketched again with more cells.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, map_rows, read

#: Cells of the fingerprint itself; three hashes, a third of the cells to each.
CELLS = 24
#: Words to a unit on average, where a paragraph is cut.
UNIT_WORDS = 8
_HASHES = 3
_U = np.uint64


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(31)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def units(text: str | None) -> list[bytes]:
    """Paragraphs of a text, cut after words whose hash says so: an edit moves only nearby cuts."""
    out: list[bytes] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        start = 0
        for i, w in enumerate(words, 1):
            if not zlib.crc32(w) % UNIT_WORDS:
                out.append(b" ".join(words[start:i]))
                start = i
        if start < len(words):
            out.append(b" ".join(words[start:]))
    return out


def digests(text: str | None) -> np.ndarray:
    """The distinct 64-bit digests of a text's units, each with its occurrence number."""
    seen: dict[bytes, int] = {}
    out = []
    for u in units(text):
        k = seen.get(u, 0)
        seen[u] = k + 1
        out.append(xxhash.xxh64_intdigest(u, k))
    return np.unique(np.array(out, np.uint64))


class Sketches:
    """Sketches of many digest sets at once, all of one row in one flat array of cells."""

    def __init__(self, sets: list[np.ndarray], cells: np.ndarray) -> None:
        """``cells``: for each set its number of cells, a multiple of the number of hashes."""
        self.cells = cells.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.cells)])
        n = int(self.base[-1])
        self.count, self.total, self.check = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)
        keys = np.concatenate([np.zeros(0, _U), *sets])
        self.add(keys, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), 1)

    def add(self, keys: np.ndarray, row: np.ndarray, sign: np.ndarray | int) -> None:
        check = _mix(keys, 0x51ED270B)
        for at in self.places(keys, row):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.total, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def places(self, keys: np.ndarray, row: np.ndarray) -> Iterable[np.ndarray]:
        third = self.cells[row] // _HASHES
        for j in range(_HASHES):
            yield self.base[row] + j * third + (_mix(keys, 0xA0761D64 + j) % third.astype(_U)).astype(np.int64)

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.cells, out.base = self.cells, self.base
        out.count, out.total, out.check = self.count - other.count, self.total ^ other.total, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, digests, signs) recovered, and for each row whether nothing is left of it."""
        owner = np.repeat(np.arange(len(self.cells)), self.cells)
        got: list[tuple] = []
        look = np.arange(len(self.count))
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (_mix(self.total[look], 0x51ED270B) == self.check[look])]
            if not len(pure):
                break
            row, key = owner[pure], self.total[pure]
            first = np.unique(np.stack([row.astype(_U), key]), axis=1, return_index=True)[1]  # a digest may be alone in two cells
            row, key, sign = row[first], key[first], self.count[pure[first]]
            got.append((row, key, sign))
            self.add(key, row, -sign)
            look = np.unique(np.concatenate(list(self.places(key, row))))
        left = (self.count != 0) | (self.total != 0) | (self.check != 0)
        stuck = np.bincount(owner[left], minlength=len(self.cells)) > 0
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), ~stuck
        return *(np.concatenate(x) for x in zip(*got)), ~stuck


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(only in a, only in b) of each pair of digest sets, recovered by peeling.

    The first try takes sketches of ``cells`` cells.  Pairs whose peeling fails are
    sketched again, larger: with the cells that a difference of the failed size needs
    if few cells were full, else with what the two whole sets could need.
    """
    out: list = [None] * len(a)
    todo = np.arange(len(a))
    size = np.full(len(a), cells, np.int64)
    while len(todo):
        sk = Sketches([a[i] for i in todo], size).minus(Sketches([b[i] for i in todo], size))
        filled = np.add.reduceat(sk.count != 0, sk.base[:-1]) if len(todo) else np.zeros(0)
        row, key, sign, done = sk.peel()
        order = np.argsort(row, kind="stable")
        row, key, sign = row[order], key[order], sign[order]
        ends = np.searchsorted(row, np.arange(len(todo) + 1))
        for k in np.flatnonzero(done):
            ks, sg = key[ends[k] : ends[k + 1]], sign[ends[k] : ends[k + 1]]
            out[todo[k]] = (np.sort(ks[sg > 0]), np.sort(ks[sg < 0]))
        again = np.flatnonzero(~done)
        most = np.array([len(a[i]) + len(b[i]) for i in todo[again]], np.int64)
        grown = np.where(filled[again] * 10 < size[again] * 9, size[again] * 2, np.maximum(size[again] * 2, most * 2))
        todo, size = todo[again], -(-grown // _HASHES) * _HASHES
    return out


def fingerprint_of(keys: np.ndarray, sketch: Sketches, row: int) -> str:
    """Hex digits: number of digests, then each cell's count (mod 2^16), digest sum and check sum."""
    s = slice(int(sketch.base[row]), int(sketch.base[row + 1]))
    cells = np.rec.fromarrays([sketch.count[s].astype("<u2"), sketch.total[s].astype("<u8"), (sketch.check[s] & _U(0xFFFFFFFF)).astype("<u4")], names="c,t,k")
    return np.array([len(keys)], "<u4").tobytes().hex() + cells.tobytes().hex()


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Share of the digests of both sets that they have in common; two empty sets are alike."""
    out = []
    for x, y, (ox, oy) in zip(a, b, differences(a, b)):
        common = len(x) - len(ox)
        both = common + len(ox) + len(oy)
        out.append(common / both if both else 1.0)
    return out


def sketch_documents(texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
    """Digest sets and fingerprints of some texts."""
    sets = [digests(t) for t in texts]
    sk = Sketches(sets, np.full(len(sets), CELLS))
    return sets, [fingerprint_of(s, sk, i) for i, s in enumerate(sets)]


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; null and empty texts have that of the empty set.

    Equal texts have equal fingerprints; an existing column of that name is replaced.
    """
    docs = docs.drop("fingerprint")
    schema = StructType(docs.schema.fields + StructType.fromDDL("fingerprint string").fields)
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sketch_documents(part.column(at).to_pylist())[1], pa.string())], schema=arrow)

    return map_arrow(docs, run, schema)


def compare_versions(pairs: DataFrame, key_cols: list[str], old: str, new: str) -> DataFrame:
    """For each row of two versions of a text: ``removed`` and ``added`` digests (as longs), and ``likeness``."""
    schema = pairs.select(*key_cols).schema
    ddl = StructType(schema.fields + StructType.fromDDL("removed array<long>, added array<long>, likeness double").fields)
    def diff(c):
        a, b = [digests(t) for t in c[old]], [digests(t) for t in c[new]]
        got = differences(a, b)
        like = [(len(x) - len(o)) / max(1, len(x) + len(n)) if len(x) + len(n) else 1.0 for x, (o, n) in zip(a, got)]
        return {k: c[k] for k in key_cols} | {"removed": [o.view(np.int64) for o, _ in got], "added": [n.view(np.int64) for _, n in got], "likeness": like}

    return map_rows(pairs.select(*key_cols, old, new), [*key_cols, old, new], diff, ddl.simpleString()[7:-1].replace(":", " "))


# --- the next document --------------------------------------------------------

_NULL = -(2**63)


def _cuts(rows: DataFrame, range_rows: int, most: int = 1 << 14, each: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys (d, h) that end ranges of some ``range_rows`` rows, or as many more as make ``most`` ranges.

    Keys are sampled by their hash, ``each`` to a range, with the bytes they stand for;
    keys that hold a range's rows and more are all among them, so that they may end
    several ranges.  The driver gets ``each + 1`` times ``most`` rows at most or so.  The
    last key is the largest of all.
    """
    n = rows.count()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    per = max(range_rows, -(-n // most))
    one_in = max(1, per // each)
    counted = rows.groupBy("d", "h").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    some = counted.where((F.col("n") >= per) | (F.pmod(F.xxhash64("h", "d"), F.lit(one_in)) == 0)).select("d", "h", F.when(F.col("n") >= per, F.col("n")).otherwise(F.col("n") * one_in).alias("n"), "size")
    top = rows.agg(F.max(F.struct("d", "h")).alias("m")).select("m.*").first()
    got = sorted((r.d, r.h, r.n, r.size) for r in some.collect())
    d, h = (np.array([r[k] for r in got] + [top[k]], np.int64) for k in (0, 1))
    count = np.array([r[2] for r in got] + [0], np.float64)
    size = count * np.array([r[3] + 64 for r in got] + [0], np.float64)
    share = count / max(1.0, count.sum()) + size / max(1.0, size.sum())  # rows and bytes count alike
    upto = np.floor(np.cumsum(share) / 2 * max(1, n // per) + 1e-9).astype(np.int64)
    times = np.diff(np.concatenate([[0], upto]))
    times[-1] = max(1, times[-1])
    times = np.where(count >= per, times, np.minimum(times, 1))
    return np.repeat(d, times), np.repeat(h, times)


def map_with_next(docs: DataFrame, f: Callable[[list[int | None], list[str], list[str]], dict[str, list]], schema: str, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 512, batch: int = 256) -> DataFrame:
    """Apply ``f`` to ids, texts and the texts of the next documents by descending id.

    After the last document comes the first again.  Null ids order last; rows of one
    id are ordered by a hash of their text.  Null texts are empty.

    Rows are cut into ranges at keys (id, hash) that occur, of which a bounded sample
    goes to the driver, so the first row of each range is known: it also goes to the
    range before, to end it.  A key that very many rows repeat has ranges of its own,
    among which its rows are dealt out: each is followed by its like.  Each text is
    shuffled once, compressed, and those at the cuts once more a task; a task streams
    its sorted ranges and holds ``batch`` documents at a time.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    keys = _cuts(base.select("d", "h", F.octet_length("t").alias("size")), range_rows)
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        cuts = list(zip(*(k.tolist() for k in held.value)))  # range r: the keys above cuts[r - 1], to cuts[r]
        ends = {c: (bisect_left(cuts, c), bisect_right(cuts, c)) for c in set(cuts)}
        turns: dict[tuple, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out: list[tuple] = []
                for d, h, t in zip(*(part.column(i).to_pylist() for i in range(3))):
                    z = zip_.compress(t.encode("utf-8", "surrogatepass"))
                    first, last = ends.get((d, h), (None, None))
                    if first is None:
                        out.append((bisect_left(cuts, (d, h)), False, d, h, z))
                        continue
                    turn = turns.get((d, h), 0)
                    turns[d, h] = turn + 1
                    out.append((first + turn % (last - first), False, d, h, z))
                    if not turn:  # it also ends the range of the keys above it
                        out.append((last % len(cuts), True, d, h, z))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))], names=["r", "look", "d", "h", "z"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, now, last, ended = zstandard.ZstdDecompressor(), None, None, False
        cuts = list(zip(*(k.tolist() for k in held.value)))
        ds, texts, nexts = [], [], []

        def add(text: str) -> Iterator[pa.RecordBatch]:
            nonlocal ds, texts, nexts
            if last is not None:
                ds.append(last[0])
                texts.append(last[1])
                nexts.append(text)
                if len(ds) >= batch:
                    yield out()
                    ds, texts, nexts = [], [], []

        def out() -> pa.RecordBatch:
            got = f([None if d == _NULL else d for d in ds], texts, nexts)
            return pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in arrow], schema=arrow)

        for b in batches:
            for r, look, d, z in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if r != now:
                    if last is not None:  # a further range of a key: its last row is followed by its like
                        yield from add(last[1])
                    now, last, ended = r, None, False
                if look and (ended or (r and cuts[r] == cuts[r - 1])):
                    continue  # one row after the range counts, and none after a further range of a key
                text = unzip.decompress(z).decode("utf-8", "surrogatepass")
                yield from add(text)
                last, ended = (None, True) if look else ((d, text), False)
        if last is not None:
            yield from add(last[1])
        if ds:
            yield out()

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rows = map_arrow(base.select("d", "h", "t"), spread, "r int, look boolean, d long, h long, z binary")
    return map_arrow(rows.repartition("r").sortWithinPartitions("r", "look", F.desc("d"), F.desc("h")), pairs, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(ids, texts, nexts):
        new = [edited(t, n) for t, n in zip(texts, nexts)]
        own, prints = sketch_documents(texts)
        changed, new_prints = sketch_documents(new)
        following = [digests(n) for n in nexts]
        return {
            "doc_id": ids,
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
            "fingerprint": prints,
            "edited_fingerprint": new_prints,
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, following),
        }

    return map_with_next(read(spark, sf_dir, "documents"), rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
