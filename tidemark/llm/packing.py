"""Best-fit packing of tokenised documents, planned over a histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import from_id, keyed, map_rows, read, stage

CAPACITY = 2048
#: Pieces of one length that are ranked in one group.
RANKED = 200_000


class Placement(NamedTuple):
    """Ranks [first, end) of a length go to sequences ``sequence``, ..., ``per`` to each, from ``offset``."""

    length: int
    first: int
    end: int
    sequence: int
    per: int
    offset: int


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Best-fit decreasing over (length, count): the placements and the number of sequences.

    Sequences with the same room are held as one run, and a run takes as many pieces
    at once as fit, so that the work and the plan's size depend on the capacity, not
    on the counts.  Best fit puts a piece where the least room is left; a sequence
    that has just taken one has less room still, so it goes on until it is full.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan: list[Placement] = []
    used = 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit a sequence of {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            per = room // length
            whole = min(n, left // per)
            if whole:
                plan.append(Placement(length, rank, rank + whole * per, first, per, capacity - room))
                add(room - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if whole < n:
                rest = left if left < per else 0
                if rest:
                    plan.append(Placement(length, rank, rank + rest, first + whole, rest, capacity - room))
                    add(room - rest * length, first + whole, 1)
                    rank, left = rank + rest, 0
                add(room, first + whole + (rest > 0), n - whole - (rest > 0))
    return plan, used


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all full but the first, which takes what is over."""
    n = len(ids)
    head = n % capacity or capacity
    starts = [0, *range(head, n, capacity)] if n > capacity else [0]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Staged pieces (d, u, piece, start, length, ids little-endian uint32) of every whole text.

    Each document ends with ``end_id``, so that a null or empty one has a single id.
    ``u`` numbers the pieces (place in a task, and the task); it is settled once staged.
    """

    def encode(cols):
        out = {k: [] for k in ("d", "u", "piece", "start", "length", "ids")}
        enc, task = tokens.encoder(path), TaskContext.get()
        for d, text in zip(cols["__tm_d"], cols["__tm_t"]):
            ids = np.append(enc.encode(text), np.uint32(end_id)).astype("<u4")
            for k, (start, n) in enumerate(cut(ids, capacity)):
                for name, x in zip(out, (d, _next(task), k, start, n, ids[start : start + n].tobytes())):
                    out[name].append(x)
        return {k: pa.array(v, type=pa.binary()) if k == "ids" else v for k, v in out.items()}

    return stage(map_rows(keyed(docs, id_col, text_col), ["__tm_d", "__tm_t"], encode, "d long, u long, piece int, start long, length int, ids binary"), "pieces")


_numbered: dict[int, int] = {}


def _next(task: TaskContext) -> int:
    """A number that no other piece has: the count of a task's pieces above its partition."""
    attempt = task.taskAttemptId()
    n = _numbered.get(attempt, 0)
    if not n:
        _numbered.clear()
    _numbered[attempt] = n + 1
    return task.partitionId() << 40 | n


def assign_slots(pieces: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """``pieces`` (with u, length) and the sequence_id and offset of each.

    The plan is made on the driver from at most ``capacity`` counts.  A piece's slot
    is found by its rank among the pieces of its length; lengths that many share are
    split by a hash of the piece's number u into groups of some ``ranked`` pieces, each
    ranked by itself from where the groups before it end, so that no length, nor any
    number of equal rows, is ever gathered in one task.
    """
    spark = pieces.sparkSession
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = plan_best_fit(counts, capacity)
    if not plan:
        return pieces.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    groups = spark.createDataFrame([(n, -(-c // ranked)) for n, c in counts.items()], "length int, groups int")  # at most capacity rows
    slots = spark.createDataFrame([tuple(map(int, p)) for p in plan], "length int, first long, end long, sequence long, per long, at long")  # bounded by the capacity
    marked = pieces.join(F.broadcast(groups), "length").withColumn("g", F.pmod(F.xxhash64("u"), F.col("groups")).cast("int")).drop("groups")
    sizes = marked.groupBy("length", "g").count()
    bases = sizes.select("length", "g", (F.sum("count").over(Window.partitionBy("length").orderBy("g")) - F.col("count")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "g").orderBy("u")) - 1
    local = marked.withColumn("local", rank)
    ranked_rows = local.join(bases, ["length", "g"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local", "g")
    p = slots.withColumnRenamed("length", "plan_length")
    placed = ranked_rows.join(F.broadcast(p), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    q = F.col("rank") - F.col("first")
    return placed.select(*pieces.columns, (F.col("sequence") + F.floor(q / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + q % F.col("per") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Whole texts are encoded and closed with ``end_id``; only documents longer than
    ``capacity`` are cut.  Null and empty texts are the end id alone; null ids are
    returned as null; repeated rows are packed each for itself; an empty table gives
    no rows.  Other columns of ``docs`` are left out.
    """
    pieces = token_pieces(docs, path, id_col, text_col, capacity, end_id)
    cols = ["d", "u", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * with_ids]
    slots = assign_slots(pieces.select(*cols), capacity)
    return slots.select(from_id(F.col("d")).alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of ``pack_documents(..., with_ids=True)``: the sequences themselves."""

    def join(cols):
        return {"sequence_id": cols["sequence_id"], "n_tokens": [sum(p["length"] for p in ps) for ps in cols["ps"]], "ids": [b"".join(bytes(p["ids"]) for p in sorted(ps, key=lambda p: p["offset"])) for ps in cols["ps"]]}

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "length", "ids")).alias("ps"))
    return map_rows(grouped, ["sequence_id", "ps"], join, "sequence_id long, n_tokens long, ids binary")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokens.default_path())
