"""Conversations rebuilt from quotations: quoted passages are linked to the messages they come from.

A line's quote level is the number of ``>`` marks that lead it (``> >`` and ``>>`` alike).
A passage is a run of lines of one level; "so-and-so wrote:" lines that introduce one are
not part of the author's own text.  Passages and messages are normalised (letters and
digits, lower case, single spaces), and a passage is linked through hashes of its
``window``-word shingles to the earlier message that holds the most of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, map_rows, read, stage

#: Words of a shingle; similarity a passage needs with its message (share of its shingles).
WINDOW, SIMILAR = 5, 0.8
_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"(?:\bwrote|\bwrites|\bschrieb|\ba écrit|\bescribió)\b[^\n]{0,80}:[ \t]*$")
_WORD = re.compile(r"[^\W_]+")


def levels(text: str | None) -> list[tuple[int, str]]:
    """Passages (level, text without marks) of a message; level 0 is its author's own."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = _MARK.match(line)
        level = m.group(1).count(">") if m else 0
        rest = line[m.end() :] if m else line
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(rest)
    return [(k, "\n".join(lines)) for k, lines in out]


def own_text(text: str | None) -> str:
    """A message without its quotations and the lines that introduce them."""
    if not text or ">" not in text:
        return text or ""
    parts = levels(text)
    kept = []
    for i, (level, passage) in enumerate(parts):
        if level:
            continue
        kept.append(_without_intro(passage) if i + 1 < len(parts) else passage)
    return "\n".join(kept).strip("\n")


def _without_intro(passage: str) -> str:
    """A passage that a quotation follows, without the line that introduces it."""
    lines = passage.rstrip().split("\n")
    return "\n".join(lines[:-1]) if _INTRO.search(lines[-1]) else passage


def shingles(text: str, width: int = WINDOW) -> list[int]:
    """Signed 64-bit hashes of the distinct word shingles of a normalised text (fewer words: all of them)."""
    words = [w.lower() for w in _WORD.findall(text)]
    if not words:
        return []
    parts = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return [x - (1 << 64) if x >> 63 else x for x in sorted(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts)]


_PARSED = "c long, t long, p int, level int, kind int, w int, s long, hs array<long>"


def _parse(width: int):
    """Messages (c, t, text) to their quoted passages (kind 1, at their own width w) and, always, their own text (kind 0).

    ``s`` stands for what a passage or message says: equal ones have one.
    """

    def f(cols):
        out = {k: [] for k in ("c", "t", "p", "level", "kind", "w", "s", "hs")}

        def add(*row):
            for k, v in zip(out, row):
                out[k].append(v)

        for c, t, text in zip(cols["c"], cols["t"], cols["x"]):
            own = _normal(own_text(text))
            add(c, t, -1, 0, 0, 0, _digest(own), None)
            if text and ">" in text:
                parts = levels(text)
                for p, (level, passage) in enumerate(parts):
                    if level and p + 1 < len(parts) and parts[p + 1][0] > level:
                        passage = _without_intro(passage)
                    if level and (said := _normal(passage)):
                        w = min(width, said.count(" ") + 1)
                        add(c, t, p, level, 1, w, _digest(said), shingles(said, w))
        return out

    return f


def _normal(text: str) -> str:
    return " ".join(w.lower() for w in _WORD.findall(text))


def _digest(said: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass"))).view(np.int64))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", across: bool = False, width: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """(c, t, p, level, to_c, to_t, share): each quoted passage and the message it is linked to.

    The message is an earlier one (of the same conversation, or with ``across`` of any,
    ordered by conversation and turn) whose own text holds ``similar`` or more of the
    passage's shingles; of several the one with the largest share, then the latest.  A
    passage of fewer words than ``width`` is one shingle of that many words.

    What a conversation says more than once is compared once: passages and messages are
    reduced to distinct texts.  A message that holds ``similar`` of n shingles holds one at
    least of any n - ceil(similar n) + 1, so only the rarest so many of each passage, by
    how many of the messages have them, are looked up; the candidates are verified on
    whole sets.  Only shingles that some passage has are ever shuffled.  The latest earlier
    message is found by an ordered pass over the turns that say the same.
    """
    base = messages.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.col(text_col).cast("string").alias("x")).where("c IS NOT NULL AND t IS NOT NULL")
    parsed = stage(map_rows(base, ["c", "t", "x"], _parse(width), _PARSED), "quotes")
    g = F.lit(0).cast("long") if across else F.col("c")  # what is compared
    quotes = parsed.where("kind = 1").withColumn("g", g)
    sets = stage(quotes.groupBy("g", "w", "s").agg(F.first("hs").alias("hs")), "quote-sets")
    wanted = stage(sets.select("w", F.explode("hs").alias("h")).distinct() if across else sets.select("g", "w", F.explode("hs").alias("h")).distinct(), "quote-shingles")
    if wanted.isEmpty():
        return quotes.limit(0).select("c", "t", "p", "level", F.col("c").alias("to_c"), F.col("t").alias("to_t"), F.lit(0.0).alias("share"))
    said = parsed.where("kind = 0").withColumn("g", g)
    spoken = stage(said.groupBy("g", "s").agg(F.min(F.struct("c", "t")).alias("of")).select("g", "s", F.col("of.c").alias("c"), F.col("of.t").alias("t")), "spoken")
    texts = base.join(spoken, ["c", "t"]).join(quotes.select("g").distinct(), "g", "left_semi").select("g", "s", "x")

    def held(cols):
        out = {"g": [], "m": [], "w": [], "h": []}
        for i, s, x in zip(cols["g"], cols["s"], cols["x"]):
            own = _normal(own_text(x))
            if _digest(own) != s:  # another text of a repeated turn
                continue
            for w in range(1, width + 1):
                hs = shingles(own, w) if own.count(" ") + 1 >= w and own else []
                out["g"] += [i] * len(hs)
                out["m"] += [s] * len(hs)
                out["w"] += [w] * len(hs)
                out["h"] += hs
        return out

    widths = [r.w for r in quotes.select("w").distinct().collect()]  # width at most
    spread = map_rows(texts, ["g", "s", "x"], held, "g long, m long, w int, h long", rows=32).where(F.col("w").isin(widths))
    own = stage(spread.join(wanted, ["w", "h"] if across else ["g", "w", "h"], "left_semi").distinct(), "own-shingles")
    often = own.groupBy("g", "w", "h").agg(F.count("*").alias("n"))
    terms = sets.select("g", "w", "s", F.size("hs").alias("k"), F.explode("hs").alias("h")).join(often, ["g", "w", "h"])
    # shingles that no message has count first: they need no look-up
    lacking = terms.groupBy("g", "w", "s").agg((F.first("k") - F.count("*")).alias("none"))
    need = F.col("k") - F.ceil(F.col("k") * similar - 1e-9) + 1
    place = F.row_number().over(Window.partitionBy("g", "w", "s").orderBy("n", "h"))
    probes = terms.withColumn("i", place).join(lacking, ["g", "w", "s"]).where(F.col("i") <= need - F.col("none")).select("g", "w", "s", "k", "h")
    pairs = stage(probes.join(own, ["g", "w", "h"]).select("g", "w", "s", "k", "m").distinct(), "quote-candidates")
    whole = sets.select("g", "w", "s", F.explode("hs").alias("h")).join(pairs.select("g", "w", "s", "k", "m"), ["g", "w", "s"])
    alike = whole.join(own, ["g", "w", "m", "h"]).groupBy("g", "w", "s", "m").agg((F.count("*") / F.first("k")).alias("share")).where(F.col("share") >= similar - 1e-12)
    alike = stage(alike, "quote-pairs")
    # the latest earlier turn of each message text that a passage is like
    asked = quotes.select("g", "c", "t", "p", "level", "w", "s").join(alike, ["g", "w", "s"]).select("g", "m", "c", "t", "p", "level", "share", F.lit(1).alias("ask"))
    told = said.select("g", F.col("s").alias("m"), "c", "t").join(alike.select("g", "m").distinct(), ["g", "m"], "left_semi").distinct().select("g", "m", "c", "t", F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("share"), F.lit(0).alias("ask"))
    # asks come first among equals: a message doesn't quote itself
    earlier = F.last(F.when(F.col("ask") == 0, F.struct("c", "t")), ignorenulls=True).over(Window.partitionBy("g", "m").orderBy("c", "t", F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1))
    found = asked.unionByName(told).withColumn("to", earlier).where("ask = 1 AND to IS NOT NULL")
    best = found.groupBy("c", "t", "p", "level").agg(F.max(F.struct("share", F.col("to.c").alias("to_c"), F.col("to.t").alias("to_t"))).alias("b"))
    return best.select("c", "t", "p", "level", "b.to_c", "b.to_t", "b.share")


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **options) -> DataFrame:
    """One row per message: conv_id, turn, role, own text, quote counts, reply_to and reply order.

    ``reply_to`` is the turn that the shallowest linked quotation comes from (of several
    at that level the latest), else the turn before in its conversation, else null.
    ``thread`` is the turn of the message that the chain of replies starts with, ``depth``
    the length of the chain, and ``place`` the position in the conversation in reply
    order: threads by their first turn, and in each the replies below what they answer,
    by turn.

    Rows without conversation or turn keep their text and have null links; repeated
    (conversation, turn) rows share their links; null and empty texts have no
    quotations; an empty table gives no rows.  Other columns are left out.
    """
    key = [F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t")]
    links = stage(link_quotes(messages, conv_col, turn_col, text_col, **options), "quote-links")
    per = links.groupBy("c", "t").agg(F.count("*").alias("n_linked"), F.min(F.when(F.col("to_c") == F.col("c"), F.struct("level", (-F.col("to_t")).alias("neg")))).alias("nearest"))
    turns = messages.select(*key).where("c IS NOT NULL AND t IS NOT NULL").distinct()
    before = F.lag("t").over(Window.partitionBy("c").orderBy("t"))  # a conversation's turn numbers only
    parent = turns.withColumn("before", before).join(per, ["c", "t"], "left")
    tree = parent.select("c", "t", F.coalesce(-F.col("nearest.neg"), "before").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    tree = stage(tree.withColumn("linked", F.col("n_linked") > 0), "reply-tree")
    order = _reply_order(tree)

    def own(cols):
        return {k: cols[k] for k in ("c", "t", "role")} | {"text": [own_text(x) if x is not None else None for x in cols["x"]], "n_quotes": [sum(k > 0 for k, _ in levels(x)) if x and ">" in x else 0 for x in cols["x"]], "max_level": [max(k for k, _ in levels(x)) if x and ">" in x else 0 for x in cols["x"]]}

    said = map_rows(messages.select(*key, F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("x")), ["c", "t", "role", "x"], own, "c long, t long, role string, text string, n_quotes long, max_level int")
    out = said.join(order, ["c", "t"], "left")
    return out.select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), "role", "text", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", "thread", "depth", "place")


#: Turns up to which a conversation is ordered in one task.
HELD_TURNS = 50_000


def _reply_order(tree: DataFrame, held: int = HELD_TURNS) -> DataFrame:
    """(c, t, reply_to, n_linked, thread, depth, place) of a forest of replies.

    Conversations of up to ``held`` turns stream through tasks, which hold the numbers of
    one at a time; longer ones are ordered by joins alone.
    """
    sizes = tree.groupBy("c").count()
    long = stage(sizes.where(F.col("count") > held).select("c"), "long-conversations")
    if long.isEmpty():
        return _streamed_order(tree)
    return _streamed_order(tree.join(long, "c", "left_anti")).unionByName(_joined_order(stage(tree.join(long, "c", "left_semi"), "long-trees")))


def _joined_order(tree: DataFrame) -> DataFrame:
    """The order of ``_streamed_order`` by pointer doubling: threads and depths up the replies, places along an Euler tour.

    Each node is entered (element 2t) and left (2t + 1); an element's successor is the
    first reply's entry or its own exit, then the next sibling's entry or the parent's
    exit.  Its distance to the end, in entries, comes from log2 of the length rounds of
    one join each.
    """
    up = stage(tree.select("c", "t", F.coalesce("reply_to", "t").alias("p"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).alias("n")), "up")
    while True:
        a = up.select("c", F.col("t").alias("p"), F.col("p").alias("p2"), F.col("n").alias("n2"))
        new = stage(up.join(a, ["c", "p"]).select("c", "t", F.col("p2").alias("p"), (F.col("n") + F.col("n2")).alias("n"), (F.col("p") != F.col("p2")).alias("moved")), "up")
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    first = tree.where("reply_to IS NOT NULL").groupBy("c", F.col("reply_to").alias("t")).agg(F.min("t").alias("child"))
    sibling = tree.withColumn("next", F.lead("t").over(Window.partitionBy("c", "reply_to").orderBy("t")))
    enter = tree.join(first, ["c", "t"], "left").select("c", (2 * F.col("t")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("t") + 1).alias("s"), F.lit(1).cast("long").alias("w"))
    leave = sibling.select("c", (2 * F.col("t") + 1).alias("e"), F.coalesce(2 * F.col("next"), 2 * F.col("reply_to") + 1).alias("s"), F.lit(0).cast("long").alias("w"))
    tour = stage(enter.unionByName(leave), "tour")
    while True:
        on = tour.select("c", F.col("e").alias("s"), F.col("s").alias("s2"), F.col("w").alias("w2"))
        tour = stage(tour.join(on, ["c", "s"], "left").select("c", "e", F.col("s2").alias("s"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")), "tour")
        if tour.where("s IS NOT NULL").isEmpty():
            break
    total = tree.groupBy("c").agg(F.count("*").alias("all"))
    place = tour.where("e % 2 = 0").join(total, "c").select("c", (F.col("e") / 2).cast("long").alias("t"), (F.col("all") - F.col("w")).cast("int").alias("place"))
    out = tree.join(up.select("c", "t", F.col("p").alias("thread"), F.col("n").cast("int").alias("depth")), ["c", "t"]).join(place, ["c", "t"])
    return out.select("c", "t", "reply_to", "n_linked", "thread", "depth", "place")


def _streamed_order(tree: DataFrame) -> DataFrame:
    """Whole conversations in order, one after the other."""
    schema = StructType.fromDDL("c long, t long, reply_to long, n_linked long, thread long, depth int, place int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []

        def close() -> pa.RecordBatch:
            children: dict = {}
            for _, t, p, n, _ in now:
                children.setdefault(p, []).append(t)
            thread, depth, place = {}, {}, {}
            for _, t, p, n, _ in now:  # a reply follows what it answers
                thread[t], depth[t] = (t, 0) if p is None else (thread[p], depth[p] + 1)
            stack = sorted(children.get(None, []), reverse=True)
            while stack:
                t = stack.pop()
                place[t] = len(place)
                stack += sorted(children.get(t, []), reverse=True)
            rows = [(c, t, p, n, thread[t], depth[t], place[t]) for c, t, p, n, _ in now]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now and row[0] != now[0][0]:
                    yield close()
                    now = []
                now.append(row)
        if now:
            yield close()

    return map_arrow(tree.select("c", "t", "reply_to", "n_linked", "linked").repartition("c").sortWithinPartitions("c", "t"), run, schema)


def chat_documents(formatted: DataFrame) -> DataFrame:
    """(conv_id, messages): a row for each conversation, its messages in reply order without quotations."""
    m = F.struct("place", "turn", "reply_to", "role", "text")
    return formatted.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = format_conversations(read(spark, sf_dir, "conversations"))
    return got.select("conv_id", "turn", "role", "n_quotes", "max_level", "n_linked", "reply_to", "thread", "depth", "place", F.sha2(F.coalesce("text", F.lit("")), 256).alias("own_sha256"))
