"""Line-level deduplication in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, ascii_lower, read, stage

SPACE = " \t\n\x0b\x0c\r"


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` rid of lines that ``min_docs`` or more documents hold.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that so many documents hold lose all
    their lines, except in the smallest id that holds the key.  Two 64-bit hashes
    stand for a key.  All columns of ``docs`` come back, with ``n_lines`` (before
    dropping) and ``n_dropped``; columns of those names are replaced.

    Plan: (hash, id, position) rows are counted with map-side combination, and the
    hashes that are shared are staged, one row for each.  Rows and shared hashes are
    joined as two bare exchanges, so that AQE splits the rows of a hot line over tasks.
    Only positions go back to the texts, which are shuffled once; rows of one id and
    text are split in the same way, as their positions are staged, too.

    Null or empty text: one empty line, nothing dropped.  Null ids are one document
    that orders last.  Rows of one id are one document: a key they alone hold is not
    shared.  Empty table: no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(*names, as_id(id_col).alias("__tm_d"), F.coalesce(F.col(text_col), F.lit("")).alias("__tm_t")).withColumn("__tm_h", F.xxhash64("__tm_t"))
    keys = F.transform(F.split("__tm_t", "\n"), lambda x: ascii_lower(F.btrim(x, F.lit(SPACE))))
    lines = base.select("__tm_d", "__tm_h", F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("__tm_d", "__tm_h", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), F.lit("line"), "key").alias("h2"))
    if min_docs == 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("__tm_d").alias("keeper"), F.max("__tm_d").alias("last")).where("keeper <> last")
    else:
        shared = lines.select("h1", "h2", "__tm_d").distinct().groupBy("h1", "h2").agg(F.min("__tm_d").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = stage(shared.select("h1", "h2", "keeper"), "shared-lines")
    drop = lines.join(shared, ["h1", "h2"]).where("__tm_d <> keeper").groupBy("__tm_d", "__tm_h").agg(F.collect_set("pos").alias("__tm_p"))
    drop = stage(drop, "dropped-lines")
    joined = base.join(drop.hint("shuffle_hash"), ["__tm_d", "__tm_h"], "left").withColumn("__tm_l", F.split("__tm_t", "\n"))
    n = F.size("__tm_l")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__tm_p"))
    kept = F.when(F.col("__tm_p").isNull(), F.col("__tm_t")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("__tm_l"), i)), "\n"))
    out = {text_col: kept.alias(text_col)}
    return joined.select(*[out.get(c, F.col(c)) for c in names], n.cast("long").alias("n_lines"), F.when(F.col("__tm_p").isNull(), 0).otherwise(F.size("__tm_p")).cast("long").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


KEYED_LINES_SQL = r"""
lines AS (
  SELECT d.doc_id, u.pos, d.parts[u.pos] AS line,
         translate(trim(d.parts[u.pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS pos) u
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s USING (key)
)"""

OP4_SQL = f"""
WITH {KEYED_LINES_SQL}
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
