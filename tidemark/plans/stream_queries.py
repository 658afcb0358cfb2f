"""Streams run to the end of their input, sources and exports, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..functions.staging import shared_dir
from ..sources import tables as src
from ..streaming import live
from .tables import table

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _stream(spark, sf):
    """The events table as a stream: its file, or the files of its folder."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    rows = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks take no other type


def _place(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:10]}"


# a stream without late data ends with the rows behind the last watermark still open, so these end with a closing batch
@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf):
    """Counts by day and type, updated as files arrive: the last value of each is the result."""
    s = _stream(spark, sf).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")
    place = _place(spark)
    q = s.writeStream.outputMode("update").foreachBatch(live.upsert(f"{place}/table", ["day", "event_type"], "n")).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return live.current(spark, f"{place}/table")


@query("stream_dedup", "SELECT event_id, ts, event_type FROM events")
def stream_dedup(spark, sf):
    s = live.once_each(_stream(spark, sf).select("event_id", "ts", "event_type"), "event_id", "ts", "40 days")
    return live.drain(s, "dedup", _place(spark)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("incremental_update", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def incremental_update(spark, sf):
    """The latest event of each user, kept up to date by upserts."""
    s = _stream(spark, sf).select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("o"))
    place = _place(spark)
    q = s.writeStream.foreachBatch(live.upsert(f"{place}/table", ["user_id"], "o")).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return live.current(spark, f"{place}/table").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_sliding_counts", """WITH w AS (SELECT event_type, ts, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events)
SELECT s AS start_ts, s + INTERVAL 7 DAY AS end_ts, event_type, count(*) AS n FROM w WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY s, event_type""")
def stream_sliding_counts(spark, sf):
    """Windows of seven days by day, as far as the watermark has closed them."""
    got = live.drain(live.sliding_counts(_stream(spark, sf), "event_type", "ts", "7 days", "1 day"), "sliding", _place(spark))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


@query("stream_episodes", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x)
SELECT min(ts) AS start_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, user_id, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_episodes(spark, sf):
    got = live.drain(live.episodes(_stream(spark, sf), "user_id", "ts", "6 hours"), "episodes", _place(spark))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


@query("table_scan", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1997-06-30'")
def table_scan(spark, sf):
    from datetime import date

    return src.scan(spark, f"{sf}/orders.parquet", day="o_orderdate", start=date(1996, 1, 1), end=date(1997, 6, 30), columns=["o_orderkey", "o_orderdate", "o_totalprice"])


@query("table_span", "SELECT min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(*) AS n FROM orders")
def table_span(spark, sf):
    return src.span(table(spark, sf, "orders"), "o_orderdate")


@query("rows_by_ids", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def rows_by_ids(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return src.by_ids(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, "l_orderkey")


@query("titles_as_sentences", "SELECT conv_id, 0 AS turn, role AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 UNION ALL SELECT conv_id, turn, text FROM conversations")
def titles_as_sentences(spark, sf):
    return src.with_titles(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("vector_coverage", "SELECT count(*) AS n, count(v.vec_id) AS covered, round(count(v.vec_id) / count(*), 6) AS coverage FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON d.doc_id = v.vec_id")
def vector_coverage(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return src.coverage(table(spark, sf, "documents"), v, ["doc_id"]).withColumn("coverage", rounded(F.col("coverage")))


@query("yearly_export", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY 1")
def yearly_export(spark, sf):
    """Orders written by year, and some of the years read back."""
    place = _place(spark)
    src.export_years({"orders": (table(spark, sf, "orders"), "o_orderdate")}, place)
    return src.read_years(spark, place, "orders", [1996, 1997, 1998]).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("flat_results", "SELECT o_custkey, count(*) AS n, '[' || string_agg('\"' || s || '\"', ',' ORDER BY s) || ']' AS statuses FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def flat_results(spark, sf):
    x = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))
    return src.flat(x.select("o_custkey", F.size("statuses").cast("long").alias("n"), "statuses"))
