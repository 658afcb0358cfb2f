"""The daily index as streams: counts by day, sliding windows, episodes, and upserts of new rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows without repeats of a key, as long as the watermark remembers it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(rows: DataFrame, group: str, time: str, late: str = "1 day") -> DataFrame:
    w = F.window(time, "1 day")
    return rows.withWatermark(time, late).groupBy(w, group).agg(F.count("*").alias("n"), F.approx_count_distinct(group).alias("groups")).select(F.col("window.start").cast("date").alias("day"), group, "n")


def sliding_counts(rows: DataFrame, group: str, time: str, length: str = "84 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window(time, length, step)
    return rows.withWatermark(time, late).groupBy(w, group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), group, "n")


def episodes(rows: DataFrame, group: str, time: str, gap: str, late: str = "1 day") -> DataFrame:
    w = F.session_window(time, gap)
    return rows.withWatermark(time, late).groupBy(w, group).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), group, "n")


def upsert(folder: str, keys: list[str], order: str, buckets: int = 64):
    """A ``foreachBatch`` function: of each key the row of the greatest ``order`` is kept, in a Parquet table of versions.

    Keys are dealt to ``buckets`` by hash, and a batch reads and rewrites only the buckets
    that it has keys of.  A batch that runs again writes the same version again.  Versions
    whose buckets have all been rewritten since, and that the last batch didn't read, go.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        from ..functions.staging import stage

        new = stage(batch.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "upsert")
        touched = [r[0] for r in new.select("_b").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        old = current(batch.sparkSession, folder, before=batch_id, only=touched)
        both = new if old is None else old.unionByName(new)
        w = Window.partitionBy("_b", *keys).orderBy(F.desc(order))
        both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").partitionBy("_b").parquet(f"{folder}/v{batch_id:010d}")
        _vacuum(batch.sparkSession, folder, batch_id)

    return merge


def _versions(spark: SparkSession, folder: str) -> dict[str, set[int]]:
    """Complete versions of an upserted table, and the buckets that each has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    names = sorted(s.getPath().getName() for s in fs.listStatus(root))
    done = [n for n in names if n.startswith("v") and fs.exists(path(f"{folder}/{n}/_SUCCESS"))]
    return {n: {int(s.getPath().getName()[3:]) for s in fs.listStatus(path(f"{folder}/{n}")) if s.getPath().getName().startswith("_b=")} for n in done}


def _newest(versions: dict[str, set[int]], before: int | None = None) -> dict[int, str]:
    return {b: n for n in sorted(versions) if before is None or int(n[1:]) < before for b in versions[n]}


def _vacuum(spark: SparkSession, folder: str, batch_id: int) -> None:
    versions = _versions(spark, folder)
    used = {*_newest(versions).values(), *_newest(versions, batch_id).values()}
    for n in versions:
        if n not in used:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current(spark: SparkSession, folder: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The newest complete rows of an upserted table (with their bucket ``_b`` if some buckets ``only`` are asked for)."""
    newest = _newest(_versions(spark, folder), before)
    paths = [f"{folder}/{n}/_b={b}" for b, n in newest.items() if only is None or b in only]
    if not paths:
        return None
    rows = spark.read.parquet(*paths)
    return rows if only is None else rows.withColumn("_b", F.regexp_extract(F.input_file_name(), r"/_b=(\d+)/", 1).cast("int"))


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that a stream has by now, as a table: a trigger for what is available, into the shared folder."""
    out = os.path.join(checkpoint, "out")
    q: StreamingQuery = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(checkpoint, "log")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
