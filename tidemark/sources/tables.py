"""Reading and writing: tables with ranges, JDBC slices, CSV dimensions, nested results, yearly exports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def scan(spark: SparkSession, path: str, fmt: str = "parquet", day: str | None = None, start: date | None = None, end: date | None = None, columns: Sequence[str] | None = None, order: Sequence[str] = (), limit: int | None = None, schema: str | None = None) -> DataFrame:
    """A table with a range of days, a projection, an order and a limit; range and columns reach the scan."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    reader = reader.option("header", True) if fmt == "csv" else reader
    df = (reader.schema(schema) if schema else reader).load(path)
    if day and start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if day and end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    df = df.select(*columns) if columns else df
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit is not None else df


def jdbc(spark: SparkSession, url: str, table: str, day: str, start: date, end: date, slices: int = 16, fetch: int = 50_000, **options: str) -> DataFrame:
    """A database table read in parallel slices of its days; the last slice is open, so no row is lost."""
    bounds = {"partitionColumn": day, "lowerBound": str(start), "upperBound": str(end), "numPartitions": str(slices), "fetchsize": str(fetch)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load().where(F.col(day).between(F.lit(start), F.lit(end)))


def reachable(read: Callable[[], DataFrame]) -> bool:
    """Whether a source answers a query for one row."""
    try:
        read().limit(1).count()
        return True
    except Exception as e:  # any failure of a source means that it can't be reached now
        print(f"source not reachable: {type(e).__name__}")
        return False


def slices(start: date, end: date, n: int) -> list[tuple[date, date]]:
    """Half-open slices [a, b) of near equal length that hold every day from ``start`` to ``end``, the last one too."""
    days = (end - start).days + 1
    cuts = [start + timedelta(days=days * i // n) for i in range(n + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def valid(df: DataFrame, key: str, day: str, before_year: int | None = None) -> DataFrame:
    """Rows with a key and a day, of years before the one given."""
    ok = F.col(key).isNotNull() & F.col(day).isNotNull()
    return df.where(ok & (F.year(day) < before_year) if before_year is not None else ok)


def sentence_counts(sentences: DataFrame, key: str, title: str) -> DataFrame:
    """(sentences, titled): rows, and documents with a title."""
    return sentences.agg(F.count("*").alias("sentences"), F.count_distinct(F.when(F.col(title).isNotNull(), F.col(key))).alias("titled"))


class QueryCache:
    """Results by the digest of what was asked, as Parquet in a shared folder; beyond ``most`` the oldest goes."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 32) -> None:
        self.spark, self.folder, self.most, self.held = spark, folder, most, {}

    def get(self, asked: str, make: Callable[[], DataFrame]) -> DataFrame:
        name = hashlib.md5(asked.encode()).hexdigest()
        if name not in self.held:
            df = make()
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.held[name] = df.schema
            while len(self.held) > self.most:
                self._drop(next(iter(self.held)))
        return self.spark.read.schema(self.held[name]).parquet(f"{self.folder}/{name}")

    def _drop(self, name: str) -> None:
        del self.held[name]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_index(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """An index as Parquet, ORC or JSON; nested columns stay nested."""
    if fmt not in ("parquet", "orc", "json"):
        raise ValueError(f"{fmt} can't hold nested columns")
    df.write.mode(mode).format(fmt).save(path)


def load_index(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def span(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the ids given, as a semi join that Spark plans by size."""
    return df.join(ids.select(key), key, "left_semi")


def columns_of(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def run_all(jobs: dict[str, Callable[[], object]], threads: int = 4) -> dict[str, object]:
    """Several actions at once, on one session's scheduler."""
    with ThreadPoolExecutor(threads) as pool:
        futures = {k: pool.submit(f) for k, f in jobs.items()}
        return {k: f.result() for k, f in futures.items()}


def with_titles(sentences: DataFrame, key: str, part: str, title: str, text: str) -> DataFrame:
    """Sentences and, as part 0, each title once."""
    w = Window.partitionBy(key).orderBy(part)
    first = sentences.where(F.col(title).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    titles = first.select(key, F.lit(0).cast(dict(sentences.dtypes)[part]).alias(part), F.col(title).alias(text))
    return titles.unionByName(sentences.select(key, part, text))


def coverage(rows: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows have a vector, and the share: (n, covered, coverage)."""
    v = vectors.select(*keys).distinct().withColumn("_v", F.lit(1))
    x = rows.select(*keys).distinct().join(v, list(keys), "left")
    return x.agg(F.count("*").alias("n"), F.count("_v").alias("covered"), (F.count("_v") / F.count("*")).alias("coverage"))


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV table; where it is joined, its size decides on a broadcast."""
    return spark.read.schema(schema).option("header", True).csv(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks without nesting."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def export_years(tables: dict[str, tuple[DataFrame, str]], folder: str, mode: str = "overwrite") -> None:
    """Each table partitioned by the year of a day column; one folder a table, so years are read by pruning."""
    for name, (df, day) in tables.items():
        df.withColumn("year", F.year(day)).write.mode(mode).partitionBy("year").parquet(f"{folder}/{name}")


def read_years(spark: SparkSession, folder: str, name: str, years: Iterable[int] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}")
    return df.where(F.col("year").isin(*years)) if years is not None else df


def missing_years(spark: SparkSession, folder: str, name: str, years: Iterable[int]) -> list[int]:
    """Years not exported yet, for a run that goes on where one ended."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [y for y in years if not fs.exists(path(f"{folder}/{name}/year={y}"))]


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of several tables."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
