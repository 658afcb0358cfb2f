"""Rank statistics of large tables, over distinct values instead of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, value: str, amount: str, name: str) -> DataFrame:
    """``df`` with the sum of an amount over all smaller values, without a window over the whole table.

    Rows are range-partitioned by value; partition totals (one row each) give each
    partition its start, and windows run inside partitions.  ``value`` is unique.
    """
    from ..functions.staging import stage

    parts = stage(df.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_part").agg(F.sum(amount).alias("_s"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")  # a row for each partition
    local = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_local", local).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_start", "_local")


def mean_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank): the mean rank of each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    below = running_total(counts, value, "_n", "_below")
    return below.select(value, (F.col("_below") + (F.col("_n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n): rank correlation over rows with both values."""
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ra, rb = mean_ranks(both, x).withColumnRenamed("rank", "_ra"), mean_ranks(both, y).withColumnRenamed("rank", "_rb")
    return both.join(ra, x).join(rb, y).agg(F.corr("_ra", "_rb").alias("rho"), F.count("*").alias("n"))


def weighted_percentile(df: DataFrame, groups: Sequence[str], value: str, weight: str, p: float) -> DataFrame:
    """Percentile of weighted values, interpolated between the midpoints of their weights.

    Equal values are summed first, so that a window sees distinct values only.
    """
    w = Window.partitionBy(*groups).orderBy(value)
    x = df.groupBy(*groups, value).agg(F.sum(weight).alias("_w")).where("_w > 0")
    q = x.withColumn("_q", (F.sum("_w").over(w) - F.col("_w") / 2) / F.sum("_w").over(Window.partitionBy(*groups)))
    q = q.withColumns({"_nv": F.lead(value).over(w), "_nq": F.lead("_q").over(w)})
    inside = F.max(F.when((F.col("_q") <= p) & (F.col("_nq") > p), F.col(value) + (p - F.col("_q")) / (F.col("_nq") - F.col("_q")) * (F.col("_nv") - F.col(value))))
    return q.groupBy(*groups).agg(F.coalesce(inside, F.when(F.min("_q") > p, F.min(value)).otherwise(F.max(value))).alias("percentile"))


def benjamini_hochberg(df: DataFrame, groups: Sequence[str], p: str, tiebreak: str) -> DataFrame:
    """``df`` with ``q``: the smallest p * n / rank of this and all larger p-values; null p-values stay null."""
    up = Window.partitionBy(*groups).orderBy(p, tiebreak)
    tested = df.where(F.col(p).isNotNull())
    ranked = tested.withColumns({"_i": F.row_number().over(up), "_n": F.count("*").over(Window.partitionBy(*groups))})
    q = F.min(F.col(p) * F.col("_n") / F.col("_i")).over(Window.partitionBy(*groups).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("q", F.least(q, F.lit(1.0))).drop("_i", "_n")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def quantile(df: DataFrame, groups: Sequence[str], value: str, p: float) -> DataFrame:
    """(groups, quantile): the interpolated quantile of each group's values, exactly, however many a group has.

    Equal values are counted first; the distinct ones are range-partitioned by group and
    value, and each part's start comes from the totals of the parts, a row each, so that no
    group is held or sorted in one task.
    """
    from ..functions.staging import stage

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    parts = stage(counts.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()), "quantile")
    sums = parts.groupBy(*groups, "_part").agg(F.sum("_n").alias("_s"))
    whole = Window.partitionBy(*groups)
    starts = sums.select(*groups, "_part", (F.sum("_s").over(whole.orderBy("_part")) - F.col("_s")).alias("_start"), F.sum("_s").over(whole).alias("_all"))
    w = Window.partitionBy(*groups, "_part").orderBy(value)
    at = parts.join(starts, [*groups, "_part"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(w)).withColumn("_below", F.col("_upto") - F.col("_n"))
    spot = (F.col("_all") - 1) * p
    pick = lambda i: F.max(F.when((F.col("_below") <= i) & (i < F.col("_upto")), F.col(value)))
    got = at.groupBy(*groups).agg(pick(F.floor(spot)).alias("_a"), pick(F.ceil(spot)).alias("_b"), F.max(spot - F.floor(spot)).alias("_f"))
    return got.select(*groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))
