"""Daily series and window operators, on any table with a day and groups.

A series is small once it is aggregated (days times groups); what scans the rows is
one aggregation with map-side combination, and every window is partitioned by group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, week_end


def calendar(df: DataFrame, day: str, groups: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last of the table, for each group that occurs."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias(day))
    return df.select(*groups).distinct().crossJoin(F.broadcast(span)) if groups else span  # one row a day


def daily_proportions(df: DataFrame, key: str, day: str, group: str) -> DataFrame:
    """(group, day, n, total, proportion): distinct keys of a group, and of all, on a dense calendar."""
    counts = df.where(F.col(group).isNotNull() & F.col(day).isNotNull()).groupBy(group, day).agg(F.count_distinct(key).alias("n"))
    totals = df.where(F.col(day).isNotNull()).groupBy(day).agg(F.count_distinct(key).alias("total"))
    grid = calendar(df.where(F.col(day).isNotNull()), day, [group]).where(F.col(group).isNotNull())
    out = grid.join(counts, [group, day], "left").join(totals, day, "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    return out.select(group, day, n.alias("n"), total.alias("total"), F.when(total > 0, n / total).otherwise(0.0).alias("proportion"))


def weekly(series: DataFrame, group: str, day: str) -> DataFrame:
    """Weeks that end on Sunday: counts are summed, proportions averaged."""
    return series.groupBy(group, week_end(F.col(day)).alias("week")).agg(F.sum("n").alias("n"), F.avg("proportion").alias("proportion"))


def statistics(series: DataFrame, group: str) -> DataFrame:
    active = F.sum(F.when(F.col("n") > 0, 1).otherwise(0))
    return series.groupBy(group).agg(F.sum("n").alias("n"), F.avg("n").alias("mean_n"), F.stddev_samp("n").alias("std_n"), F.max("n").alias("max_n"), F.avg("proportion").alias("mean_proportion"), F.stddev_samp("proportion").alias("std_proportion"), F.max("proportion").alias("max_proportion"), active.alias("active_days"), (active / F.count("*")).alias("activity_rate"))


def _before(group: Sequence[str], day: str, first: int, last: int):
    return Window.partitionBy(*group).orderBy(day).rowsBetween(first, last)


def trailing_z(series: DataFrame, value: str, group: Sequence[str], day: str, window: int = 90, least: int = 45, one_sided: bool = True) -> DataFrame:
    """``z`` of a value against the ``window`` rows before it.

    With fewer than ``least`` rows the mean and deviation of the whole series stand in;
    the deviation is at least a tenth of the series', and 1e-10.  One-sided scores are
    not below zero.
    """
    w, whole = _before(group, day, -window, -1), Window.partitionBy(*group)
    enough = F.count(value).over(w) >= least
    mean = F.coalesce(F.when(enough, F.avg(value).over(w)), F.avg(value).over(whole))
    std_all = F.coalesce(F.stddev_samp(value).over(whole), F.lit(0.0))
    std = F.coalesce(F.when(enough, F.stddev_samp(value).over(w)), std_all)
    z = (F.col(value) - mean) / F.greatest(std, 0.1 * std_all, F.lit(1e-10))
    return series.withColumn("z", F.greatest(z, F.lit(0.0)) if one_sided else z)


def local_baseline(series: DataFrame, group: Sequence[str], day: str, first: int = 97, last: int = 8, least: int = 45, least_total: int = 200, floor: float = 1e-6) -> DataFrame:
    """``baseline``: the pooled proportion of a window that ends ``last`` rows ago, and ``baseline_asof``, the last one known."""
    w = _before(group, day, -first, -last)
    total = F.sum("total").over(w)
    base = F.when((F.count("total").over(w) >= least) & (total >= least_total), F.greatest(F.sum("n").over(w) / F.greatest(total, F.lit(1)), F.lit(floor)))
    out = series.withColumn("baseline", base)
    return out.withColumn("baseline_asof", F.last("baseline", ignorenulls=True).over(_before(group, day, Window.unboundedPreceding, 0)))


def centred_mean(series: DataFrame, value: str, group: Sequence[str], day: str, width: int, name: str) -> DataFrame:
    return series.withColumn(name, F.avg(value).over(_before(group, day, -(width // 2), width // 2)))


def sliding_sums(series: DataFrame, group: Sequence[str], day: str, sizes: Sequence[int] = (5, 7, 10, 14, 21, 28)) -> DataFrame:
    """(group, day, size, n, total): sums over the last ``size`` rows, full windows only, a row for each size."""
    parts = []
    for k in sizes:
        w = _before(group, day, 1 - k, 0)
        parts.append(F.struct(F.lit(k).alias("size"), F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total"), F.count("*").over(w).alias("rows")))
    wide = series.select(*group, day, *[p.alias(f"w{i}") for i, p in enumerate(parts)])
    return wide.select(*group, day, F.explode(F.array(*[f"w{i}" for i in range(len(parts))])).alias("w")).where("w.rows = w.size").select(*group, day, "w.size", "w.n", "w.total")


def dominance_ratio(series: DataFrame, day: str, value: str = "proportion") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(day))
    return series.withColumn("dominance", F.when(total > 0, F.col(value) / total).otherwise(0.0))


def orthogonalise(series: DataFrame, target: str, reference: str, group: Sequence[str], name: str, one_sided: bool = True) -> DataFrame:
    """What of a target the reference doesn't explain, within each group."""
    w = Window.partitionBy(*group)
    xx = F.sum(F.col(reference) * F.col(reference)).over(w)
    beta = F.when(xx > 1e-12, F.sum(F.col(target) * F.col(reference)).over(w) / xx).otherwise(0.0)
    rest = F.col(target) - beta * F.col(reference)
    return series.withColumn(name, clip(rest, 0.0, None) if one_sided else rest)


WEIGHTS = {"temporal": 0.25, "participation": 0.20, "convergence": 0.20, "source": 0.15, "semantic": 0.20}


def composite(weights: dict[str, float]) -> Column:
    """Weighted sum of signal columns; nulls count as zero."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + w * F.coalesce(F.col(c), F.lit(0.0))
    return out


def islands(df: DataFrame, group: Sequence[str], day: str, value: str, threshold: float, least: int, gap: int = 1) -> DataFrame:
    """Runs of days at or above a threshold, ``gap`` days apart at most, of ``least`` days and more."""
    w = Window.partitionBy(*group).orderBy(day)
    hit = df.where(F.col(value) >= threshold)
    start = F.when(F.datediff(day, F.lag(day).over(w)) <= gap, 0).otherwise(1)
    ids = hit.withColumn("_start", start).withColumn("island", F.sum("_start").over(w))
    out = ids.groupBy(*group, "island").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("days"), F.max(value).alias("peak"), F.avg(value).alias("mean"))
    return out.where(F.col("days") >= least).drop("island")


def merge_intervals(df: DataFrame, group: Sequence[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Intervals joined where one starts at most ``gap`` days after all before it have ended."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.datediff(F.col(start), reach) <= gap, 0).otherwise(1)
    ids = df.withColumn("_new", new).withColumn("_id", F.sum("_new").over(w))
    return ids.groupBy(*group, "_id").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_id")


def threshold_bursts(series: DataFrame, group: str, day: str, value: str, method: str = "percentile", level: float = 0.9) -> DataFrame:
    """Bursts above a percentile, or above mean + ``level`` deviations; each ends on the first day that isn't above."""
    t = F.percentile(value, F.lit(level)) if method == "percentile" else F.avg(value) + level * F.stddev_samp(value)
    marked = series.join(F.broadcast(series.groupBy(group).agg(t.alias("limit"))), group)  # a row for each group
    w = Window.partitionBy(group).orderBy(day)
    above = F.col(value) > F.col("limit")
    marked = marked.withColumn("above", above).withColumn("next_day", F.lead(day).over(w)).withColumn("_s", F.when(above & ~F.coalesce(F.lag(above).over(w), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("_id", F.sum("_s").over(w)).where("above")
    return marked.groupBy(group, "_id").agg(F.min(day).alias("start_day"), F.coalesce(F.max("next_day"), F.max(day)).alias("end_day"), F.count("*").alias("days"), F.max(value).alias("peak")).drop("_id")


def cumulative_actors(df: DataFrame, group: Sequence[str], day: str, actor: str) -> DataFrame:
    """(group, day, new_actors, cumulative): actors count on the day they first occur; days with rows only."""
    first = df.groupBy(*group, actor).agg(F.min(day).alias(day)).groupBy(*group, day).agg(F.count("*").alias("new_actors"))
    days = df.select(*group, day).distinct().join(first, [*group, day], "left").fillna(0, ["new_actors"])
    return days.withColumn("cumulative", F.sum("new_actors").over(_before(group, day, Window.unboundedPreceding, 0)))


def growth(cumulative: DataFrame, group: Sequence[str], day: str) -> DataFrame:
    """Share of days on which the cumulative count grew, and actors gained a day up to the largest gain."""
    w = Window.partitionBy(*group).orderBy(day)
    step = F.col("cumulative") - F.lag("cumulative").over(w)
    marked = cumulative.withColumn("step", step)
    return marked.groupBy(*group).agg(
        F.coalesce(F.avg(F.when(F.col("step").isNotNull(), (F.col("step") > 0).cast("double"))), F.lit(0.0)).alias("growth"),
        ((F.max_by("cumulative", day) - F.min_by("cumulative", day)) / F.greatest(F.datediff(F.max(day), F.min(day)), F.lit(1))).alias("velocity"),
    )


def lag_matrix(series: DataFrame, group: Sequence[str], day: str, value: str, lags: int) -> DataFrame:
    """Columns lag_0 to lag_k, zero before the start."""
    w = Window.partitionBy(*group).orderBy(day)
    return series.select(*group, day, *[F.coalesce(F.lag(value, k).over(w) if k else F.col(value), F.lit(0)).alias(f"lag_{k}") for k in range(lags + 1)])


def sessions(df: DataFrame, group: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """Episodes: rows of a group closer than a gap; by ``session_window``, as a stream would have them."""
    return df.groupBy(*group, F.session_window(time, f"{gap_seconds} seconds").alias("s")).agg(F.count("*").alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")).drop("s")


def mean_shifts(series: DataFrame, group: str, day: str, value: str, width: int = 7, threshold: float = 0.3) -> DataFrame:
    """Days on which the centred mean moves by a threshold or more."""
    out = centred_mean(series, value, [group], day, width, "smooth")
    d = F.col("smooth") - F.lag("smooth").over(Window.partitionBy(group).orderBy(day))
    return out.withColumn("shift", d).where(F.abs("shift") >= threshold)


def interpolate_daily(weekly_rows: DataFrame, group: str, day: str, value: str) -> DataFrame:
    """A weekly series as a daily one, linear between the given days."""
    w = Window.partitionBy(group).orderBy(day)
    spans = weekly_rows.select(group, day, value, F.lead(day).over(w).alias("_d"), F.lead(value).over(w).alias("_v"))
    last = F.when(F.col("_d").isNull(), F.col(day)).otherwise(F.date_sub("_d", 1))
    out = spans.withColumn("at", F.explode(F.sequence(F.col(day), last)))
    share = F.datediff("at", day) / F.datediff("_d", day)
    return out.select(group, F.col("at").alias(day), F.when(F.col("_d").isNull(), F.col(value)).otherwise(F.col(value) + share * (F.col("_v") - F.col(value))).alias(value))


def sliding_weeks(daily: DataFrame, group: str, day: str, value: str, weeks: int = 12, least: int = 11) -> DataFrame:
    """Windows of ``weeks`` weeks that end on each day: mean of the weekly means; windows of ``least`` weeks or more.

    Each day is exploded into the window ends that it belongs to, then one aggregation.
    """
    ends = daily.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    span = 7 * weeks
    wide = daily.crossJoin(F.broadcast(ends)).withColumn("window_end", F.explode(F.sequence(F.col(day), F.least(F.date_add(day, span - 1), "b"))))
    week = F.floor(F.datediff("window_end", day) / 7)
    per = wide.groupBy(group, "window_end", week.alias("k")).agg(F.avg(value).alias("v"), F.count("*").alias("n")).where("n = 7")
    return per.groupBy(group, "window_end").agg(F.avg("v").alias(value), F.count("*").alias("weeks")).where(F.col("weeks") >= least)


def half_life(series: DataFrame, group: str, day: str, value: str, width: int = 365) -> DataFrame:
    """AR(1) of the deviation from a centred mean: coefficient and half-life in days."""
    w = Window.partitionBy(group).orderBy(day)
    dev = series.withColumn("_dev", F.col(value) - F.avg(value).over(_before([group], day, -(width // 2), width // 2)))
    pairs = dev.withColumn("_prev", F.lag("_dev").over(w))
    rho = F.corr("_dev", "_prev")
    return pairs.groupBy(group).agg(rho.alias("rho")).withColumn("half_life", F.when((F.col("rho") > 0) & (F.col("rho") < 1), F.log(F.lit(0.5)) / F.log("rho")))
