"""Queries over daily series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import cohen_h, decade, era, rounded
from ..operators import relational, series
from .tables import ARTICLES, DAILY, articles, daily, events

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


Z = """CASE WHEN count(p) OVER w >= 45 THEN avg(p) OVER w ELSE avg(p) OVER a END AS m,
  coalesce(CASE WHEN count(p) OVER w >= 45 THEN stddev_samp(p) OVER w END, stddev_samp(p) OVER a, 0) AS sd, coalesce(stddev_samp(p) OVER a, 0) AS sa
  FROM s WINDOW w AS (PARTITION BY f ORDER BY d ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY f)"""
ZED = DAILY + f""", z0 AS (SELECT f, d, n, total, p, {Z}), z AS (SELECT f, d, n, total, p, (p - m) / greatest(sd, 0.1 * sa, 1e-10) AS z2 FROM z0)"""


@query("anomaly_islands", f"""WITH {ZED}, h AS (SELECT f, d, round(greatest(z2, 0), 9) AS z FROM z WHERE round(greatest(z2, 0), 9) >= 1),
i AS (SELECT f, d, z, sum(st) OVER (PARTITION BY f ORDER BY d) AS g FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY f ORDER BY d) <= 1 THEN 0 ELSE 1 END AS st FROM h))
SELECT f AS frame, min(d) AS start_day, max(d) AS end_day, count(*) AS days, round(max(z), 6) + 0 AS peak, round(avg(z), 6) + 0 AS mean FROM i GROUP BY f, g HAVING count(*) >= 2""")
def anomaly_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Which frame shows anomalous coverage on which days: runs of days with a trailing score of one or more."""
    z = series.trailing_z(daily(spark, sf), "proportion", ["f"], "d").withColumn("z", F.round("z", 9))
    got = series.islands(z, ["f"], "d", "z", 1.0, 2)
    return got.select(F.col("f").alias("frame"), "start_day", "end_day", "days", rounded(F.col("peak")).alias("peak"), rounded(F.col("mean")).alias("mean"))


@query("daily_frame_proportion", f"WITH {DAILY} SELECT f AS frame, d AS day, n, total, round(p, 6) + 0 AS proportion FROM s")
def daily_frame_proportion(spark, sf):
    return daily(spark, sf).select(F.col("f").alias("frame"), F.col("d").alias("day"), "n", "total", rounded(F.col("proportion")).alias("proportion"))


@query("weekly_resample", f"WITH {DAILY} SELECT f AS frame, CAST(d + CAST((7 - isodow(d)) AS INTEGER) AS DATE) AS week, CAST(sum(n) AS BIGINT) AS n, round(avg(p), 6) + 0 AS proportion FROM s GROUP BY 1, 2")
def weekly_resample(spark, sf):
    return series.weekly(daily(spark, sf), "f", "d").select(F.col("f").alias("frame"), "week", "n", rounded(F.col("proportion")).alias("proportion"))


@query("weekly_monday", f"WITH {DAILY} SELECT f AS frame, CAST(date_trunc('week', d) AS DATE) AS week, round(avg(p), 6) + 0 AS proportion FROM s GROUP BY 1, 2")
def weekly_monday(spark, sf):
    got = daily(spark, sf).groupBy("f", F.date_trunc("week", "d").cast("date").alias("week")).agg(F.avg("proportion").alias("p"))
    return got.select(F.col("f").alias("frame"), "week", rounded(F.col("p")).alias("proportion"))


@query("series_statistics", f"""WITH {DAILY} SELECT f AS frame, CAST(sum(n) AS BIGINT) AS n, round(avg(n), 6) AS mean_n, round(stddev_samp(n), 6) AS std_n, max(n) AS max_n, round(avg(p), 6) AS mean_proportion,
round(stddev_samp(p), 6) AS std_proportion, round(max(p), 6) AS max_proportion, count(*) FILTER (n > 0) AS active_days, round((count(*) FILTER (n > 0)) / count(*), 6) AS activity_rate FROM s GROUP BY f""")
def series_statistics(spark, sf):
    got = series.statistics(daily(spark, sf), "f")
    real = [c for c in got.columns if c.startswith(("mean", "std")) or c in ("max_proportion", "activity_rate")]
    return got.select(F.col("f").alias("frame"), *[rounded(F.col(c)).alias(c) if c in real else F.col(c) for c in got.columns if c != "f"])


@query("trailing_zscore", f"WITH {ZED} SELECT f AS frame, d AS day, round(greatest(z2, 0), 6) + 0 AS z FROM z")
def trailing_zscore(spark, sf):
    return series.trailing_z(daily(spark, sf), "proportion", ["f"], "d").select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(F.col("z")).alias("z"))


@query("twosided_zscore", f"WITH {ZED} SELECT f AS frame, d AS day, round(z2, 6) + 0 AS z FROM z")
def twosided_zscore(spark, sf):
    return series.trailing_z(daily(spark, sf), "proportion", ["f"], "d", one_sided=False).select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(F.col("z")).alias("z"))


BASE = DAILY + """, b AS (SELECT f, d, n, total, p, CASE WHEN count(total) OVER w >= 45 AND sum(total) OVER w >= 200 THEN greatest(sum(n) OVER w / greatest(sum(total) OVER w, 1), 1e-6) END AS baseline
  FROM s WINDOW w AS (PARTITION BY f ORDER BY d ROWS BETWEEN 97 PRECEDING AND 8 PRECEDING)),
ba AS (SELECT *, last_value(baseline IGNORE NULLS) OVER (PARTITION BY f ORDER BY d ROWS UNBOUNDED PRECEDING) AS known FROM b)"""


@query("local_baseline_asof", f"WITH {BASE} SELECT f AS frame, d AS day, round(baseline, 6) + 0 AS baseline, round(known, 6) + 0 AS baseline_asof FROM ba")
def local_baseline_asof(spark, sf):
    got = series.local_baseline(daily(spark, sf), ["f"], "d")
    return got.select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(F.col("baseline")).alias("baseline"), rounded(F.col("baseline_asof")).alias("baseline_asof"))


@query("cohen_h", f"WITH {BASE} SELECT f AS frame, d AS day, round(2 * asin(sqrt(p)) - 2 * asin(sqrt(known)), 6) + 0 AS h, round(p / known, 6) + 0 AS ratio FROM ba WHERE known IS NOT NULL")
def cohens_h(spark, sf):
    got = series.local_baseline(daily(spark, sf), ["f"], "d").where("baseline_asof is not null")
    return got.select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(cohen_h(F.col("proportion"), F.col("baseline_asof"))).alias("h"), rounded(F.col("proportion") / F.col("baseline_asof")).alias("ratio"))


_SMOOTH = ", ".join(f"round(avg(p) OVER (PARTITION BY f ORDER BY d ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING), 6) + 0 AS mean_{k}" for k in (3, 5, 7))


@query("centred_smoothing", f"WITH {DAILY} SELECT f AS frame, d AS day, {_SMOOTH} FROM s")
def centred_smoothing(spark, sf):
    got = daily(spark, sf)
    for k in (3, 5, 7):
        got = series.centred_mean(got, "proportion", ["f"], "d", k, f"mean_{k}")
    return got.select(F.col("f").alias("frame"), F.col("d").alias("day"), *[rounded(F.col(f"mean_{k}")).alias(f"mean_{k}") for k in (3, 5, 7)])


_SUMS = " UNION ALL ".join(f"SELECT f AS frame, d AS day, {k} AS size, CAST(n{k} AS BIGINT) AS n, CAST(t{k} AS BIGINT) AS total FROM w{k} WHERE r >= {k}" for k in (5, 7, 10, 14, 21, 28))
_WINS = ", ".join(f"w{k} AS (SELECT f, d, row_number() OVER x AS r, sum(n) OVER y AS n{k}, sum(total) OVER y AS t{k} FROM s WINDOW x AS (PARTITION BY f ORDER BY d), y AS (PARTITION BY f ORDER BY d ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW))" for k in (5, 7, 10, 14, 21, 28))


@query("multiscale_sliding_sums", f"WITH {DAILY}, {_WINS} {_SUMS}")
def multiscale_sliding_sums(spark, sf):
    return series.sliding_sums(daily(spark, sf), ["f"], "d").select(F.col("f").alias("frame"), F.col("d").alias("day"), "size", "n", "total")


@query("dominance_ratio", f"WITH {DAILY} SELECT f AS frame, d AS day, round(CASE WHEN sum(p) OVER x > 0 THEN p / sum(p) OVER x ELSE 0 END, 6) + 0 AS dominance FROM s WINDOW x AS (PARTITION BY d)")
def dominance(spark, sf):
    return series.dominance_ratio(daily(spark, sf), "d").select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(F.col("dominance")).alias("dominance"))


COMPOSITE = DAILY + """, act AS (SELECT f, d, count(DISTINCT c) AS actors FROM o GROUP BY f, d), sig AS (SELECT s.f, s.d, s.p, coalesce(actors, 0) AS actors FROM s LEFT JOIN act USING (f, d)),
zz AS (SELECT f, d, p, actors, CASE WHEN count(*) OVER w >= 45 THEN avg(p) OVER w ELSE avg(p) OVER a END AS m1, coalesce(CASE WHEN count(*) OVER w >= 45 THEN stddev_samp(p) OVER w END, stddev_samp(p) OVER a, 0) AS s1, coalesce(stddev_samp(p) OVER a, 0) AS g1,
 CASE WHEN count(*) OVER w >= 45 THEN avg(actors) OVER w ELSE avg(actors) OVER a END AS m2, coalesce(CASE WHEN count(*) OVER w >= 45 THEN stddev_samp(actors) OVER w END, stddev_samp(actors) OVER a, 0) AS s2, coalesce(stddev_samp(actors) OVER a, 0) AS g2
 FROM sig WINDOW w AS (PARTITION BY f ORDER BY d ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY f)),
zc AS (SELECT f, d, greatest((p - m1) / greatest(s1, 0.1 * g1, 1e-10), 0) AS zt, greatest((actors - m2) / greatest(s2, 0.1 * g2, 1e-10), 0) AS zp FROM zz),
orth AS (SELECT f, d, zt, greatest(zp - sum(zp * zt) OVER a / sum(zt * zt) OVER a * zt, 0) AS zo FROM zc WINDOW a AS (PARTITION BY f))"""


@query("orthogonalised_composite", f"WITH {COMPOSITE} SELECT f AS frame, d AS day, round(zt, 5) + 0 AS temporal, round(zo, 5) + 0 AS participation, round(0.25 * zt + 0.2 * zo, 5) + 0 AS composite FROM orth")
def orthogonalised_composite(spark, sf):
    a = articles(spark, sf)
    actors = a.groupBy("f", "d").agg(F.count_distinct("c").alias("actors"))
    s = daily(spark, sf).join(actors, ["f", "d"], "left").fillna(0, ["actors"])
    s = series.trailing_z(s, "proportion", ["f"], "d").withColumnRenamed("z", "temporal")
    s = series.trailing_z(s, "actors", ["f"], "d").withColumnRenamed("z", "raw")
    s = series.orthogonalise(s, "raw", "temporal", ["f"], "participation")
    c = series.composite({"temporal": 0.25, "participation": 0.20})
    return s.select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(F.col("temporal"), 5).alias("temporal"), rounded(F.col("participation"), 5).alias("participation"), rounded(c, 5).alias("composite"))


@query("percentile_bursts", f"""WITH {DAILY}, q AS (SELECT f, quantile_cont(p, 0.9) AS lim FROM s GROUP BY f),
m AS (SELECT s.f, d, p, p > lim AS above, lead(d) OVER x AS nd, CASE WHEN p > lim AND NOT coalesce(lag(p) OVER x > lim, false) THEN 1 ELSE 0 END AS st FROM s JOIN q USING (f) WINDOW x AS (PARTITION BY s.f ORDER BY d)),
i AS (SELECT *, sum(st) OVER (PARTITION BY f ORDER BY d) AS g FROM m)
SELECT f AS frame, min(d) AS start_day, coalesce(max(nd), max(d)) AS end_day, count(*) AS days, round(max(p), 6) AS peak FROM i WHERE above GROUP BY f, g""")
def percentile_bursts(spark, sf):
    got = series.threshold_bursts(daily(spark, sf), "f", "d", "proportion")
    return got.select(F.col("f").alias("frame"), "start_day", "end_day", "days", rounded(F.col("peak")).alias("peak"))


@query("merged_intervals", f"""WITH {ARTICLES}, x AS (SELECT c, d AS a, CAST(d + CAST(k % 40 AS INTEGER) AS DATE) AS b FROM o),
y AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY c ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS n FROM x),
z AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM y) SELECT c AS actor, min(a) AS start_day, max(b) AS end_day, count(*) AS merged FROM z GROUP BY c, g""")
def merged_intervals(spark, sf):
    """Windows that overlap or touch, joined by actor; an order's window is as long as its key says."""
    x = articles(spark, sf).select("c", F.col("d").alias("start_day"), F.expr("date_add(d, cast(k % 40 as int))").alias("end_day"))
    return series.merge_intervals(x, ["c"], "start_day", "end_day").withColumnRenamed("c", "actor")


CUM = ARTICLES + """, fd AS (SELECT f, c, min(d) AS d FROM o GROUP BY f, c), na AS (SELECT f, d, count(*) AS a FROM fd GROUP BY f, d),
cu AS (SELECT f, d, coalesce(a, 0) AS a, sum(coalesce(a, 0)) OVER (PARTITION BY f ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT DISTINCT f, d FROM o) LEFT JOIN na USING (f, d))"""


@query("cumulative_distinct_actors", f"WITH {CUM} SELECT f AS frame, d AS day, a AS new_actors, CAST(cum AS BIGINT) AS cumulative FROM cu")
def cumulative_distinct_actors(spark, sf):
    return series.cumulative_actors(articles(spark, sf), ["f"], "d", "c").select(F.col("f").alias("frame"), F.col("d").alias("day"), "new_actors", "cumulative")


@query("growth_and_velocity", f"WITH {CUM}, st AS (SELECT f, d, cum, cum - lag(cum) OVER (PARTITION BY f ORDER BY d) AS x FROM cu) SELECT f AS frame, round(avg(CASE WHEN x IS NOT NULL THEN CAST(x > 0 AS INTEGER) END), 6) AS growth, round((max_by(cum, d) - min_by(cum, d)) / greatest(max(d) - min(d), 1), 6) AS velocity FROM st GROUP BY f")
def growth_and_velocity(spark, sf):
    got = series.growth(series.cumulative_actors(articles(spark, sf), ["f"], "d", "c"), ["f"], "d")
    return got.select(F.col("f").alias("frame"), rounded(F.col("growth")).alias("growth"), rounded(F.col("velocity")).alias("velocity"))


@query("lag_matrix", f"WITH {DAILY} SELECT f AS frame, d AS day, n AS lag_0, {', '.join(f'coalesce(lag(n, {k}) OVER x, 0) AS lag_{k}' for k in (1, 2, 3))} FROM s WINDOW x AS (PARTITION BY f ORDER BY d)")
def lag_matrix(spark, sf):
    return series.lag_matrix(daily(spark, sf), ["f"], "d", "n", 3).withColumnsRenamed({"f": "frame", "d": "day"})


@query("episode_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS st FROM events WHERE ts IS NOT NULL),
y AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM y GROUP BY user_id, g""")
def episode_sessions(spark, sf):
    return series.sessions(events(spark, sf), ["user_id"], "ts", 6 * 3600)


@query("gap_episodes", f"""WITH {ARTICLES}, x AS (SELECT c, d, CASE WHEN d - lag(d) OVER (PARTITION BY c ORDER BY d) <= 21 THEN 0 ELSE 1 END AS st FROM (SELECT DISTINCT c, d FROM o)),
y AS (SELECT *, sum(st) OVER (PARTITION BY c ORDER BY d) AS g FROM x) SELECT c AS actor, min(d) AS start_day, max(d) AS end_day, count(*) AS days FROM y GROUP BY c, g HAVING count(*) >= 2""")
def gap_episodes(spark, sf):
    x = articles(spark, sf).select("c", "d").distinct().withColumn("one", F.lit(1.0))
    return series.islands(x, ["c"], "d", "one", 1.0, 2, gap=21).select(F.col("c").alias("actor"), "start_day", "end_day", "days")


@query("sentiment_shifts", """WITH e AS (SELECT event_type AS g, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT g, d, v, avg(v) OVER (PARTITION BY g ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS sm FROM e),
x AS (SELECT *, sm - lag(sm) OVER (PARTITION BY g ORDER BY d) AS sh FROM m) SELECT g AS event_type, d AS day, round(sm, 6) + 0 AS smooth, round(sh, 6) + 0 AS shift FROM x WHERE abs(sh) >= 0.3""")
def sentiment_shifts(spark, sf):
    e = events(spark, sf).groupBy("event_type", "d").agg(F.avg("value").alias("v"))
    got = series.mean_shifts(e, "event_type", "d", "v")
    return got.select("event_type", F.col("d").alias("day"), rounded(F.col("smooth")).alias("smooth"), rounded(F.col("shift")).alias("shift"))


@query("entity_bursts", """WITH e AS (SELECT user_id AS u, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT u, d FROM (SELECT DISTINCT u FROM e), (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM e)),
x AS (SELECT c.u, c.d, coalesce(n, 0) AS n FROM c LEFT JOIN e ON c.u = e.u AND c.d = e.d), w AS (SELECT u, d, n, count(*) OVER y AS k, avg(n) OVER y AS m, stddev_samp(n) OVER y AS sd FROM x WINDOW y AS (PARTITION BY u ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT u AS user_id, d AS day, n FROM w WHERE k = 7 AND n > round(m + 2 * sd, 9)""")
def entity_bursts(spark, sf):
    from pyspark.sql import Window

    e = events(spark, sf)
    n = e.groupBy("user_id", "d").agg(F.count("*").alias("n"))
    x = series.calendar(e, "d", ["user_id"]).join(n, ["user_id", "d"], "left").fillna(0, ["n"])
    w = Window.partitionBy("user_id").orderBy("d").rowsBetween(-3, 3)
    x = x.withColumns({"k": F.count("*").over(w), "limit": F.round(F.avg("n").over(w) + 2 * F.stddev_samp("n").over(w), 9)})
    return x.where("k = 7 and n > limit").select("user_id", F.col("d").alias("day"), "n")


@query("sliding_weeks", f"""WITH {DAILY}, wk AS (SELECT f, CAST(d + CAST((7 - isodow(d)) AS INTEGER) AS DATE) AS w, avg(p) AS v FROM s GROUP BY 1, 2),
l AS (SELECT f, w, v, lead(w) OVER x AS nw, lead(v) OVER x AS nv FROM wk WINDOW x AS (PARTITION BY f ORDER BY w)),
di AS (SELECT f, CAST(unnest(generate_series(w, coalesce(nw - 1, w), INTERVAL 1 DAY)) AS DATE) AS d, w, v, nw, nv FROM l),
dv AS (SELECT f, d, CASE WHEN nw IS NULL THEN v ELSE v + (d - w) / (nw - w) * (nv - v) END AS v FROM di),
e AS (SELECT min(d) AS a, max(d) AS b FROM dv), ex AS (SELECT f, v, d, CAST(unnest(generate_series(d, least(d + 83, b), INTERVAL 1 DAY)) AS DATE) AS we FROM dv, e),
pw AS (SELECT f, we, (we - d) // 7 AS k, avg(v) AS v FROM ex GROUP BY 1, 2, 3 HAVING count(*) = 7)
SELECT f AS frame, we AS window_end, round(avg(v), 6) + 0 AS proportion, count(*) AS weeks FROM pw GROUP BY 1, 2 HAVING count(*) >= 11""")
def sliding_weeks(spark, sf):
    w = series.weekly(daily(spark, sf), "f", "d")
    d = series.interpolate_daily(w, "f", "week", "proportion")
    got = series.sliding_weeks(d, "f", "week", "proportion")
    return got.select(F.col("f").alias("frame"), "window_end", rounded(F.col("proportion")).alias("proportion"), "weeks")


@query("half_life", f"""WITH {DAILY}, dv AS (SELECT f, d, p - avg(p) OVER (PARTITION BY f ORDER BY d ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) AS x FROM s),
pr AS (SELECT f, x, lag(x) OVER (PARTITION BY f ORDER BY d) AS y FROM dv), r AS (SELECT f, corr(x, y) AS rho FROM pr GROUP BY f)
SELECT f AS frame, round(rho, 6) + 0 AS rho, round(CASE WHEN rho > 0 AND rho < 1 THEN ln(0.5) / ln(rho) END, 6) AS half_life FROM r""")
def half_life(spark, sf):
    return series.half_life(daily(spark, sf), "f", "d", "proportion").select(F.col("f").alias("frame"), rounded(F.col("rho")).alias("rho"), rounded(F.col("half_life")).alias("half_life"))


@query("linear_trend", f"WITH {DAILY}, y AS (SELECT f, year(d) AS yr, avg(p) AS p FROM s GROUP BY 1, 2) SELECT f AS frame, round(regr_slope(p, yr), 8) + 0 AS slope, round(regr_r2(p, yr), 6) AS r2, count(*) AS years FROM y GROUP BY f")
def linear_trend(spark, sf):
    y = daily(spark, sf).groupBy("f", F.year("d").alias("yr")).agg(F.avg("proportion").alias("p"))
    got = y.groupBy(F.col("f").alias("frame")).agg(F.regr_slope("p", "yr").alias("slope"), F.regr_r2("p", "yr").alias("r2"), F.count("*").alias("years"))
    return got.select("frame", rounded(F.col("slope"), 8).alias("slope"), rounded(F.col("r2")).alias("r2"), "years")


@query("yearly_pivot", f"WITH {ARTICLES} SELECT year(d) AS yr, count(*) FILTER (f = '1-URGENT') AS urgent, count(*) FILTER (f = '2-HIGH') AS high, count(*) FILTER (f = '5-LOW') AS low FROM o GROUP BY 1")
def yearly_pivot(spark, sf):
    got = articles(spark, sf).groupBy(F.year("d").alias("yr")).pivot("f", ["1-URGENT", "2-HIGH", "5-LOW"]).count().fillna(0)
    return got.withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query("decade_totals", f"""WITH {ARTICLES} SELECT CASE WHEN grouping(dc) = 1 THEN 'Total' ELSE CAST(dc AS VARCHAR) END AS decade, count(*) AS n, round(quantile_cont(v, 0.5), 4) AS median
FROM (SELECT CAST(floor(year(d) / 10) * 10 AS INTEGER) AS dc, v FROM o) GROUP BY ROLLUP (dc)""")
def decade_totals(spark, sf):
    a = articles(spark, sf).withColumn("decade", decade(F.year("d")))
    return relational.with_total(a, "decade", [F.count("*").alias("n"), F.round(F.percentile("v", F.lit(0.5)), 4).alias("median")])


@query("era_shares", f"""WITH {ARTICLES}, e AS (SELECT CASE WHEN year(d) >= 2000 THEN 'late' WHEN year(d) >= 1997 THEN 'middle' WHEN year(d) >= 1995 THEN 'early' END AS era, f FROM o), n AS (SELECT era, f, count(*) AS n FROM e GROUP BY 1, 2)
SELECT era, f AS frame, n, round(n / sum(n) OVER (PARTITION BY era), 6) AS share FROM n""")
def era_shares(spark, sf):
    from pyspark.sql import Window

    n = articles(spark, sf).withColumn("era", era(F.year("d"), [(1995, "early"), (1997, "middle"), (2000, "late")])).groupBy("era", F.col("f").alias("frame")).agg(F.count("*").alias("n"))
    return n.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("era"))))


@query("trailing_sums", f"WITH {DAILY} SELECT f AS frame, d AS day, CAST(sum(n) OVER a AS BIGINT) AS sum_14, CAST(sum(n) OVER b AS BIGINT) AS sum_30, n - lag(n) OVER x AS step FROM s WINDOW x AS (PARTITION BY f ORDER BY d), a AS (PARTITION BY f ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), b AS (PARTITION BY f ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def trailing_sums(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("f").orderBy("d")
    return daily(spark, sf).select(F.col("f").alias("frame"), F.col("d").alias("day"), F.sum("n").over(w.rowsBetween(-13, 0)).alias("sum_14"), F.sum("n").over(w.rowsBetween(-29, 0)).alias("sum_30"), (F.col("n") - F.lag("n").over(w)).alias("step"))


@query("dominance_rank", f"WITH {DAILY}, y AS (SELECT f, year(d) AS yr, sum(n) AS n FROM s GROUP BY 1, 2) SELECT f AS frame, yr, CAST(n AS BIGINT) AS n, rank() OVER x AS rnk, round(percent_rank() OVER x, 6) AS pct FROM y WINDOW x AS (PARTITION BY yr ORDER BY n DESC)")
def dominance_rank(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("yr").orderBy(F.desc("n"))
    y = daily(spark, sf).groupBy(F.col("f").alias("frame"), F.year("d").alias("yr")).agg(F.sum("n").alias("n"))
    return y.select("frame", "yr", "n", F.rank().over(w).alias("rnk"), rounded(F.percent_rank().over(w)).alias("pct"))
