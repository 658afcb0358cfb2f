"""The driver's tables in the library's terms: rows with a key, day, actor, outlet and group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles: k, d, f (priority, as frame), c (customer, as author), s (status), v (price)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("f"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_proportions(articles(spark, sf_dir), "k", "d", "f")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))


def vocabulary(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The values of a closed vocabulary, sorted; more than ``most`` are refused."""
    got = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(got)


ARTICLES = """o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS f, o_custkey AS c, o_orderstatus AS s, o_totalprice AS v FROM orders)"""

DAILY = ARTICLES + """,
cal AS (SELECT f, d FROM (SELECT DISTINCT f FROM o), (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM o)),
s AS (SELECT f, d, coalesce(n, 0) AS n, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) > 0 THEN coalesce(n, 0) / total ELSE 0 END AS p
      FROM cal LEFT JOIN (SELECT f, d, count(DISTINCT k) AS n FROM o GROUP BY f, d) USING (f, d) LEFT JOIN (SELECT d, count(DISTINCT k) AS total FROM o GROUP BY d) USING (d))"""


def normal_tail(z: str) -> str:
    """SQL of the upper tail of the standard normal at z, by Simpson's rule."""
    return f"(SELECT 0.5 - sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(({z}) * i / 1000) * (({z}) * i / 1000) / 2)) * ({z}) / 3000 / sqrt(2 * pi()) FROM range(0, 1001) q(i))"


def student_tail(t: str, df: str) -> str:
    """SQL of the upper tail of Student's t with df degrees of freedom."""
    return f"(SELECT 0.5 - exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * ({t}) / 3000 * sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * (1 + (({t}) * i / 1000) ** 2 / ({df})) ** (-(({df}) + 1) / 2)) FROM range(0, 1001) q(i))"


def fisher_tail(a: str, b: str, c: str, d: str) -> str:
    """SQL of the exact two-sided p of a 2 x 2 table."""
    n, r, k = f"({a} + {b} + {c} + {d})", f"({a} + {b})", f"({a} + {c})"
    choose = lambda x, y: f"(lgamma({x} + 1) - lgamma({y} + 1) - lgamma({x} - {y} + 1))"
    log = lambda i: f"{choose(k, i)} + {choose(f'({n} - {k})', f'({r} - {i})')} - {choose(n, r)}"
    return f"least(1, (SELECT sum(exp({log('i')})) FROM range(greatest(0, {r} + {k} - {n}), least({r}, {k}) + 1) q(i) WHERE exp({log('i')}) <= exp({log(a)}) * (1 + 1e-7)))"


def odds(a: str, b: str, c: str, d: str) -> str:
    """SQL of odds, low, high of a 2 x 2 table: Woolf's interval, half a row added where a cell is empty."""
    h = f"(CASE WHEN least({a}, {b}, {c}, {d}) = 0 THEN 0.5 ELSE 0 END)"
    o, e = f"(({a} + {h}) * ({d} + {h}) / (({b} + {h}) * ({c} + {h})))", f"1.959963984540054 * sqrt(1 / ({a} + {h}) + 1 / ({b} + {h}) + 1 / ({c} + {h}) + 1 / ({d} + {h}))"
    return f"round({o}, 6) + 0.0 AS odds, round(exp(ln({o}) - {e}), 6) + 0.0 AS low, round(exp(ln({o}) + {e}), 6) + 0.0 AS high"


#: Windows of the days above each group's 90th percentile, of a table s(f, d, p): b(burst_id, f, onset, "end").
WINDOWS = """q AS (SELECT f, quantile_cont(p, 0.9) AS lim FROM s GROUP BY f),
m AS (SELECT s.f, d, p, p > lim AS above, lead(d) OVER x AS nd, CASE WHEN p > lim AND NOT coalesce(lag(p) OVER x > lim, false) THEN 1 ELSE 0 END AS st FROM s JOIN q USING (f) WINDOW x AS (PARTITION BY s.f ORDER BY d)),
i AS (SELECT *, sum(st) OVER (PARTITION BY f ORDER BY d) AS g FROM m),
b AS MATERIALIZED (SELECT f || ':' || CAST(min(d) AS VARCHAR) AS burst_id, f, min(d) AS onset, coalesce(max(nd), max(d)) AS "end" FROM i WHERE above GROUP BY f, g)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(burst_id, f, onset, end): windows of the days above each frame's 90th percentile."""
    b = series.threshold_bursts(daily(spark, sf_dir), "f", "d", "proportion")
    return b.select(F.concat_ws(":", "f", F.col("start_day").cast("string")).alias("burst_id"), "f", F.col("start_day").alias("onset"), F.col("end_day").alias("end"))
