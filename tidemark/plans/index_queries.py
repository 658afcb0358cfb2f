"""Queries of the indices: profiles, sources, places, and what joins them; with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import graphs, stats
from ..functions.exprs import cosine, entropy, rounded
from ..operators import relational as rel
from ..operators import series, vectors
from . import detect_queries as dq
from .tables import ARTICLES, DAILY, articles, daily, events, table

Q: dict = {}
SQL: dict = {}
DIM = 64


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("day_documents", f"WITH {ARTICLES} SELECT f AS frame, d AS day, count(DISTINCT k) AS n, string_agg(k, ',' ORDER BY k) AS docs FROM (SELECT DISTINCT f, d, k FROM o) GROUP BY 1, 2")
def day_documents(spark, sf):
    x = articles(spark, sf).groupBy(F.col("f").alias("frame"), F.col("d").alias("day")).agg(F.array_sort(F.collect_set("k")).alias("ks"))
    return x.select("frame", "day", F.size("ks").cast("long").alias("n"), F.array_join(F.transform("ks", lambda k: k.cast("string")), ",").alias("docs"))


@query("article_profiles", """WITH x AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS m, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT k, n, round(a / n, 6) AS share_a, round(m / n, 6) AS share_n, round(r / n, 6) AS share_r, CASE WHEN a >= m AND a >= r THEN 'A' WHEN m >= r THEN 'N' ELSE 'R' END AS dominant,
round(-(CASE WHEN a > 0 THEN a / n * ln(a / n) ELSE 0 END) - (CASE WHEN m > 0 THEN m / n * ln(m / n) ELSE 0 END) - (CASE WHEN r > 0 THEN r / n * ln(r / n) ELSE 0 END), 6) + 0 AS entropy FROM x""")
def article_profiles(spark, sf):
    """Shares of each kind of row in an article, the first of the most frequent, and their entropy."""
    n = lambda v: F.count(F.when(F.col("l_returnflag") == v, 1)).cast("double")
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), n("A").alias("a"), n("N").alias("m"), n("R").alias("r"))
    top = F.when((F.col("a") >= F.col("m")) & (F.col("a") >= F.col("r")), "A").when(F.col("m") >= F.col("r"), "N").otherwise("R")
    return x.select("k", "n", *[rounded(F.col(c) / F.col("n")).alias(f"share_{s}") for c, s in (("a", "a"), ("m", "n"), ("r", "r"))], top.alias("dominant"), rounded(entropy(F.array("a", "m", "r"))).alias("entropy"))


@query("frame_statistics", """WITH x AS (SELECT l_orderkey, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT count(DISTINCT l_orderkey) AS t FROM lineitem)
SELECT f AS frame, count(*) AS articles, round(count(*) / max(t), 6) AS prevalence, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, max(n) AS most FROM x, t GROUP BY f""")
def frame_statistics(spark, sf):
    """Prevalence of a frame among articles, and its count's mean, deviation and maximum among those that carry it."""
    x = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("frame")).agg(F.count("*").alias("n"))
    t = table(spark, sf, "lineitem").agg(F.count_distinct("l_orderkey").alias("t"))
    return x.crossJoin(F.broadcast(t)).groupBy("frame").agg(F.count("*").alias("articles"), rounded(F.count("*") / F.max("t")).alias("prevalence"), rounded(F.avg("n")).alias("mean"), rounded(F.stddev_pop("n")).alias("std"), F.max("n").alias("most"))


@query("sentiment_timeline", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, round(avg(value), 6) + 0 AS mean, round(avg(CASE WHEN value > 50 THEN 1 WHEN value < 10 THEN -1 ELSE 0 END), 6) + 0 AS tone, count(*) AS n FROM events GROUP BY 1, 2")
def sentiment_timeline(spark, sf):
    tone = F.when(F.col("value") > 50, 1).when(F.col("value") < 10, -1).otherwise(0)
    e = events(spark, sf).groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("week"))
    return e.agg(rounded(F.avg("value")).alias("mean"), rounded(F.avg(tone)).alias("tone"), F.count("*").alias("n"))


@query("emotional_convergence", "WITH w AS (SELECT date_trunc('week', ts) AS w, var_pop(value) AS v FROM events GROUP BY 1) SELECT round(arg_min(v, w), 4) AS first_variance, round(arg_max(v, w), 4) AS last_variance, round(1 - arg_max(v, w) / arg_min(v, w), 6) + 0 AS convergence FROM w")
def emotional_convergence(spark, sf):
    w = events(spark, sf).groupBy(F.date_trunc("week", "ts").alias("w")).agg(F.var_pop("value").alias("v"))
    a, b = F.min_by("v", "w"), F.max_by("v", "w")
    return w.agg(F.round(a, 4).alias("first_variance"), F.round(b, 4).alias("last_variance"), rounded(1 - b / a).alias("convergence"))


GEO = "g AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS f, n_nationkey AS p, n_name AS pn, n_regionkey AS r, r_name AS rn, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _geo(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("f"), F.col("n_nationkey").alias("p"), F.col("n_name").alias("pn"), F.col("n_regionkey").alias("r"), F.col("r_name").alias("rn"), F.col("o_custkey").alias("c"))


@query("daily_place_entropy", f"""WITH {GEO}, n AS (SELECT d, p, count(*) AS n FROM g GROUP BY 1, 2), q AS (SELECT d, n, n / sum(n) OVER (PARTITION BY d) AS q FROM n), e AS (SELECT d, -sum(q * log2(q)) AS e FROM q GROUP BY d)
SELECT d AS day, round(e, 6) + 0 AS entropy, round(abs(e - lag(e) OVER (ORDER BY d)), 6) AS volatility FROM e""")
def daily_place_entropy(spark, sf):
    n = _geo(spark, sf).groupBy("d", "p").agg(F.count("*").alias("n"))
    q = n.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("d"))).groupBy("d").agg((-F.sum(F.col("q") * F.log2("q"))).alias("e"))
    return q.select(F.col("d").alias("day"), rounded(F.col("e")).alias("entropy"), rounded(F.abs(F.col("e") - F.lag("e").over(Window.orderBy("d")))).alias("volatility"))  # one row a day


@query("sustained_focus", f"""WITH {GEO}, n AS (SELECT d, r, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT d, r, n / sum(n) OVER (PARTITION BY d) AS s FROM n), h AS (SELECT r, d FROM t WHERE s >= 0.35),
i AS (SELECT r, d, sum(st) OVER (PARTITION BY r ORDER BY d) AS g FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r ORDER BY d) <= 1 THEN 0 ELSE 1 END AS st FROM h))
SELECT r AS region, min(d) AS start_day, max(d) AS end_day, count(*) AS days FROM i GROUP BY r, g HAVING count(*) >= 3""")
def sustained_focus(spark, sf):
    """Runs of three days and more on which a region has over a third of the rows."""
    n = _geo(spark, sf).groupBy("d", "r").agg(F.count("*").alias("n"))
    t = n.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("d")))
    return series.islands(t, ["r"], "d", "s", 0.35, 3).select(F.col("r").alias("region"), "start_day", "end_day", "days")


@query("spread_progression", f"""WITH {GEO}, s AS (SELECT f, d, count(DISTINCT r) / 5 AS s FROM g GROUP BY 1, 2), m AS (SELECT f, d, s, max(s) OVER (PARTITION BY f ORDER BY d ROWS UNBOUNDED PRECEDING) AS best FROM s)
SELECT f AS frame, min(d) FILTER (s >= 1) AS national_since, count(*) AS days, round(avg(s), 6) AS mean_spread, count(*) FILTER (s = best) AS days_at_best FROM m GROUP BY f""")
def spread_progression(spark, sf):
    s = _geo(spark, sf).groupBy("f", "d").agg((F.count_distinct("r") / 5).alias("s"))
    m = s.withColumn("best", F.max("s").over(Window.partitionBy("f").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(F.col("f").alias("frame")).agg(F.min(F.when(F.col("s") >= 1, F.col("d"))).alias("national_since"), F.count("*").alias("days"), rounded(F.avg("s")).alias("mean_spread"), F.count_if(F.col("s") == F.col("best")).alias("days_at_best"))


@query("frame_geography", f"""WITH {GEO}, n AS (SELECT f, rn, count(*) AS n FROM g GROUP BY 1, 2), e AS (SELECT f, rn, n, sum(n) OVER (PARTITION BY f) * sum(n) OVER (PARTITION BY rn) / sum(n) OVER () AS e FROM n)
SELECT f AS frame, rn AS region, n, round(e, 4) AS expected, round((n - e) / sqrt(e), 6) + 0 AS residual FROM e""")
def frame_geography(spark, sf):
    """Rows of a frame in a region against what their margins lead to expect."""
    n = _geo(spark, sf).groupBy(F.col("f").alias("frame"), F.col("rn").alias("region")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # frames times regions
    e = n.withColumn("e", F.sum("n").over(Window.partitionBy("frame")) * F.sum("n").over(Window.partitionBy("region")) / total)
    return e.select("frame", "region", "n", F.round("e", 4).alias("expected"), rounded((F.col("n") - F.col("e")) / F.sqrt("e")).alias("residual"))


@query("barrier_balance", f"""WITH {GEO}, x AS (SELECT d, count(*) FILTER (r < 2) AS a, count(*) AS n FROM g GROUP BY d), y AS (SELECT d, n, a / n AS p FROM x)
SELECT d AS day, n, round(p, 6) AS share, round(CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END, 6) + 0 AS balance FROM y""")
def barrier_balance(spark, sf):
    """How evenly two sides of a barrier (here regions 0 and 1 against the rest) take part each day: entropy of the split."""
    x = _geo(spark, sf).groupBy(F.col("d").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("r") < 2).alias("a")).withColumn("p", F.col("a") / F.col("n"))
    h = F.when((F.col("p") > 0) & (F.col("p") < 1), -F.col("p") * F.log2("p") - (1 - F.col("p")) * F.log2(1 - F.col("p"))).otherwise(0.0)
    return x.select("day", "n", rounded(F.col("p")).alias("share"), rounded(h).alias("balance"))


@query("neighbour_effects", f"""WITH {GEO}, t AS (SELECT DISTINCT f, d, p, r FROM g), c AS (SELECT f, d, r, count(*) AS k FROM t GROUP BY 1, 2, 3), s AS (SELECT r_regionkey AS r, count(*) AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT f AS frame, d AS day, round(sum(k * (k - 1)) / (sum(k) * (sum(k) - 1)), 6) AS adjacent FROM c JOIN s USING (r) GROUP BY 1, 2 HAVING sum(k) > 1""")
def neighbour_effects(spark, sf):
    """Of the pairs of nations that a frame reaches on a day, the share that are neighbours (of one region)."""
    c = _geo(spark, sf).select("f", "d", "p", "r").distinct().groupBy("f", "d", "r").agg(F.count("*").alias("k"))
    g = c.groupBy(F.col("f").alias("frame"), F.col("d").alias("day")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("x")).where("n > 1")
    return g.select("frame", "day", rounded(F.col("x") / (F.col("n") * (F.col("n") - 1))).alias("adjacent"))


@query("dominant_attributes", f"WITH {ARTICLES}, n AS (SELECT c, f, count(*) AS n FROM o GROUP BY 1, 2) SELECT c AS actor, string_agg(f || '=' || n, ',' ORDER BY n DESC, f) AS counts FROM n GROUP BY c")
def dominant_attributes(spark, sf):
    n = articles(spark, sf).groupBy("c", "f").agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "f")))
    return n.groupBy(F.col("c").alias("actor")).agg(F.array_join(F.transform(s, lambda x: F.concat(x["f"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("counts"))


@query("full_outer_summary", "WITH a AS (SELECT o_custkey AS c, count(*) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT c_custkey AS c, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000) SELECT c, orders, balance FROM a FULL JOIN b USING (c)")
def full_outer_summary(spark, sf):
    a = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("orders"))
    b = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("balance"))
    return a.join(b, "c", "full")


@query("triple_chains", """SELECT s_nationkey AS a, o_orderpriority AS b, c_nationkey AS c, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def triple_chains(spark, sf):
    """Chains of two equality joins, from a source over a group to a target, with their joint strength."""
    li, o, s, c = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    return x.groupBy(F.col("s_nationkey").alias("a"), F.col("o_orderpriority").alias("b"), F.col("c_nationkey").alias("c")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("strength"))


@query("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_operations(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    c = table(spark, sf, "customer")
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("both", o.intersect(c.where("c_acctbal > 0").select("c_custkey"))).unionByName(n("only", c.select("c_custkey").subtract(o))).unionByName(n("either", o.union(c.where("c_acctbal < 0").select("c_custkey")).distinct()))


@query("lag_summary", f"""WITH {ARTICLES}, l AS (SELECT f, d - lag(d) OVER (PARTITION BY c, f ORDER BY d, k) AS x, v FROM o) SELECT f AS frame, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(sum(x * v) FILTER (x IS NOT NULL) / sum(v) FILTER (x IS NOT NULL), 6) AS weighted FROM l GROUP BY f""")
def lag_summary(spark, sf):
    x = articles(spark, sf).withColumn("x", F.datediff("d", F.lag("d").over(Window.partitionBy("c", "f").orderBy("d", "k"))))
    w = F.sum(F.col("x") * F.col("v")) / F.sum(F.when(F.col("x").isNotNull(), F.col("v")))
    return x.groupBy(F.col("f").alias("frame")).agg(F.count("x").alias("n"), rounded(F.avg("x")).alias("mean"), rounded(F.percentile("x", F.lit(0.5))).alias("median"), rounded(w).alias("weighted"))


DATED = """e AS (SELECT vec_id, label, CAST(ts AS DATE) AS d, abs(value) AS w, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings JOIN events ON vec_id = event_id),
u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"""


def _dated(spark, sf):
    v, e = table(spark, sf, "embeddings"), table(spark, sf, "events")
    return v.join(e, v.vec_id == e.event_id).select("vec_id", "label", F.to_date("ts").alias("d"), F.abs("value").alias("w"), "embedding")


@query("daily_likeness", f"""WITH {DATED}, s AS (SELECT d, label, list(x ORDER BY i) AS s, max(n) AS n FROM (SELECT d, label, i, sum(u[i]) AS x, count(*) AS n FROM u, range(1, 65) t(i) GROUP BY d, label, i) GROUP BY d, label)
SELECT d AS day, label, n, round(CASE WHEN n > 1 THEN (list_dot_product(s, s) - n) / (n * (n - 1)) ELSE 0 END, 6) + 0 AS similarity FROM s""")
def daily_likeness(spark, sf):
    x = vectors.mean_pairwise(_dated(spark, sf), ["d", "label"], "embedding", DIM)
    return x.select(F.col("d").alias("day"), "label", "n", rounded(F.col("similarity")).alias("similarity"))


@query("semantic_proximity", f"""WITH {DATED}, q AS (SELECT label, quantile_cont(w, 0.75) AS q FROM e GROUP BY label), c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT e.label, i, sum(v[i] * w) / sum(w) AS x FROM e JOIN q USING (label), range(1, 65) t(i) WHERE w >= q GROUP BY e.label, i) GROUP BY label)
SELECT d AS day, c.label, count(*) AS n, round(avg(list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c))), 6) + 0 AS proximity FROM e CROSS JOIN c GROUP BY 1, 2""")
def semantic_proximity(spark, sf):
    """Mean cosine of all rows of a day with the centre of each label's strongest quarter."""
    e = _dated(spark, sf)
    c = vectors.top_quartile_centroid(e, "label", "w", "embedding", DIM).drop("n")
    x = e.drop("label").crossJoin(rel.small(c, 1000))  # a row for each label
    return x.groupBy(F.col("d").alias("day"), "label").agg(F.count("*").alias("n"), rounded(F.avg(cosine(F.col("embedding"), F.col("centroid")))).alias("proximity"))


@query("semantic_peak", f"""WITH {DATED}, c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
x AS (SELECT label, d - DATE '1970-01-01' AS x, sum(w * greatest(0, list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c)))) AS m FROM e JOIN c USING (label) GROUP BY 1, 2 HAVING m > 0),
q AS (SELECT label, x, (sum(m) OVER (PARTITION BY label ORDER BY x) - m / 2) / sum(m) OVER (PARTITION BY label) AS q FROM x), l AS (SELECT *, lead(x) OVER (PARTITION BY label ORDER BY x) AS nx, lead(q) OVER (PARTITION BY label ORDER BY x) AS nq FROM q)
SELECT label, CAST(DATE '1970-01-01' + CAST(round(coalesce(max(CASE WHEN q <= 0.5 AND nq > 0.5 THEN x + (0.5 - q) / (nq - q) * (nx - x) END), CASE WHEN min(q) > 0.5 THEN min(x) ELSE max(x) END)) AS INTEGER) AS DATE) AS peak FROM l GROUP BY label""")
def semantic_peak(spark, sf):
    """The day by which half of a label's semantic mass (strength times likeness to its centre) has come."""
    from ..operators.ranks import weighted_percentile

    e = vectors.centroid_similarity(_dated(spark, sf), "label", "embedding", DIM)
    m = e.withColumns({"mass": F.col("w") * F.greatest(F.col("similarity"), F.lit(0.0)), "x": F.datediff("d", F.lit("1970-01-01").cast("date")).cast("double")})
    p = weighted_percentile(m, ["label"], "x", "mass", 0.5)
    return p.select("label", F.date_add(F.lit("1970-01-01").cast("date"), F.round("percentile").cast("int")).alias("peak"))


@query("spreading_simulations")
def spreading_simulations(spark, sf):
    """Seeded SIR, independent cascade and linear threshold runs on the graph of each region, from its busiest node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = graphs.Graph(pdf["src"], pdf["dst"])
        s = [int(np.argmax(g.degree))]
        sir = graphs.spread_sir(g, s)
        rows = [("sir", len(sir) - 1, sir[-1][2] + sir[-1][1]), ("cascade", 0, len(graphs.spread_cascade(g, s))), ("threshold", 0, len(graphs.spread_threshold(g, s, 0.2)))]
        return pd.DataFrame([(str(pdf["graph"].iloc[0]), *r) for r in rows], columns=["graph", "model", "steps", "reached"])

    return dq.regional_edges(spark, sf).groupBy("graph").applyInPandas(run, "graph string, model string, steps int, reached int")


@query("projection")
def projection(spark, sf):
    """Suppliers' standardised features on their first two principal components."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    li = table(spark, sf, "lineitem")
    f = li.groupBy("l_suppkey").agg(F.count("*").cast("double").alias("a"), F.avg("l_quantity").alias("b"), F.avg("l_discount").alias("c"), F.avg("l_tax").alias("e"), F.stddev_pop("l_extendedprice").alias("g"))
    x = VectorAssembler(inputCols=["a", "b", "c", "e", "g"], outputCol="x").transform(f)
    x = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(x).transform(x)
    y = PCA(k=2, inputCol="z", outputCol="p").fit(x).transform(x)
    return y.select("l_suppkey", vector_to_array("p").alias("p")).select("l_suppkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("smoothed_trend", f"""WITH {DAILY}, w AS (SELECT f, week, p, row_number() OVER (PARTITION BY f ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM (SELECT f, CAST(d + CAST((7 - isodow(d)) AS INTEGER) AS DATE) AS week, avg(p) AS p FROM s GROUP BY 1, 2)),
a AS (SELECT a.f, a.week, a.n, b.i - a.i AS x, b.p AS y, row_number() OVER (PARTITION BY a.f, a.week ORDER BY abs(b.i - a.i), b.i) AS r FROM w a JOIN w b ON a.f = b.f), h AS (SELECT f, week, max(abs(x)) AS h FROM a WHERE r <= greatest(3, n // 2) GROUP BY 1, 2),
k AS (SELECT f, week, x, y, greatest(0, 1 - (abs(x) / h) ** 3) ** 3 AS w FROM a JOIN h USING (f, week)) SELECT f, week, round((sum(w * y) * sum(w * x * x) - sum(w * x) * sum(w * x * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2), 6) + 0.0 AS trend FROM k GROUP BY f, week""")
def smoothed_trend(spark, sf):
    """Locally weighted line (half of the weeks, tricube weights) through each frame's weekly share."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        y, x = pdf["proportion"].to_numpy(float), np.arange(len(pdf), dtype=float)
        k, out = max(3, len(x) // 2), []
        for i in x:
            d = np.abs(x - i)
            w = np.clip(1 - (d / np.sort(d)[k - 1]) ** 3, 0, None) ** 3
            fit = stats.ols(y * np.sqrt(w), np.column_stack([np.ones(len(x)), x - i]) * np.sqrt(w)[:, None])
            out.append(float(fit.beta[0]))
        return pd.DataFrame({"f": pdf["f"], "week": pdf["week"], "trend": out})

    return series.weekly(daily(spark, sf), "f", "d").select("f", "week", "proportion").groupBy("f").applyInPandas(run, "f string, week date, trend double").withColumn("trend", rounded(F.col("trend")))


@query("quarter_resample", f"WITH {DAILY} SELECT f AS frame, CAST(date_trunc('quarter', d) AS DATE) AS quarter, CAST(sum(n) AS BIGINT) AS n, round(avg(p), 6) AS proportion FROM s GROUP BY 1, 2")
def quarter_resample(spark, sf):
    return daily(spark, sf).groupBy(F.col("f").alias("frame"), F.trunc("d", "quarter").alias("quarter")).agg(F.sum("n").alias("n"), rounded(F.avg("proportion")).alias("proportion"))
