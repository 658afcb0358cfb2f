"""Queries over annotated rows: aggregates, joins, indices; with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import blocking_keys, clean_author, clean_entity, normal_name, rounded, tag_present
from ..operators import relational as rel
from ..operators import series
from .tables import ARTICLES, articles, daily, events, table, vocabulary

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("article_aggregate", """SELECT l_orderkey, arg_min(l_shipdate, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag)) AS shipdate_first, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag)) AS returnflag_first, round(sum(l_quantity), 4) AS quantity_sum, round(avg(l_quantity), 6) AS quantity_mean,
round(sum(l_discount), 4) AS discount_sum, round(avg(l_discount), 6) AS discount_mean, count(*) AS n_rows FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""")
def article_aggregate(spark, sf):
    got = rel.to_articles(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"], ["l_shipdate", "l_returnflag"], ["l_quantity", "l_discount"])
    return got.select("l_orderkey", F.col("l_shipdate_first").alias("shipdate_first"), F.col("l_returnflag_first").alias("returnflag_first"), F.round("l_quantity_sum", 4).alias("quantity_sum"), F.round("l_quantity_mean", 6).alias("quantity_mean"), F.round("l_discount_sum", 4).alias("discount_sum"), F.round("l_discount_mean", 6).alias("discount_mean"), "n_rows")


@query("binarise_and_dominant", """SELECT l_orderkey, l_linenumber, a, b, c, a + b + c AS n_flags, CASE WHEN a > 0 THEN 'a' WHEN b > 0 THEN 'b' WHEN c > 0 THEN 'c' END AS dominant
FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.05 AS INTEGER) AS a, CAST(l_tax > 0.04 AS INTEGER) AS b, CAST(l_quantity > 25 AS INTEGER) AS c FROM lineitem)""")
def binarise_and_dominant(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.col("l_discount") - 0.05 - 1e-12, F.lit(0)).alias("a"), F.greatest(F.col("l_tax") - 0.04 - 1e-12, F.lit(0)).alias("b"), F.when(F.col("l_quantity") > 25, "1").otherwise("none").alias("c"))
    return rel.binarise(x, ["a", "b", "c"], "n_flags", "dominant")


@query("date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, week(o_orderdate) AS w, isodow(o_orderdate) - 1 AS dow FROM orders WHERE o_orderdate IS NOT NULL")
def date_parts(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate is not null").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.weekofyear("o_orderdate").cast("long").alias("w"), F.weekday("o_orderdate").cast("long").alias("dow"))


@query("rows_per_article", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS article_length FROM lineitem")
def rows_per_article(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(Window.partitionBy("l_orderkey")).alias("article_length"))


@query("frame_proportions", "SELECT l_orderkey, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS returned, round(avg(CAST(l_linestatus = 'O' AS INTEGER)), 6) AS open FROM lineitem GROUP BY 1")
def frame_proportions(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("returned"), F.round(F.avg((F.col("l_linestatus") == "O").cast("int")), 6).alias("open"))


@query("active_weeks", f"""WITH {ARTICLES}, w AS (SELECT week(d) AS w FROM o GROUP BY 1 HAVING count(DISTINCT k) >= 250 AND count(DISTINCT c) >= 200) SELECT k, d FROM o WHERE week(d) IN (SELECT w FROM w)""")
def active_weeks(spark, sf):
    """Rows of the weeks, counted over all years, with 250 orders and 200 customers or more."""
    return rel.active_periods(articles(spark, sf), F.weekofyear("d"), {"k": 250, "c": 200}).select("k", "d")


@query("json_entities_explode", "SELECT event_id, unnest(json_keys(props)) AS type, json_extract_string(props, '$.' || unnest(json_keys(props))) AS name FROM events WHERE json_valid(props)")
def json_entities_explode(spark, sf):
    return rel.explode_entities(table(spark, sf, "events"), ["event_id"], "props")


@query("entity_index", """WITH e AS (SELECT json_extract_string(props, '$.k') AS name, event_id, CAST(ts AS DATE) AS d, user_id, event_type FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL)
SELECT name, count(*) AS mentions, count(DISTINCT event_id) AS n_docs, count(DISTINCT user_id) AS n_actors, count(DISTINCT event_type) AS n_outlets, min(d) AS first_seen, max(d) AS last_seen,
round(count(*) * ln(1 + count(DISTINCT user_id) + count(DISTINCT event_type)), 6) AS authority FROM e GROUP BY name""")
def entity_index(spark, sf):
    e = events(spark, sf)
    m = rel.explode_entities(e, ["event_id", "d", "user_id", "event_type"], "props").where("type = 'k'")
    return rel.entity_index(m, ["name"], "event_id", "d", "user_id", "event_type").withColumn("authority", rounded(F.col("authority")))


@query("author_normalise", "SELECT c_custkey, trim(coalesce(c_name, '')) AS author, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9À-ɏ'' -]', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM customer")
def author_normalise(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", clean_author(F.col("c_name")).alias("author"), normal_name(F.col("c_name")).alias("normal"))


@query("entity_cleaning", """SELECT p_partkey, regexp_replace(trim(p_name), '^[.,;:!?''"()\\[\\]-]+|[.,;:!?''"()\\[\\]-]+$', '', 'g') AS entity FROM part""")
def entity_cleaning(spark, sf):
    return table(spark, sf, "part").select("p_partkey", clean_entity(F.col("p_name")).alias("entity"))


@query("blocking_keys", """WITH n AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9À-ɏ'' -]', ' ', 'g'), ' +', ' ', 'g')) AS n FROM customer)
SELECT c_custkey, unnest(list_distinct(['f:' || split_part(n, ' ', 1), 'l:' || string_split(n, ' ')[-1], 'p:' || substr(n, 1, 4), 'c:' || substr(regexp_replace(n, '[aeiouy ]', '', 'g'), 1, 4)])) AS key FROM n""")
def blocking(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.explode(blocking_keys(F.col("c_name"))).alias("key"))


@query("tag_present", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AS red FROM part")
def tags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tag_present(F.col("p_name"), "red", " ").alias("red"))


@query("text_like_sums", "SELECT lang, count(*) FILTER (text ILIKE '%license%') AS licence_docs, count(*) FILTER (text ILIKE '%@%') AS mail_docs, count(*) AS n FROM documents GROUP BY lang")
def text_like_sums(spark, sf):
    d = table(spark, sf, "documents")
    like = lambda p: F.count(F.when(F.col("text").ilike(p), 1))
    return d.groupBy("lang").agg(like("%license%").alias("licence_docs"), like("%@%").alias("mail_docs"), F.count("*").alias("n"))


LINES = "x AS (SELECT DISTINCT l_orderkey AS k, p_brand AS m FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _brands(spark, sf):
    li, p = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("m"))


@query("cooccurrence_matrix_normalised", f"""WITH {LINES}, p AS (SELECT a.m AS a, b.m AS b, count(*) AS n FROM x a JOIN x b USING (k) GROUP BY 1, 2)
SELECT p.a, p.b, p.n, round(p.n / sqrt(da.n * db.n), 6) AS similarity FROM p JOIN p da ON da.a = p.a AND da.b = p.a JOIN p db ON db.a = p.b AND db.b = p.b""")
def cooccurrence(spark, sf):
    return rel.cooccurrence(_brands(spark, sf), "k", "m").withColumn("similarity", rounded(F.col("similarity")))


@query("frequent_itemsets", f"""WITH {LINES}, t AS (SELECT count(DISTINCT k) AS t FROM x), p AS (SELECT a.m || '|' || b.m AS items, 2 AS size, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND a.m < b.m GROUP BY 1),
q AS (SELECT a.m || '|' || b.m || '|' || c.m AS items, 3 AS size, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND a.m < b.m JOIN x c ON b.k = c.k AND b.m < c.m GROUP BY 1)
SELECT items, size, n, round(n / t, 6) AS support FROM (SELECT * FROM p UNION ALL SELECT * FROM q), t WHERE n >= 0.01 * t""")
def frequent_itemsets(spark, sf):
    return rel.itemsets(_brands(spark, sf), "k", "m").withColumn("support", rounded(F.col("support")))


@query("weekly_pair_cooccurrence", f"""WITH w AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS wk, user_id AS u, event_type AS e FROM events)
SELECT wk AS week, a.e AS a, b.e AS b, count(*) AS n FROM w a JOIN w b USING (wk, u) WHERE a.e < b.e GROUP BY 1, 2, 3""")
def weekly_pairs(spark, sf):
    w = events(spark, sf).select(F.date_trunc("week", "ts").cast("date").alias("week"), "user_id", F.col("event_type").alias("e")).distinct()
    return w.withColumnRenamed("e", "a").join(w.withColumnRenamed("e", "b"), ["week", "user_id"]).where("a < b").groupBy("week", "a", "b").agg(F.count("*").alias("n"))


@query("hhi_profiles", """WITH n AS (SELECT s_nationkey AS o, p_brand AS i, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY o) AS p, row_number() OVER (PARTITION BY o ORDER BY n DESC, i) AS r FROM n)
SELECT o AS nation, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_items, round(sum(p * p) * 10000, 4) AS hhi, round(-sum(p * log2(p)), 6) AS entropy, round(max(p), 6) AS top_share,
string_agg(i, ',' ORDER BY r) FILTER (r <= 5) AS top, round(CASE WHEN count(*) > 1 THEN 1 + sum(p * log2(p)) / log2(count(*)) ELSE 1 END, 6) AS focus FROM p GROUP BY o""")
def hhi_profiles(spark, sf):
    li, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).select(F.col("s_nationkey").alias("nation"), "p_brand")
    got = rel.profile(x, "nation", "p_brand")
    return got.withColumns({"hhi": F.round("hhi", 4), **{c: rounded(F.col(c)) for c in ("entropy", "top_share", "focus")}})


@query("set_alignment", """WITH n AS (SELECT c_nationkey AS o, o_orderpriority || c_mktsegment AS i, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
t AS (SELECT o, i FROM n QUALIFY row_number() OVER (PARTITION BY o ORDER BY n DESC, i) <= 3), k AS (SELECT o, count(*) AS k FROM t GROUP BY o)
SELECT a.o AS a, b.o AS b, round(count(*) / (max(ka.k) + max(kb.k) - count(*)), 6) AS alignment FROM t a JOIN t b ON a.i = b.i AND a.o < b.o JOIN k ka ON ka.o = a.o JOIN k kb ON kb.o = b.o GROUP BY 1, 2""")
def set_alignment(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("o"), F.concat("o_orderpriority", "c_mktsegment").alias("i"))
    return rel.set_alignment(x, "o", "i").withColumn("alignment", rounded(F.col("alignment")))


@query("entropy_concentration", f"""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT d, n, n / sum(n) OVER (PARTITION BY d) AS p FROM e)
SELECT d, CAST(sum(n) AS BIGINT) AS n, round(-sum(p * ln(p)), 6) AS entropy, round(1 + sum(p * ln(p)) / ln(5), 6) + 0 AS concentration FROM p GROUP BY d""")
def entropy_concentration(spark, sf):
    e = events(spark, sf)
    kinds = vocabulary(e, "event_type")
    got = rel.group_entropy(e, ["d"], "event_type", kinds)
    return got.select("d", "n", rounded(F.col("entropy")).alias("entropy"), rounded(F.col("concentration")).alias("concentration"))


@query("geographic_spread", """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, n_nationkey AS p, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT d, count(*) AS n, count(DISTINCT p) AS n_places, count(DISTINCT r) AS n_regions, round(count(DISTINCT r) / 5, 6) AS spread,
CASE WHEN count(DISTINCT p) <= 1 THEN 'local' WHEN count(DISTINCT r) / 5 >= 0.6 THEN 'national' WHEN count(DISTINCT r) > 1 THEN 'regional' ELSE 'provincial' END AS kind FROM x GROUP BY d""")
def geographic_spread(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.to_date("o_orderdate").alias("d"), "n_nationkey", "n_regionkey")
    return rel.spread(x, ["d"], "n_nationkey", "n_regionkey", 5).withColumn("spread", rounded(F.col("spread")))


@query("sentiment_rollups", """WITH x AS (SELECT d.source, d.lang, l.quality - l.toxic AS sentiment, abs(l.quality - l.toxic) AS intensity FROM documents d JOIN labels l USING (doc_id))
SELECT 'source' AS level, source AS key, count(*) AS n, round(avg(sentiment), 6) + 0 AS sentiment, round(avg(intensity), 6) AS intensity FROM x GROUP BY 2
UNION ALL SELECT 'lang', lang, count(*), round(avg(sentiment), 6) + 0, round(avg(intensity), 6) FROM x GROUP BY 2""")
def sentiment_rollups(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "source", "lang"), table(spark, sf, "labels")
    x = d.join(lab, "doc_id").withColumn("sentiment", F.col("quality") - F.col("toxic")).withColumn("intensity", F.abs("sentiment"))
    return rel.rollup_means(x, ["source", "lang"], ["sentiment", "intensity"]).select("level", "key", "n", rounded(F.col("sentiment")).alias("sentiment"), rounded(F.col("intensity")).alias("intensity"))


@query("sentiment_buckets", "WITH x AS (SELECT d.source, avg(l.quality - l.toxic) AS s FROM documents d JOIN labels l USING (doc_id) GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (s > 0.1) AS positive, count(*) FILTER (s < -0.1) AS negative, count(*) FILTER (abs(s) <= 0.1) AS neutral, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std FROM x")
def sentiment_buckets(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    s = F.col("s")
    x = d.join(lab, "doc_id").groupBy("source").agg(F.avg(F.col("quality") - F.col("toxic")).alias("s"))
    return x.agg(F.count("*").alias("n"), F.count_if(s > 0.1).alias("positive"), F.count_if(s < -0.1).alias("negative"), F.count_if(F.abs(s) <= 0.1).alias("neutral"), rounded(F.avg("s")).alias("mean"), rounded(F.stddev_pop("s")).alias("std"))


@query("authority_top_k", """WITH e AS (SELECT l_partkey AS e, count(*) AS n, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_orderkey) AS o FROM lineitem GROUP BY 1)
SELECT e AS entity, n AS mentions, round(n * ln(1 + a + o), 6) AS authority FROM e ORDER BY authority DESC, e LIMIT 25""")
def authority_top_k(spark, sf):
    li = table(spark, sf, "lineitem")
    got = rel.entity_index(li, ["l_partkey"], "l_orderkey", "l_shipdate", "l_suppkey", "l_orderkey")
    return got.select(F.col("l_partkey").alias("entity"), "mentions", rounded(F.col("authority")).alias("authority")).orderBy(F.desc("authority"), "entity").limit(25)


@query("top_per_group", f"WITH {ARTICLES}, n AS (SELECT f, c, count(*) AS n FROM o GROUP BY 1, 2) SELECT f AS frame, c AS actor, n, row_number() OVER (PARTITION BY f ORDER BY n DESC, c) AS rank FROM n QUALIFY rank <= 10")
def top_per_group(spark, sf):
    n = articles(spark, sf).groupBy(F.col("f").alias("frame"), F.col("c").alias("actor")).agg(F.count("*").alias("n"))
    return rel.top_n(n, ["frame"], [F.desc("n"), F.asc("actor")], 10).withColumn("rank", F.col("rank").cast("long"))


@query("latest_by_key", f"WITH {ARTICLES} SELECT c AS actor, k, d FROM o QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC, k) = 1")
def latest_by_key(spark, sf):
    return rel.latest_by(articles(spark, sf), ["c"], [F.desc("d"), F.asc("k")]).select(F.col("c").alias("actor"), "k", "d")


@query("index_query", f"WITH {ARTICLES} SELECT k, d, f, v FROM o WHERE f IN ('1-URGENT', '2-HIGH') AND d >= DATE '1996-01-01' AND d <= DATE '1998-12-31' AND s = 'O' AND v >= 100000")
def index_query(spark, sf):
    from datetime import date

    return rel.query(articles(spark, sf), {"f": ["1-URGENT", "2-HIGH"], "d": (date(1996, 1, 1), date(1998, 12, 31)), "s": "O", "v": (100000, None)}).select("k", "d", "f", "v")


@query("frame_ngrams", """WITH x AS (SELECT user_id, event_type AS e, lead(event_type, 1) OVER w AS e1, lead(event_type, 2) OVER w AS e2, lead(event_type, 3) OVER w AS e3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT 2 AS size, e || '>' || e1 AS gram FROM x WHERE e1 IS NOT NULL UNION ALL SELECT 3, e || '>' || e1 || '>' || e2 FROM x WHERE e2 IS NOT NULL UNION ALL SELECT 4, e || '>' || e1 || '>' || e2 || '>' || e3 FROM x WHERE e3 IS NOT NULL)
SELECT size, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")
def frame_ngrams(spark, sf):
    return rel.ngrams(events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")


@query("transition_matrix", f"""WITH {ARTICLES}, t AS (SELECT a.f AS a, b.f AS b, count(*) AS n FROM o a JOIN o b ON a.c = b.c AND b.d > a.d AND b.d - a.d <= 7 GROUP BY 1, 2) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM t""")
def transition_matrix(spark, sf):
    return rel.transitions(articles(spark, sf), "c", "d", "f", 7).withColumn("p", rounded(F.col("p")))


@query("co_activity_edges", "WITH x AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem) SELECT a.s AS src, b.s AS dst, count(*) AS weight FROM x a JOIN x b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2")
def co_activity_edges(spark, sf):
    return rel.co_edges(table(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey")


# windows of the flagship detector's kind, wide enough to hold rows: runs of days a frame is above its 85th percentile
WINS = """, q AS (SELECT f, quantile_cont(p, 0.85) AS lim FROM s GROUP BY f), m AS (SELECT s.f, d, p > lim AS above, lead(d) OVER x AS nd, CASE WHEN p > lim AND NOT coalesce(lag(p) OVER x > lim, false) THEN 1 ELSE 0 END AS st FROM s JOIN q USING (f) WINDOW x AS (PARTITION BY s.f ORDER BY d)),
i AS (SELECT *, sum(st) OVER (PARTITION BY f ORDER BY d) AS g FROM m), win AS (SELECT f, min(d) AS a, coalesce(max(nd), max(d)) AS b, f || ':' || min(d) AS id FROM i WHERE above GROUP BY f, g)"""


def _windows(spark, sf):
    got = series.threshold_bursts(daily(spark, sf), "f", "d", "proportion", level=0.85)
    return got.select("f", F.col("start_day").alias("a"), F.col("end_day").alias("b"), F.concat_ws(":", "f", F.col("start_day").cast("string")).alias("id"))


def _sql(body: str) -> str:
    from .tables import DAILY

    return f"WITH {DAILY}{WINS} {body}"


@query("burst_range_join", _sql("SELECT id, count(*) AS n, count(DISTINCT c) AS actors, round(avg(v), 4) AS mean_value FROM o JOIN win ON o.f = win.f AND o.d BETWEEN a AND b GROUP BY id"))
def burst_range_join(spark, sf):
    x = rel.range_join(articles(spark, sf), _windows(spark, sf), ["f"], "d", "a", "b")
    return x.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("c").alias("actors"), F.round(F.avg("v"), 4).alias("mean_value"))


@query("interval_overlap_join", _sql("SELECT x.id AS left_id, y.id AS right_id, least(x.b, y.b) - greatest(x.a, y.a) AS days FROM win x JOIN win y ON x.f < y.f AND x.a <= y.b AND y.a <= x.b"))
def interval_overlap_join(spark, sf):
    w = _windows(spark, sf)
    r = w.select(F.col("f").alias("rf"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("id").alias("right_id"))
    got = rel.overlap_join(w.withColumnRenamed("id", "left_id"), r, ("a", "b"), ("ra", "rb")).where("f < rf")
    return got.select("left_id", "right_id", F.datediff(F.least("b", "rb"), F.greatest("a", "ra")).cast("long").alias("days"))


@query("nearest_date_join", _sql(""", days AS (SELECT DISTINCT f, d FROM o), w AS (SELECT DISTINCT f, a FROM win), r AS (SELECT days.f, days.d, w.a, row_number() OVER (PARTITION BY days.f, days.d ORDER BY abs(days.d - w.a), w.a) AS r FROM days JOIN w USING (f)) SELECT f AS frame, d AS day, a AS nearest_a FROM r WHERE r = 1""").replace("GROUP BY f, g) ,", "GROUP BY f, g),"))
def nearest_date_join(spark, sf):
    days = articles(spark, sf).select("f", "d").distinct()
    got = rel.nearest(days, "d", _windows(spark, sf).select("f", "a").distinct(), "a", "f", [])
    return got.select(F.col("f").alias("frame"), F.col("d").alias("day"), "nearest_a")


@query("successor_theta_join", _sql("SELECT x.id, y.id AS next_id, y.a - x.b AS lag_days FROM win x JOIN win y ON x.id <> y.id AND y.a > x.b AND y.a - x.b <= 21"))
def successor_theta_join(spark, sf):
    return rel.successors(_windows(spark, sf), "id", "a", "b").withColumn("lag_days", F.col("lag_days").cast("long"))


@query("tolerance_semi_join", _sql("SELECT DISTINCT x.id FROM win x WHERE EXISTS (SELECT 1 FROM o WHERE o.f = x.f AND o.s = 'P' AND abs(o.d - x.a) <= 3)"))
def tolerance_semi_join(spark, sf):
    p = articles(spark, sf).where("s = 'P'").select("f", F.col("d").alias("a"))
    return rel.matched_within(_windows(spark, sf), p, ["f"], "a", 3).select("id").distinct()


@query("new_entrants_anti_join", _sql("""SELECT id, count(*) AS actors, CAST(sum(fresh) AS BIGINT) AS new_actors FROM (SELECT DISTINCT id, a, c,
CASE WHEN EXISTS (SELECT 1 FROM o p WHERE p.c = o.c AND p.d >= a - 90 AND p.d < a) THEN 0 ELSE 1 END AS fresh FROM o JOIN win ON o.d BETWEEN a AND b) GROUP BY id"""))
def new_entrants(spark, sf):
    rows = articles(spark, sf).select("c", "d")
    return rel.new_entrants(rows, _windows(spark, sf).select("id", "a", "b"), "id", "c", "d", "a", "b")


@query("shared_documents", _sql("SELECT x.id AS left_id, y.id AS right_id, count(DISTINCT p.c) AS shared FROM win x JOIN o p ON p.f = x.f AND p.d BETWEEN x.a AND x.b JOIN o r ON r.c = p.c JOIN win y ON r.f = y.f AND r.d BETWEEN y.a AND y.b WHERE x.f < y.f AND x.a <= y.b AND y.a <= x.b GROUP BY 1, 2"))
def shared_documents(spark, sf):
    """Windows of different frames that overlap in time and share actors, with how many."""
    w = _windows(spark, sf)
    held = rel.range_join(articles(spark, sf).select("f", "c", "d"), w, ["f"], "d", "a", "b").select("f", "id", "a", "b", "c").distinct()
    other = held.select(F.col("f").alias("rf"), F.col("id").alias("right_id"), F.col("a").alias("ra"), F.col("b").alias("rb"), "c")
    return held.join(other, "c").where("f < rf and a <= rb and ra <= b").groupBy(F.col("id").alias("left_id"), "right_id").agg(F.count("*").alias("shared"))


@query("rate_crosstab", f"WITH {ARTICLES} SELECT f AS frame, CASE WHEN count(*) FILTER (s = 'F') >= 30 THEN round(avg(CAST(v > 150000 AS INTEGER)) FILTER (s = 'F'), 6) END AS rate_F, CASE WHEN count(*) FILTER (s = 'O') >= 30 THEN round(avg(CAST(v > 150000 AS INTEGER)) FILTER (s = 'O'), 6) END AS rate_O FROM o GROUP BY f")
def rate_crosstab(spark, sf):
    got = rel.rate_table(articles(spark, sf), "f", "s", ["F", "O"], F.col("v") > 150000, 30)
    return got.select(F.col("f").alias("frame"), rounded(F.col("rate_F")).alias("rate_F"), rounded(F.col("rate_O")).alias("rate_O"))


@query("weekly_evolution_shares", "WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT week, event_type, round(n / sum(n) OVER (PARTITION BY week), 6) AS share FROM w")
def weekly_evolution(spark, sf):
    w = events(spark, sf).groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.count("*").alias("n"))
    return w.select("week", "event_type", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("week"))).alias("share"))


@query("convergence_halves", """WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT d, n / sum(n) OVER (PARTITION BY d) AS p FROM d),
h AS (SELECT d, -sum(p * ln(p)) AS h FROM p GROUP BY d), k AS (SELECT h, row_number() OVER (ORDER BY d) <= (count(*) OVER ()) // 2 AS early FROM h)
SELECT round(avg(h) FILTER (early), 6) AS early, round(avg(h) FILTER (NOT early), 6) AS late, round(avg(h) FILTER (early) - avg(h) FILTER (NOT early), 6) + 0 AS convergence FROM k""")
def convergence_halves(spark, sf):
    """Diversity of the first half of the days less that of the second: one row a day is ranked."""
    e = events(spark, sf)
    kinds = vocabulary(e, "event_type")
    h = rel.group_entropy(e, ["d"], "event_type", kinds)
    k = h.select("entropy", (F.row_number().over(Window.orderBy("d")) <= F.floor(F.count("*").over(Window.partitionBy()) / 2)).alias("early"))
    a, b = F.avg(F.when(F.col("early"), F.col("entropy"))), F.avg(F.when(~F.col("early"), F.col("entropy")))
    return k.agg(rounded(a).alias("early"), rounded(b).alias("late"), rounded(a - b).alias("convergence"))


@query("profile_consistency", """WITH a AS (SELECT l_suppkey AS s, l_orderkey AS k, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS r, avg(CAST(l_returnflag = 'A' AS INTEGER)) AS b FROM lineitem GROUP BY 1, 2)
SELECT s AS supplier, count(*) AS n, round(avg(r), 6) AS returned, round(avg(b), 6) AS accepted, round((1 / (1 + stddev_pop(r)) + 1 / (1 + stddev_pop(b))) / 2, 6) AS consistency FROM a GROUP BY s""")
def profile_consistency(spark, sf):
    rate = lambda f: F.avg((F.col("l_returnflag") == f).cast("int"))
    a = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), "l_orderkey").agg(rate("R").alias("r"), rate("A").alias("b"))
    c = (1 / (1 + F.stddev_pop("r")) + 1 / (1 + F.stddev_pop("b"))) / 2
    return a.groupBy("supplier").agg(F.count("*").alias("n"), rounded(F.avg("r")).alias("returned"), rounded(F.avg("b")).alias("accepted"), rounded(c).alias("consistency"))


@query("influence_pairs", """WITH c AS (SELECT l_suppkey AS s, p_brand AS b, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT s, sum(n) AS t, sqrt(sum(n * n)) AS l FROM c GROUP BY s),
d AS (SELECT x.s AS a, y.s AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y USING (b) WHERE x.s < y.s GROUP BY 1, 2)
SELECT a, d.b, round(dot / (ta.l * tb.l) * least(ta.t * tb.t / 100, 1), 6) AS influence FROM d JOIN t ta ON ta.s = a JOIN t tb ON tb.s = d.b""")
def influence_pairs(spark, sf):
    """Cosine of two sources' profiles, weighed by how much both have published."""
    li, p = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    c = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s"), "p_brand").agg(F.count("*").alias("n"))
    d = rel.profile_pairs(c, "s", "p_brand", "n")
    return d.select("a", "b", rounded(F.col("dot") / (F.col("la") * F.col("lb")) * F.least(F.col("ta") * F.col("tb") / 100, F.lit(1.0))).alias("influence"))


@query("indicator_labels", f"WITH {ARTICLES}, x AS (SELECT c, count(*) AS n, count(DISTINCT f) / 5 AS div FROM o GROUP BY c), y AS (SELECT c, 0.6 * least(n / 20, 1) + 0.4 * div AS score FROM x) SELECT c AS actor, round(score, 6) AS score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'moderate' ELSE 'low' END AS label FROM y")
def indicator_labels(spark, sf):
    x = articles(spark, sf).groupBy("c").agg((0.6 * F.least(F.count("*") / 20, F.lit(1.0)) + 0.4 * (F.count_distinct("f") / 5)).alias("score"))
    label = F.when(F.col("score") >= 0.65, "high").when(F.col("score") >= 0.4, "moderate").otherwise("low")
    return x.select(F.col("c").alias("actor"), rounded(F.col("score")).alias("score"), label.alias("label"))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf):
    """Rank correlation; a value's mean rank comes from its count and the counts below it, over distinct values."""
    from ..operators.ranks import spearman as rho

    return rho(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(rounded(F.col("rho")).alias("rho"), "n")


@query("weighted_percentile", """WITH x AS (SELECT l_returnflag AS g, l_quantity AS v, sum(l_discount) AS w FROM lineitem GROUP BY 1, 2 HAVING sum(l_discount) > 0), c AS (SELECT g, v, (sum(w) OVER (PARTITION BY g ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY g) AS q FROM x),
l AS (SELECT g, v, q, lead(v) OVER (PARTITION BY g ORDER BY v) AS nv, lead(q) OVER (PARTITION BY g ORDER BY v) AS nq FROM c)
SELECT g AS returnflag, round(coalesce(max(CASE WHEN q <= 0.5 AND nq > 0.5 THEN v + (0.5 - q) / (nq - q) * (nv - v) END), CASE WHEN min(q) > 0.5 THEN min(v) ELSE max(v) END), 6) AS p50 FROM l GROUP BY g""")
def weighted_percentile(spark, sf):
    from ..operators.ranks import weighted_percentile as wp

    li = table(spark, sf, "lineitem")
    got = wp(li, ["l_returnflag"], "l_quantity", "l_discount", 0.5)
    return got.select(F.col("l_returnflag").alias("returnflag"), rounded(F.col("percentile")).alias("p50"))


@query("bh_adjust", """WITH p AS (SELECT p_partkey AS k, (p_partkey * 7919 % 10007) / 10007.0 AS p FROM part), r AS (SELECT k, p, rank() OVER (ORDER BY p, k) AS i, count(*) OVER () AS n FROM p)
SELECT k, round(p, 8) AS p, round(least(min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS q FROM r""")
def bh_adjust(spark, sf):
    """Benjamini-Hochberg q-values of one p-value a part."""
    from ..operators.ranks import benjamini_hochberg

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7919 % 10007 / 10007.0).alias("p"))
    return benjamini_hochberg(p, [], "p", "k").select("k", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))
