"""Queries of events, dominance, shifts and impact, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import stage
from ..operators import detect, events as ev, impact, paradigm, resolve, series, vectors
from . import detect_queries as dq
from ..functions.exprs import rounded
from .tables import ARTICLES, DAILY, WINDOWS, articles, daily, fisher_tail, odds, table, vocabulary, windows

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


def event_rows(spark, sf):
    """Embedded rows as articles: key, day and type of the event of the same id, its value as weight."""
    e, v = table(spark, sf, "events"), table(spark, sf, "embeddings")
    x = e.join(v, e.event_id == v.vec_id).select(F.col("event_id").alias("key"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.least(F.abs("value") / 100, F.lit(1.0)).alias("w"), "embedding")
    return x.withColumn("all", F.col("w"))


def _clusters(spark, sf):
    r = event_rows(spark, sf)
    s = ev.seeds(r, "kind", "w", "all")
    m = ev.cluster_seeds(s, "kind", "key", "day", "embedding", cut=0.62)
    return stage(r, "rows"), stage(m, "members")


@query("event_seeds", """WITH x AS (SELECT event_id AS key, event_type AS kind, least(abs(value) / 100, 1) AS w FROM events JOIN embeddings ON event_id = vec_id WHERE abs(value) > 0), t AS (SELECT *, max(w) OVER (PARTITION BY kind) AS m FROM x),
f AS (SELECT * FROM t WHERE w >= 0.5 * m), q AS (SELECT kind, greatest(quantile_cont(0.6 * w + 0.4 * w, 0.5), 1e-6) AS q FROM f GROUP BY kind) SELECT key, kind FROM f JOIN q USING (kind) WHERE 0.6 * w + 0.4 * w >= q.q""")
def event_seeds(spark, sf):
    return ev.seeds(event_rows(spark, sf), "kind", "w", "all").select("key", "kind")


@query("event_hac")
def event_hac(spark, sf):
    r, m = _clusters(spark, sf)
    return ev.occurrences(m, r, "kind", "key", "day", "w")


def _belonging(spark, sf):
    r, m = _clusters(spark, sf)
    o = stage(ev.occurrences(m, r, "kind", "key", "day", "w"), "occurrences")
    c = vectors.centroids(m.join(r.select("key", "embedding"), "key"), ["occurrence"], "embedding", DIM).drop("n").join(o.select("occurrence", "kind", "peak"), "occurrence")
    c = stage(c, "centres")
    return r, m, o, c, ev.soft_assign(r, c, "kind", "key", "day", "embedding", "w")


@query("soft_assignment")
def soft_assignment(spark, sf):
    return _belonging(spark, sf)[4]


@query("occurrence_dedup")
def occurrence_dedup(spark, sf):
    _, m, o, _, _ = _belonging(spark, sf)
    return ev.deduplicate(m, o, "key")


@query("event_clusters")
def event_clusters(spark, sf):
    _, m, o, c, _ = _belonging(spark, sf)
    return ev.group_occurrences(o, m, c, "key")


@query("event_attribution")
def event_attribution(spark, sf):
    """Occurrences and bursts of event types that overlap and share rows."""
    r, _, o, _, b = _belonging(spark, sf)
    e = table(spark, sf, "events").select(F.col("event_id").alias("k"), F.to_date("ts").alias("d"), F.col("event_type").alias("f"))
    s = series.daily_proportions(e, "k", "d", "f")
    w = series.threshold_bursts(s, "f", "d", "proportion", level=0.6).select(F.concat_ws(":", "f", F.col("start_day").cast("string")).alias("burst_id"), F.col("start_day").alias("onset"), F.col("end_day").alias("end"))
    return ev.attribute(o, b, w, r, "key", "day")


@query("event_regimes", """WITH p AS (SELECT CAST(ts AS DATE) AS d, event_type AS k, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT d, k, round(avg(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS v FROM p),
l AS (SELECT d, arg_max(k, (v, k)) AS after FROM s GROUP BY d), x AS (SELECT d, lag(after) OVER (ORDER BY d) AS before, after FROM l) SELECT d AS day, before, after FROM x WHERE before <> after""")
def event_regimes(spark, sf):
    p = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.avg("value").alias("v"))
    return ev.regimes(p, "kind", "day", "v")


def _states(spark, sf):
    w = series.weekly(daily(spark, sf), "f", "d")
    groups = vocabulary(w, "f")
    return stage(paradigm.states(w, "f", "week", "proportion", groups), "states")


@query("dominance_states")
def dominance_states(spark, sf):
    return _states(spark, sf)


@query("dominance_shifts")
def dominance_shifts(spark, sf):
    return paradigm.shifts(_states(spark, sf))


@query("shift_episodes")
def shift_episodes(spark, sf):
    merged = paradigm.merge_shifts(paradigm.shifts(_states(spark, sf)))
    return paradigm.episodes(merged)


def _scored(spark, sf):
    b = stage(detect.detect_bursts(dq.signals(spark, sf), "f", "d", "composite", dq.LOW_BAR), "bursts")
    return detect.score_bursts(b, dq.rows(spark, sf), "f", "d", "c", "outlet", "s")


@query("weighted_lift", f"""WITH {DAILY}, {WINDOWS}, a AS (SELECT f, avg(p) AS a FROM s GROUP BY 1), x AS (SELECT burst_id, b.f AS own, s.f, p, d - onset AS k FROM b JOIN s ON d BETWEEN onset - 14 AND onset + 42),
g AS (SELECT burst_id, own, x.f, sum((1 - k / 42) * p) FILTER (k >= 0) / sum(1 - k / 42) FILTER (k >= 0) AS post, coalesce(avg(p) FILTER (k < 0), max(a)) AS pre FROM x JOIN a ON a.f = x.f GROUP BY 1, 2, 3)
SELECT burst_id, round(coalesce(max(post - pre) FILTER (own = f), 0), 6) + 0.0 AS own_lift, round(coalesce(1 - least(1, sum(pre * post) / sqrt(sum(pre * pre)) / sqrt(sum(post * post))), 0), 6) + 0.0 AS structural FROM g GROUP BY 1""")
def weighted_lift(spark, sf):
    got = paradigm.weighted_lift(windows(spark, sf), daily(spark, sf).select("f", "d", "proportion"), "f", "d", "proportion")
    return got.withColumns({c: rounded(F.col(c)) for c in ("own_lift", "structural")})


@query("shift_attribution")
def shift_attribution(spark, sf):
    b = stage(_scored(spark, sf), "scored")
    lifts = paradigm.weighted_lift(b, daily(spark, sf).select("f", "d", "proportion"), "f", "d", "proportion")
    return paradigm.attribute(paradigm.shifts(_states(spark, sf)), b, lifts, "f", least_score=0.0)


@query("prevalence_ratios", f"""WITH {DAILY}, {WINDOWS}, inside AS (SELECT DISTINCT s.f, s.d FROM s JOIN b ON b.f = s.f AND s.d BETWEEN onset AND "end"), x AS (SELECT o.f, inside.d IS NOT NULL AS i, v, s FROM o LEFT JOIN inside ON inside.f = o.f AND inside.d = o.d),
l AS (SELECT f, 'dear' AS flag, i, v > 150000 AS hit FROM x UNION ALL SELECT f, 'open', i, s = 'O' FROM x), t AS (SELECT f, flag, count(*) FILTER (i AND hit) AS a, count(*) FILTER (i AND NOT hit) AS b, count(*) FILTER (NOT i AND hit) AS c, count(*) FILTER (NOT i AND NOT hit) AS d FROM l GROUP BY 1, 2),
p AS (SELECT *, {odds("a", "b", "c", "d")}, {fisher_tail("a", "b", "c", "d")} AS pv FROM t), r AS (SELECT *, row_number() OVER (ORDER BY pv, f, flag) AS i, count(*) OVER () AS n FROM p)
SELECT f, flag, a, b, c, d, odds, low, high, round(pv, 6) + 0.0 AS p, round(least(1, min(pv * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS q FROM r""")
def prevalence_ratios(spark, sf):
    got = impact.prevalence(articles(spark, sf), windows(spark, sf), "f", "d", {"dear": F.col("v") > 150_000, "open": F.col("s") == "O"})
    return got.withColumns({c: rounded(F.col(c)) for c in ("odds", "low", "high", "p", "q")})


@query("pre_onset_surge", f"""WITH {DAILY}, {WINDOWS}, n AS (SELECT f, d, count(*) AS n FROM o GROUP BY f, d), x AS (SELECT burst_id, b.f, sum(n) FILTER (onset - d <= 7) AS a, sum(n) FILTER (onset - d > 7) AS z FROM b LEFT JOIN n ON n.f = b.f AND d BETWEEN onset - 37 AND onset - 1 GROUP BY 1, 2)
SELECT burst_id, f, round(coalesce(a, 0) / 7, 6) + 0.0 AS rate, round(coalesce(z, 0) / 30, 6) + 0.0 AS base, CASE WHEN z > 0 THEN round((coalesce(a, 0) / 7) / (z / 30), 6) + 0.0 END AS surge FROM x""")
def pre_onset_surge(spark, sf):
    return impact.surge(articles(spark, sf), windows(spark, sf), "f", "d").withColumns({c: rounded(F.col(c)) for c in ("rate", "base", "surge")})


def _weekly_mass(spark, sf):
    """Weekly orders of each status as masses that may drive each frame's weekly share."""
    w = series.weekly(daily(spark, sf), "f", "d").select(F.col("f").alias("model"), "week", "proportion")
    from ..functions.exprs import week_end

    m = articles(spark, sf).groupBy(week_end(F.col("d")).alias("week"), F.col("s").alias("entity")).agg(F.count("*").cast("double").alias("mass"))
    return w, w.select("model").distinct().crossJoin(m)  # the few models, each with all masses


@query("stability_selection")
def stability_selection(spark, sf):
    w, m = _weekly_mass(spark, sf)
    return impact.select_drivers(w, m, "model", "week", "proportion", "entity")


@query("hac_ols")
def hac_ols(spark, sf):
    w, m = _weekly_mass(spark, sf)
    return impact.select_drivers(w, m, "model", "week", "proportion", "entity", ar=True)


@query("temporal_validation")
def temporal_validation(spark, sf):
    """Selected drivers on expanding folds and on the last three tenths."""
    w, m = _weekly_mass(spark, sf)
    return impact.validate_drivers(w, m, "model", "week", "proportion", "entity")


@query("autoregression_validation")
def autoregression_validation(spark, sf):
    return impact.validate(_weekly_mass(spark, sf)[0], "model", "week", "proportion")


@query("local_projections")
def local_projections(spark, sf):
    w = series.weekly(daily(spark, sf), "f", "d").select("f", "week", "proportion")
    pairs = w.withColumnsRenamed({"f": "a", "proportion": "x"}).join(w.withColumnsRenamed({"f": "b", "proportion": "y"}), "week").where("a <> b").withColumn("pair", F.concat_ws(">", "a", "b"))
    return impact.responses(pairs, "pair", "week", "x", "y", 8)


@query("impact_table")
def impact_table(spark, sf):
    s = daily(spark, sf).select("f", "d", "proportion")
    b = detect.detect_bursts(dq.signals(spark, sf), "f", "d", "composite", dq.LOW_BAR).select("f", "burst_id", "peak")
    return impact.impact_table(s, b, "f", "d", "proportion", "peak", "burst_id", permutations=50)


@query("succession")
def succession(spark, sf):
    b = detect.detect_bursts(dq.signals(spark, sf), "f", "d", "composite", dq.LOW_BAR)
    return impact.succession(b, "f")


@query("entity_resolution")
def entity_resolution(spark, sf):
    """Part names as organisations, joined where their rules say they are one."""
    p = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).withColumn("type", F.lit("ORG"))
    return resolve.resolve(p)


@query("location_resolution")
def location_resolution(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name")))
    return resolve.resolve(n.groupBy("name").agg(F.count("*").alias("n")).withColumn("type", F.lit("LOC")))


@query("group_correlations", f"""WITH {ARTICLES}, v AS (SELECT year(d) AS yr, c, count(*) FILTER (f = '1-URGENT') AS a1, count(*) FILTER (f = '2-HIGH') AS a2, count(*) FILTER (f = '3-MEDIUM') AS a3, count(*) FILTER (f = '4-NOT SPECIFIED') AS a4, count(*) FILTER (f = '5-LOW') AS a5 FROM o GROUP BY 1, 2),
x AS MATERIALIZED (SELECT *, a1 + a2 + a3 + a4 + a5 AS t, 5 * (a1 * a1 + a2 * a2 + a3 * a3 + a4 * a4 + a5 * a5) - (a1 + a2 + a3 + a4 + a5) ** 2 AS q FROM v), y AS MATERIALIZED (SELECT * FROM x WHERE q > 0),
p AS (SELECT y.yr, count(*) AS pairs FROM y JOIN y z ON y.yr = z.yr AND y.c < z.c WHERE 5 * (y.a1 * z.a1 + y.a2 * z.a2 + y.a3 * z.a3 + y.a4 * z.a4 + y.a5 * z.a5) - y.t * z.t > 0 AND 100 * (5 * (y.a1 * z.a1 + y.a2 * z.a2 + y.a3 * z.a3 + y.a4 * z.a4 + y.a5 * z.a5) - y.t * z.t) ** 2 >= 49 * y.q * z.q GROUP BY 1)
SELECT CAST(yr AS INTEGER) AS yr, count(*) AS actors, coalesce(max(pairs), 0) AS pairs FROM y LEFT JOIN p USING (yr) GROUP BY yr""")
def group_correlations(spark, sf):
    """Pairs of customers whose yearly counts by frame go together (0.7 and more), by year."""
    x = articles(spark, sf).withColumn("yr", F.year("d"))
    return vectors.profile_correlations(x, ["yr"], "c", "f", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 7)


@query("event_parts")
def event_parts(spark, sf):
    """Events split into connected parts, contained ones absorbed, with their strength."""
    r, m, o, c, b = _belonging(spark, sf)
    parts = ev.split_disconnected(stage(ev.group_occurrences(o, m, c, "key"), "clusters"), o, m, c, "key")
    whole = ev.absorb(parts, m, "key")
    return ev.summarise(whole, o, b, r, "key", 5)


@query("event_types")
def event_types(spark, sf):
    _, m, o, c, _ = _belonging(spark, sf)
    return ev.type_structure(ev.group_occurrences(o, m, c, "key"), o, m, "key")


@query("event_coherence")
def event_coherence(spark, sf):
    r, m, o, c, _ = _belonging(spark, sf)
    return ev.coherence_gate(ev.group_occurrences(o, m, c, "key"), m, r, "key", "embedding")
