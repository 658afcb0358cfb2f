"""Terms of bursts and occurrences, sources, and profiles of rows, each with the SQL that it is held against."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.exprs import rounded
from ..functions.staging import shared_dir, stage
from ..operators import detect, events as ev, impact, paradigm, series, vectors
from ..sources import tables as src
from . import detect_queries as dq
from .tables import ARTICLES, DAILY, WINDOWS, articles, daily, student_tail, table, windows
from .series_queries import ZED
from .vector_queries import _pairs

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


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in names})


# --- bursts -----------------------------------------------------------------------

INSIDE = f"""{DAILY}, {WINDOWS}, z AS (SELECT o.*, c_nationkey AS outlet FROM o LEFT JOIN customer ON c = c_custkey), x AS MATERIALIZED (SELECT burst_id, onset, "end", z.* FROM b JOIN z ON z.f = b.f AND z.d BETWEEN onset AND "end")"""


@query("burst_participation", f"""WITH {INSIDE}, n AS (SELECT burst_id, count(*) AS n_rows, count(DISTINCT c) AS n_actors, count(DISTINCT outlet) AS n_outlets FROM x GROUP BY 1),
t AS (SELECT burst_id, k FROM (SELECT burst_id, c, count(*) AS k FROM x GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY burst_id ORDER BY k DESC, c) <= 10), sh AS (SELECT burst_id, k / sum(k) OVER (PARTITION BY burst_id) AS p, count(*) OVER (PARTITION BY burst_id) AS m FROM t),
dv AS (SELECT burst_id, CASE WHEN max(m) > 1 THEN -sum(p * ln(p)) / ln(max(m)) ELSE 0 END AS diversity FROM sh GROUP BY 1), w AS (SELECT DISTINCT burst_id, c FROM x), old AS (SELECT DISTINCT burst_id, z.c FROM b JOIN z ON z.f = b.f AND z.d BETWEEN onset - 90 AND onset - 1),
nw AS (SELECT w.burst_id, count(*) AS n_new FROM w ANTI JOIN old ON old.burst_id = w.burst_id AND old.c = w.c GROUP BY 1), f1 AS (SELECT burst_id, d, count(*) AS new FROM (SELECT burst_id, c, min(d) AS d FROM x GROUP BY 1, 2) GROUP BY 1, 2),
dd AS (SELECT burst_id, CAST(unnest(generate_series(onset, "end", INTERVAL 1 DAY)) AS DATE) AS d FROM b), g AS (SELECT burst_id, coalesce(new, 0) AS new, row_number() OVER (PARTITION BY burst_id ORDER BY d) AS r FROM dd LEFT JOIN f1 USING (burst_id, d)),
gr AS (SELECT burst_id, coalesce(avg(CASE WHEN new > 0 THEN 1 ELSE 0 END) FILTER (r > 1), 0) AS growth, sum(new) / count(*) AS velocity FROM g GROUP BY 1)
SELECT burst_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_actors, 0) AS n_actors, coalesce(n_outlets, 0) AS n_outlets, coalesce(n_new, 0) AS n_new, round(coalesce(diversity, 0), 6) + 0.0 AS diversity, round(growth, 6) + 0.0 AS growth, round(velocity, 6) + 0.0 AS velocity,
round(least(1, coalesce(n_outlets, 0) / 20), 6) + 0.0 AS cross_media, round(CASE WHEN n_actors > 0 THEN coalesce(n_new, 0) / n_actors ELSE 0 END, 6) + 0.0 AS newcomers FROM b LEFT JOIN n USING (burst_id) LEFT JOIN dv USING (burst_id) LEFT JOIN nw USING (burst_id) LEFT JOIN gr USING (burst_id)""")
def burst_participation(spark, sf):
    got = detect.participation_terms(windows(spark, sf), dq.rows(spark, sf), "f", "d", "c", "outlet", network=False)
    return _round(got, "diversity", "growth", "velocity", "cross_media", "newcomers")


_H = "-sum(p * ln(p)) / ln(3)"


@query("burst_sources", f"""WITH {INSIDE}, y AS (SELECT burst_id, s, CASE WHEN 2 * (d - onset) <= "end" - onset THEN 1 ELSE 2 END AS half FROM x), n AS (SELECT burst_id, count(*) AS n, count(*) FILTER (half = 1) AS a, count(*) FILTER (half = 2) AS z FROM y GROUP BY 1),
h AS (SELECT burst_id, half, {_H} AS h FROM (SELECT burst_id, half, count(*) / sum(count(*)) OVER (PARTITION BY burst_id, half) AS p FROM y GROUP BY burst_id, half, s) GROUP BY 1, 2), t AS (SELECT burst_id, {_H} AS h FROM (SELECT burst_id, count(*) / sum(count(*)) OVER (PARTITION BY burst_id) AS p FROM y GROUP BY burst_id, s) GROUP BY 1),
v AS (SELECT n.*, t.h, h1.h AS h1, h2.h AS h2 FROM n JOIN t USING (burst_id) LEFT JOIN h h1 ON h1.burst_id = n.burst_id AND h1.half = 1 LEFT JOIN h h2 ON h2.burst_id = n.burst_id AND h2.half = 2)
SELECT burst_id, round(CASE WHEN a > 0 AND z > 0 AND h1 > 0 THEN greatest(0, least(1, (h1 - h2) / h1 * greatest(0, least(1, log2(n) / log2(100))))) ELSE 0 END, 6) + 0.0 AS decline, round(greatest(0, least(1, 1 - h)), 6) + 0.0 AS concentration FROM v""")
def burst_sources(spark, sf):
    return _round(detect.source_terms(windows(spark, sf), dq.rows(spark, sf), "f", "d", "s", 3), "decline", "concentration")


@query("burst_networks")
def burst_networks(spark, sf):
    """Structure and cohesion of the network of each burst's actors."""
    return detect.participation_terms(windows(spark, sf), dq.rows(spark, sf), "f", "d", "c", "outlet").select("burst_id", "n_actors", "structure", "cohesion")


# --- vectors ------------------------------------------------------------------------


def _said(spark, sf):
    v, e = table(spark, sf, "embeddings"), table(spark, sf, "events")
    return v.join(e, v.vec_id == e.event_id).select("label", "vec_id", F.to_date("ts").alias("day"), (F.col("user_id") % 5).alias("outlet"), "event_type", "embedding")


SAID = """e AS (SELECT label, vec_id, CAST(ts AS DATE) AS day, user_id % 5 AS outlet, event_type, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings JOIN events ON vec_id = event_id),
u AS MATERIALIZED (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM e), sim AS MATERIALIZED (SELECT a.label, a.rn, b.vec_id AS other FROM u a JOIN u b ON a.label = b.label AND b.rn < a.rn WHERE list_dot_product(a.u, b.u) > 0.95),
g(label, rn, held, vec_id, gone) AS (SELECT label, rn, [vec_id], vec_id, FALSE FROM u WHERE rn = 1 UNION ALL SELECT label, rn, CASE WHEN gone THEN held ELSE list_append(held, vec_id) END, vec_id, gone FROM
(SELECT u.label, u.rn, any_value(g.held) AS held, u.vec_id, coalesce(bool_or(list_contains(g.held, sim.other)), FALSE) AS gone FROM g JOIN u ON u.label = g.label AND u.rn = g.rn + 1 LEFT JOIN sim ON sim.label = u.label AND sim.rn = u.rn GROUP BY u.label, u.rn, u.vec_id)),
k AS MATERIALIZED (SELECT u.* FROM u JOIN g USING (label, vec_id) WHERE NOT gone)"""


def _means(of: str, by: str, least: int) -> str:
    """Unit vectors of the means of a table's rows by label and a column."""
    return f"""(SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM (SELECT label, {by}, list(m ORDER BY j) AS c FROM (SELECT label, {by}, j, avg(v[j]) AS m, count(*) AS n FROM {of}, range(1, 65) t(j) GROUP BY 1, 2, 3) WHERE n >= {least} GROUP BY 1, 2))"""


@query("convergence_bundle", f"""WITH RECURSIVE {SAID}, n AS (SELECT label, count(*) AS n, count(*) FILTER (gone) AS syndicated FROM g GROUP BY 1), s AS {_pairs("k", "label")},
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY day, vec_id) AS r, count(*) OVER (PARTITION BY label) AS m FROM k), ch AS (SELECT *, least(floor((r - 1) / floor(m / 5)), 4) AS part FROM o WHERE m >= 10), cp AS {_pairs("ch", "label, part")},
tr AS (SELECT label, regr_slope(sim, part) AS slope, regr_r2(sim, part) AS r2 FROM cp GROUP BY 1), mo AS {_means("k", "outlet", 2)}, ao AS {_pairs("mo", "label")}, ma AS {_means("u", "event_type", 1)}, aa AS {_pairs("ma", "label")},
ro AS (SELECT label, r - 1 AS r, m, j, v[j] AS x, sum(v[j]) OVER (PARTITION BY label, j ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM o, range(1, 65) q(j)),
nv AS (SELECT label, r, max(m) AS m, CASE WHEN r = 0 THEN 1 ELSE 1 - sum(x * t) / sqrt(sum(x * x)) / sqrt(sum(t * t)) END AS nov FROM ro GROUP BY 1, 2), de AS (SELECT label, -regr_slope(nov, r) AS decay, avg(nov) FILTER (r >= m - greatest(1, m // 5)) AS last_novelty FROM nv WHERE m >= 5 GROUP BY 1)
SELECT label, n.n, syndicated, round(syndicated / n.n, 6) + 0.0 AS syndication, round(coalesce(s.sim, 0), 6) + 0.0 AS similarity, round(coalesce(slope, 0), 6) + 0.0 AS slope, round(coalesce(r2, 0), 6) + 0.0 AS r2, round(coalesce(ao.sim, 0), 6) + 0.0 AS alignment, round(coalesce(decay, 0), 6) + 0.0 AS decay,
round(coalesce(last_novelty, 0), 6) + 0.0 AS last_novelty, round(coalesce(aa.sim, 0), 6) + 0.0 AS coordination FROM n LEFT JOIN s USING (label) LEFT JOIN tr USING (label) LEFT JOIN ao USING (label) LEFT JOIN aa USING (label) LEFT JOIN de USING (label)""")
def convergence_bundle(spark, sf):
    got = vectors.convergence_metrics(_said(spark, sf), "label", "vec_id", "day", "outlet", "event_type", "embedding", DIM)
    return _round(got, "syndication", "similarity", "slope", "r2", "alignment", "decay", "last_novelty", "coordination")


@query("driver_alignment", f"""WITH e AS (SELECT label, event_type, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings JOIN events ON vec_id = event_id), c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM (SELECT label, list(m ORDER BY j) AS c FROM (SELECT label, j, avg(v[j]) AS m FROM e, range(1, 65) t(j) GROUP BY 1, 2) GROUP BY 1)),
l AS (SELECT event_type, label, CAST(count(*) AS DOUBLE) AS strength, count(*) >= 10 AS driver FROM e GROUP BY 1, 2), d AS (SELECT event_type, list(m ORDER BY j) AS m FROM (SELECT event_type, j, sum(u[j] * strength) / sum(strength) AS m FROM l JOIN c USING (label), range(1, 65) t(j) WHERE driver GROUP BY 1, 2) GROUP BY 1)
SELECT event_type, label, strength, driver, round(list_dot_product(u, m) / sqrt(list_dot_product(m, m)), 6) + 0.0 AS alignment FROM l JOIN c USING (label) LEFT JOIN d USING (event_type)""")
def driver_alignment(spark, sf):
    e = _said(spark, sf)
    links = e.groupBy("event_type", "label").agg(F.count("*").cast("double").alias("strength")).withColumn("driver", F.col("strength") >= 10)
    c = vectors.centroids(e, ["label"], "embedding", DIM).drop("n")
    return _round(vectors.driver_alignment(links, c, "event_type", "label", "strength", "centroid", DIM), "alignment")


# --- occurrences -----------------------------------------------------------------

OCC = f"""{ARTICLES}, r AS (SELECT o.*, f || ' ' || year(d) AS occ, (k % 10) / 10 AS bel, c_nationkey AS outlet, (c % 3) / 3 AS pos, (c % 5) / 5 AS neu, (c % 7) / 7 AS neg FROM o JOIN customer ON c = c_custkey),
oc AS (SELECT occ AS occurrence, f AS kind, sum(bel) AS mass, min(d) + 60 AS core_start, max(d) - 60 AS core_end, count(*) / 1500 AS confidence FROM r GROUP BY 1, 2)"""


def _occ(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, belonging and occurrences (a frame's year)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("outlet"))
    r = articles(spark, sf).join(c, "c").withColumns({"occurrence": F.concat_ws(" ", "f", F.year("d").cast("string")), "belonging": F.col("k") % 10 / 10, "pos": F.col("c") % 3 / 3, "neu": F.col("c") % 5 / 5, "neg": F.col("c") % 7 / 7})
    o = r.groupBy("occurrence", F.col("f").alias("kind")).agg(F.sum("belonging").alias("mass"), F.date_add(F.min("d"), 60).alias("core_start"), F.date_sub(F.max("d"), 60).alias("core_end"), (F.count("*") / 1500).alias("confidence"))
    return r, r.select("k", "occurrence", "belonging"), o


@query("occurrence_strength", f"""WITH {OCC}, a AS (SELECT occ, count(DISTINCT outlet) AS outlets, sum(bel) FILTER (bel > 0) AS b, sum(bel * abs(pos - neg)) FILTER (bel > 0) AS e, sum(bel * pos) AS t0, sum(bel * neu) AS t1, sum(bel * neg) AS t2 FROM r GROUP BY 1)
SELECT occurrence, outlets, round(mass / greatest(1, core_end - core_start), 6) + 0.0 AS temporal_intensity, round(e / b, 6) + 0.0 AS emotional_intensity,
round(1 + (t0 * log2(t0 / (t0 + t1 + t2)) + t1 * log2(t1 / (t0 + t1 + t2)) + t2 * log2(t2 / (t0 + t1 + t2))) / (t0 + t1 + t2) / log2(3), 6) + 0.0 AS tone_coherence FROM oc JOIN a ON a.occ = oc.occurrence""")
def occurrence_strength(spark, sf):
    r, b, o = _occ(spark, sf)
    return _round(ev.occurrence_strength(o, b, r, "k", "outlet", ["pos", "neu", "neg"]), "temporal_intensity", "emotional_intensity", "tone_coherence")


@query("occurrence_entities", f"WITH {OCC} SELECT occ AS occurrence, p_brand AS entity, count(DISTINCT k) AS n FROM r JOIN lineitem ON l_orderkey = k JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3")
def occurrence_entities(spark, sf):
    _, b, _ = _occ(spark, sf)
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    named = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("entity"))
    return ev.occurrence_entities(b, named, "k", "entity")


@query("occurrence_metrics", f"""WITH {OCC}, l AS (SELECT DISTINCT outlet AS burst_id, occ AS occurrence FROM r), x AS (SELECT l.burst_id, oc.* FROM l JOIN oc USING (occurrence)),
p AS (SELECT a.burst_id, avg(CASE WHEN a.core_start <= z.core_end AND z.core_start <= a.core_end THEN 1 ELSE 0 END) AS t FROM x a JOIN x z ON a.burst_id = z.burst_id AND a.occurrence < z.occurrence GROUP BY 1)
SELECT burst_id, count(*) AS n_occurrences, count(DISTINCT kind) AS n_types, round(avg(confidence), 6) + 0.0 AS mean_confidence, count(*) FILTER (confidence < 0.4) AS n_low_confidence, round(avg(mass), 4) + 0.0 AS mean_mass, round(sum(mass), 4) + 0.0 AS total_mass, round(coalesce(max(t), 0), 6) + 0.0 AS temporal_overlap FROM x LEFT JOIN p USING (burst_id) GROUP BY burst_id""")
def occurrence_metrics(spark, sf):
    """Occurrences of each nation's orders, as a burst's."""
    r, _, o = _occ(spark, sf)
    got = ev.burst_metrics(r.select(F.col("outlet").alias("burst_id"), "occurrence"), o)
    return _round(_round(got, "mean_confidence", "temporal_overlap"), "mean_mass", "total_mass", digits=4)


@query("occurrence_types", f"""WITH {OCC}, s AS (SELECT k, p_type AS kind, count(*) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey, (SELECT o_orderkey AS k FROM orders) q WHERE q.k = o_orderkey GROUP BY 1, 2),
v AS (SELECT occ, s.kind, sum(bel * value) / max(t) AS m FROM r JOIN s USING (k) JOIN (SELECT occ, sum(bel) AS t FROM r WHERE bel > 0 GROUP BY 1) USING (occ) WHERE bel > 0 GROUP BY 1, 2), kinds AS (SELECT DISTINCT kind FROM s),
own AS (SELECT occ, min_by(kind, kind) AS kind FROM (SELECT DISTINCT occ, kind FROM v) GROUP BY 1), x AS (SELECT own.occ, own.kind, kinds.kind AS c, 0.5 * coalesce(m, 0) / max(coalesce(m, 0)) OVER (PARTITION BY own.occ) AS sc FROM own, kinds LEFT JOIN v ON v.occ = own.occ AND v.kind = kinds.kind),
b AS (SELECT occ, kind, max(sc) FILTER (c = kind) AS own_score, max(sc) AS best_score, arg_min(c, (-sc, c)) AS best FROM x GROUP BY 1, 2)
SELECT occ AS occurrence, CASE WHEN own_score < 0.5 * best_score THEN best ELSE kind END AS kind, round(own_score, 6) + 0.0 AS type_score, best, round(best_score, 6) + 0.0 AS best_score, round(CASE WHEN own_score < 0.5 * best_score THEN 1 ELSE own_score / best_score END, 6) + 0.0 AS type_confidence, own_score < 0.5 * best_score AS retyped FROM b""")
def occurrence_types(spark, sf):
    """Does the type of an occurrence (here the first by name of its parts' types) fit its rows?"""
    _, b, o = _occ(spark, sf)
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    s = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("k"), F.col("p_type").alias("kind")).agg(F.count("*").alias("value"))
    own = b.where("belonging > 0").join(s, "k").groupBy("occurrence").agg(F.min("kind").alias("kind"))
    return _round(ev.retype(b, s, own, "k"), "type_score", "best_score", "type_confidence")


@query("merged_types", f"""WITH {OCC}, m AS (SELECT f AS kind, k, occ AS occurrence FROM r), cl AS (SELECT occurrence, kind, mass, right(occurrence, 4) || CASE WHEN kind < '3' THEN 'a' WHEN kind < '5' THEN 'b' ELSE 'c' END AS cluster FROM oc),
ld AS (SELECT cluster, count(DISTINCT kind) AS kinds, arg_max(kind, (mass, kind)) AS lead FROM cl GROUP BY 1)
SELECT DISTINCT CASE WHEN kinds > 1 THEN lead ELSE m.kind END AS kind, k, CASE WHEN kinds > 1 THEN 'event ' || cluster ELSE m.occurrence END AS occurrence FROM m JOIN cl USING (occurrence) JOIN ld USING (cluster)""")
def merged_types(spark, sf):
    """Events of several types (two frames of a year) as one occurrence of the heavier type."""
    r, _, o = _occ(spark, sf)
    part = F.when(F.col("kind") < "3", "a").when(F.col("kind") < "5", "b").otherwise("c")
    clusters = o.select("occurrence", F.concat(F.substring("occurrence", -4, 4), part).alias("cluster"))
    return ev.merge_types(r.select(F.col("f").alias("kind"), "k", "occurrence"), clusters, o, "k")


@query("remapped_events", f"""WITH {OCC}, cl AS (SELECT occurrence, right(occurrence, 4) AS cluster FROM oc), nw AS (SELECT DISTINCT 'final ' || occ AS occurrence, occ AS old FROM r WHERE year(d) % 2 = 0), got AS (SELECT nw.occurrence, cluster FROM cl JOIN nw ON nw.old = cl.occurrence)
SELECT occurrence, substr(sha256(cluster || '|' || min(occurrence) OVER (PARTITION BY cluster)), 1, 12) AS cluster FROM got""")
def remapped_events(spark, sf):
    """Events carried over to final occurrences, of which only those of even years are left."""
    r, _, o = _occ(spark, sf)
    old = r.select("occurrence", F.col("f").alias("kind"), "k")
    new = r.where(F.year("d") % 2 == 0).select(F.concat(F.lit("final "), F.col("occurrence")).alias("occurrence"), F.col("f").alias("kind"), "k")
    return ev.remap(o.select("occurrence", F.substring("occurrence", -4, 4).alias("cluster")), old, new, "k")


@query("type_rankings", f"WITH {OCC} SELECT right(occurrence, 4) AS cluster, kind, round(sum(mass), 4) + 0.0 AS mass, row_number() OVER (PARTITION BY right(occurrence, 4) ORDER BY sum(mass) DESC, kind) AS place FROM oc GROUP BY 1, 2")
def type_rankings(spark, sf):
    _, _, o = _occ(spark, sf)
    got = ev.type_ranking(o.select("occurrence", F.substring("occurrence", -4, 4).alias("cluster")), o)
    return _round(got, "mass", digits=4).withColumn("place", F.col("place").cast("long"))


@query("occurrence_confidence", f"""WITH {OCC}, a AS (SELECT occ, avg(bel) AS t, count(DISTINCT outlet) AS m, count(*) AS n, count(*) FILTER (k % 4 = 0) AS s, sum(bel) AS mass, max(k) % 10 / 10 AS sim FROM r WHERE k % 60 < 3 GROUP BY 1),
p AS (SELECT occ, t, greatest(0, least(1, (sim - 0.2) / 0.8)) AS c, 1 - 1 / greatest(m, 1) AS d, greatest(0, least(1, (n / greatest(s, 1) - 1) / 2)) AS q, least(1, mass / 10) AS z FROM a)
SELECT occ AS occurrence, round(t, 6) + 0.0 AS tightness, round(c, 6) + 0.0 AS coherence, round(d, 6) + 0.0 AS diversity, round(q, 6) + 0.0 AS recruitment, round(z, 6) + 0.0 AS size, round(0.2 * (t + c + d + q + z), 6) + 0.0 AS confidence, 0.2 * (t + c + d + q + z) < 0.4 AS low_confidence FROM p""")
def occurrence_confidence(spark, sf):
    """The five parts of an occurrence's confidence; its likeness is stood for by a number from its rows."""
    r, b, o = _occ(spark, sf)
    some = F.col("k") % 60 < 3  # an occurrence's rows; the seeds are some of them
    alike = r.where(some).groupBy("occurrence").agg((F.max("k") % 10 / 10).alias("similarity"))
    got = ev.occurrence_confidence(o, b.where(some), r.where(some & (F.col("k") % 4 == 0)), r, "k", "outlet", alike, 0.2)
    return _round(got, "tightness", "coherence", "diversity", "recruitment", "size", "confidence")


@query("ranked_types", f"""WITH {OCC}, cl AS (SELECT occurrence, kind, mass, right(occurrence, 4) AS cluster FROM oc), ms AS (SELECT cluster, kind, sum(mass) AS mass FROM cl GROUP BY 1, 2), sh AS (SELECT *, mass / sum(mass) OVER (PARTITION BY cluster) AS share, count(*) OVER (PARTITION BY cluster) AS n FROM ms),
h AS (SELECT DISTINCT right(occ, 4) AS cluster, f AS kind, c FROM r), hn AS (SELECT cluster, kind, count(*) AS n FROM h GROUP BY 1, 2), j AS (SELECT a.cluster, a.kind, z.kind AS other, count(*) AS c FROM h a JOIN h z ON a.cluster = z.cluster AND a.c = z.c AND a.kind <> z.kind GROUP BY 1, 2, 3),
l AS (SELECT j.cluster, j.kind, sum(j.c / (x.n + y.n - j.c)) AS j FROM j JOIN hn x ON x.cluster = j.cluster AND x.kind = j.kind JOIN hn y ON y.cluster = j.cluster AND y.kind = j.other GROUP BY 1, 2), sc AS (SELECT occurrence, k.kind, CASE WHEN k.kind = cl.kind THEN 0.8 WHEN k.kind < cl.kind THEN 0.3 ELSE 0.1 END AS score, cluster, mass FROM cl, (SELECT DISTINCT kind FROM cl) k),
w AS (SELECT cluster, kind, sum(mass * score) AS w FROM sc GROUP BY 1, 2), t AS (SELECT cluster, sum(mass) AS t FROM ms GROUP BY 1), x AS (SELECT sh.cluster, sh.kind, coalesce(j, 0) / (n - 1) AS connectivity, 0.6 * share + 0.4 * coalesce(j, 0) / (n - 1) AS s, w / t AS l FROM sh LEFT JOIN l ON l.cluster = sh.cluster AND l.kind = sh.kind JOIN w ON w.cluster = sh.cluster AND w.kind = sh.kind JOIN t ON t.cluster = sh.cluster),
y AS (SELECT *, 0.5 * s / max(s) OVER (PARTITION BY cluster) + 0.5 * l / max(l) OVER (PARTITION BY cluster) AS score FROM x)
SELECT cluster, kind, round(connectivity, 6) + 0.0 AS connectivity, CASE WHEN connectivity > 0 THEN 'constitutive' ELSE 'satellite' END AS role, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(score, 12) DESC, kind) AS INTEGER) AS place FROM y""")
def ranked_types(spark, sf):
    """Types of a year's orders by mass, by customers in common, and by a score."""
    r, _, o = _occ(spark, sf)
    clusters = o.select("occurrence", F.substring("occurrence", -4, 4).alias("cluster"))
    kinds = o.select(F.col("kind").alias("_k")).distinct()
    scores = o.crossJoin(F.broadcast(kinds)).select("occurrence", F.col("_k").alias("kind"), F.when(F.col("_k") == F.col("kind"), 0.8).when(F.col("_k") < F.col("kind"), 0.3).otherwise(0.1).alias("score"))  # the closed list of frames
    return _round(ev.ranked_types(r.select("occurrence", F.col("f").alias("kind"), "c"), clusters, o, "c", scores), "connectivity", "score")


@query("information_pairs", f"""WITH {DAILY}, w AS (SELECT CAST(d + CAST((7 - isodow(d)) AS INTEGER) AS DATE) AS week, f, avg(p) AS p FROM s GROUP BY 1, 2), bn AS MATERIALIZED (SELECT week, f, row_number() OVER (PARTITION BY f ORDER BY week) AS i, least(CAST(floor(round((p - min(p) OVER (PARTITION BY f)) / (max(p) OVER (PARTITION BY f) - min(p) OVER (PARTITION BY f)) * 5, 9)) AS INTEGER), 4) AS b FROM w),
x AS MATERIALIZED (SELECT a.f AS a, z.f AS z, a.i, a.b AS xa, z.b AS xz, lag(a.b) OVER q AS pa, lag(z.b) OVER q AS pz FROM bn a JOIN bn z ON a.i = z.i AND a.f <> z.f WINDOW q AS (PARTITION BY a.f, z.f ORDER BY a.i)),
h1 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM x GROUP BY a, z, xa) GROUP BY 1, 2), h2 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM x GROUP BY a, z, xz) GROUP BY 1, 2),
h3 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM x GROUP BY a, z, xa, xz) GROUP BY 1, 2), y AS (SELECT * FROM x WHERE pa IS NOT NULL),
t1 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM y GROUP BY a, z, xz, pz) GROUP BY 1, 2), t2 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM y GROUP BY a, z, pz) GROUP BY 1, 2),
t3 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM y GROUP BY a, z, xz, pz, pa) GROUP BY 1, 2), t4 AS (SELECT a, z, -sum(p * log2(p)) AS h FROM (SELECT a, z, count(*) / sum(count(*)) OVER (PARTITION BY a, z) AS p FROM y GROUP BY a, z, pz, pa) GROUP BY 1, 2)
SELECT a AS source, z AS target, round(h1.h + h2.h - h3.h, 6) + 0.0 AS mutual_information, round(h3.h, 6) + 0.0 AS joint_entropy, round(h3.h - h1.h, 6) + 0.0 AS conditional_entropy, round(t1.h - t2.h - t3.h + t4.h, 6) + 0.0 AS transfer_entropy FROM h1 JOIN h2 USING (a, z) JOIN h3 USING (a, z) JOIN t1 USING (a, z) JOIN t2 USING (a, z) JOIN t3 USING (a, z) JOIN t4 USING (a, z)""")
def information_pairs(spark, sf):
    """What a frame's weekly share says of another's, in bits, over five classes of equal width."""
    w = series.weekly(daily(spark, sf), "f", "d").select("f", "week", "proportion")
    x = w.withColumnsRenamed({"f": "a", "proportion": "x"}).join(w.withColumnsRenamed({"f": "z", "proportion": "y"}), "week").where("a <> z").withColumn("pair", F.concat_ws(">", "a", "z"))

    def run(p):
        p = p.sort_values("week")
        a, z = stats.bins(p["x"].to_numpy()), stats.bins(p["y"].to_numpy())
        joint = stats.joint_entropy(a, z)
        return [(p["a"].iloc[0], p["z"].iloc[0], stats.mutual_information(a, z), joint, joint - stats.joint_entropy(a), stats.transfer_entropy(a, z))]

    got = dq.per_group(x, "pair", run, "source string, target string, mutual_information double, joint_entropy double, conditional_entropy double, transfer_entropy double")
    return _round(got, "mutual_information", "joint_entropy", "conditional_entropy", "transfer_entropy")


@query("adaptive_membership")
def adaptive_membership(spark, sf):
    """Soft membership with a threshold for each occurrence, in two rounds."""
    from .analysis_queries import _belonging

    r, m, _, c, _ = _belonging(spark, sf)
    return ev.assign_twice(r, m, c, "kind", "key", "day", "embedding", "w", DIM)[0]


# --- impact -------------------------------------------------------------------------


@query("near_windows", f"""WITH {DAILY}, {WINDOWS}, p AS (SELECT l.burst_id AS a, r.burst_id AS z, exp(-((l.onset - r."end") / 21.0) ** 2 / 2) AS p0, l.onset - r."end" AS k FROM b l JOIN b r ON l.f = '1-URGENT' AND r.f = '5-LOW')
SELECT a, z, round(exp(-(k * k) / 882.0), 6) + 0.0 AS proximity FROM p WHERE exp(-(k * k) / 882.0) >= 0.01""")
def near_windows(spark, sf):
    """Windows of two frames that are near in time, one's onset to the other's end, without comparing all."""
    w = windows(spark, sf)
    a = w.where("f = '1-URGENT'").select(F.col("burst_id").alias("a"), "onset")
    z = w.where("f = '5-LOW'").select(F.col("burst_id").alias("z"), "end")
    return _round(impact.near_pairs(a, z, "onset", "end").select("a", "z", "proximity"), "proximity")


@query("attribution_confidence", """WITH x AS (SELECT l_orderkey, l_linenumber, l_tax AS p, l_discount AS q, l_quantity / 100 AS aff, CASE WHEN l_linenumber <> 2 THEN l_discount * 8 END AS al, exp(-((l_quantity / 21) ** 2) / 2) AS near FROM lineitem),
y AS (SELECT *, 0.3 + 0.7 * least(1, 0.6 * least(1, aff / 0.2) + 0.4 * coalesce(least(greatest(al, 0), 1), 0.5)) AS content FROM x)
SELECT l_orderkey, l_linenumber, round(content, 6) + 0.0 AS content, round(0.3 * least(greatest(1 - p / 0.1, 0), 1) + 0.3 * least(greatest(1 - q / 0.1, 0), 1) + 0.25 * least(greatest(content, 0), 1) + 0.15 * least(greatest(near, 0), 1), 6) + 0.0 AS confidence FROM y""")
def attribution_confidence(spark, sf):
    """The composite confidence of an attribution, from p-values, content and nearness that columns stand for."""
    li = table(spark, sf, "lineitem")
    content = impact.content_relevance(F.col("l_quantity") / 100, F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 8))
    x = li.withColumn("content", content)
    conf = impact.attribution_confidence(F.col("l_tax"), F.col("l_discount"), F.col("content"), F.exp(-F.pow(F.col("l_quantity") / 21, 2) / 2))
    return _round(x.select("l_orderkey", "l_linenumber", "content", conf.alias("confidence")), "content", "confidence")


EFFECTS = "ef AS (SELECT s, f, (avg(v) - 140000) / 10000 AS beta, count(*) / 1000 AS weight FROM o GROUP BY 1, 2), pk AS (SELECT s, CAST(min(d) AS DATE) + 100 AS peak FROM o GROUP BY 1)"


def _effects(spark, sf):
    o = articles(spark, sf)
    e = o.groupBy("s", "f").agg(((F.avg("v") - 140000) / 10000).alias("beta"), (F.count("*") / 1000).alias("weight"))
    return e.join(o.groupBy("s").agg(F.date_add(F.min("d"), 100).alias("peak")), "s")


@query("effect_magnitude", f"WITH {ARTICLES}, {EFFECTS} SELECT s, round(sqrt(sum(beta * beta)) * max(weight), 4) + 0.0 AS magnitude FROM ef GROUP BY 1")
def effect_magnitude(spark, sf):
    return _round(impact.magnitude(_effects(spark, sf), "s", "beta", "weight"), "magnitude", digits=4)


@query("shift_contribution", f"""WITH {DAILY}, {EFFECTS}, t AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM s)), n AS (SELECT max(i) AS n FROM t), spot AS (SELECT pk.s, arg_min(i, (abs(d - peak), d)) AS i FROM pk, t GROUP BY 1)
SELECT ef.s, round(sum(abs(beta) * abs(h.p - l.p)), 6) + 0.0 AS contribution FROM ef JOIN spot USING (s) JOIN n ON TRUE JOIN t tl ON tl.i = greatest(spot.i - 7, 1) JOIN t th ON th.i = least(spot.i + 7, n.n) JOIN s l ON l.f = ef.f AND l.d = tl.d JOIN s h ON h.f = ef.f AND h.d = th.d GROUP BY 1""")
def shift_contribution(spark, sf):
    got = impact.shift_contribution(_effects(spark, sf), daily(spark, sf), "s", "f", "beta", "peak", "d", "proportion")
    return _round(got, "contribution")


@query("diff_in_diff", f"""WITH {DAILY}, {WINDOWS}, x AS (SELECT burst_id, CASE WHEN s.d < onset THEN 0 ELSE 1 END AS late, p FROM b JOIN s ON s.f = b.f AND s.d BETWEEN onset - 14 AND onset + 28),
a AS (SELECT burst_id, avg(p) FILTER (late = 1) AS m1, avg(p) FILTER (late = 0) AS m0, var_samp(p) FILTER (late = 1) / count(*) FILTER (late = 1) AS v1, var_samp(p) FILTER (late = 0) / count(*) FILTER (late = 0) AS v0, count(*) FILTER (late = 1) AS n1, count(*) FILTER (late = 0) AS n0 FROM x GROUP BY 1 HAVING count(*) FILTER (late = 1) > 1 AND count(*) FILTER (late = 0) > 1),
t AS (SELECT burst_id, m1 - m0 AS did, CASE WHEN v1 + v0 > 0 THEN abs(m1 - m0) / sqrt(v1 + v0) ELSE 0 END AS t, CASE WHEN v1 + v0 > 0 THEN (v1 + v0) ** 2 / (v1 ** 2 / (n1 - 1) + v0 ** 2 / (n0 - 1)) ELSE 1 END AS df FROM a)
SELECT burst_id, round(did, 6) + 0.0 AS did, round(2 * {student_tail("t", "df")}, 6) + 0.0 AS p FROM t""")
def diff_in_diff(spark, sf):
    """Mean of a window's first four weeks less that of the two weeks before, with Welch's p."""
    b = windows(spark, sf).select("f", "burst_id", "onset")
    spans = b.withColumn("d", F.explode(F.sequence(F.date_sub("onset", 14), F.date_add("onset", 28))))
    x = spans.join(daily(spark, sf).select("f", "d", "proportion"), ["f", "d"])

    def run(p):
        p = p.sort_values("d")
        late = (p["d"] >= p["onset"]).to_numpy()
        v = p["proportion"].to_numpy()
        if late.sum() < 2 or (~late).sum() < 2:
            return []
        did, q = stats.diff_in_diff(v, int((~late).sum()))
        return [(p["burst_id"].iloc[0], did, q)]

    return _round(dq.per_group(x, "burst_id", run, "burst_id string, did double, p double"), "did", "p")


@query("partial_spearman", f"""WITH {DAILY}, w AS (SELECT CAST(d + CAST((7 - isodow(d)) AS INTEGER) AS DATE) AS week, f, avg(p) AS p FROM s GROUP BY 1, 2), x AS (SELECT a.week, a.p AS x, b.p AS y, c.p AS z FROM w a JOIN w b USING (week) JOIN w c USING (week) WHERE a.f = '1-URGENT' AND b.f = '2-HIGH' AND c.f = '3-MEDIUM'),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS z FROM x),
c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, count(*) AS n FROM r), p AS (SELECT (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS rho, n FROM c), t AS (SELECT rho, n, abs(rho) * sqrt((n - 3) / (1 - rho * rho)) AS t FROM p)
SELECT round(rho, 6) + 0.0 AS rho, round(2 * {student_tail("t", "(n - 3)")}, 6) + 0.0 AS p, n FROM t""")
def partial_spearman(spark, sf):
    """Rank correlation of two frames' weekly shares with what a third explains taken out."""
    w = series.weekly(daily(spark, sf), "f", "d").groupBy("week").pivot("f", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.first("proportion")).dropna()

    def run(p):
        rho, q = stats.partial_spearman(p["1-URGENT"].to_numpy(), p["2-HIGH"].to_numpy(), p["3-MEDIUM"].to_numpy())
        return [(rho, q, len(p))]

    return _round(dq.per_group(w.withColumn("one", F.lit(1)), "one", run, "rho double, p double, n long"), "rho", "p")


# --- dominance ----------------------------------------------------------------------


@query("dominant_composition", f"""WITH {DAILY}, w AS (SELECT CAST(d + CAST((7 - isodow(d)) AS INTEGER) AS DATE) AS week, f, avg(p) AS p FROM s GROUP BY 1, 2), x AS (SELECT *, round(p, 9) >= round(avg(p) OVER (PARTITION BY week), 9) AS top FROM w), y AS (SELECT *, CASE WHEN top THEN p ELSE 0 END AS v, count(*) FILTER (top) OVER (PARTITION BY week) AS size FROM x)
SELECT week, f, size, round(CASE WHEN sum(v) OVER (PARTITION BY week) > 0 THEN v / sum(v) OVER (PARTITION BY week) ELSE 0 END, 6) + 0.0 AS share, CASE size WHEN 0 THEN 'none' WHEN 1 THEN 'mono' WHEN 2 THEN 'dual' WHEN 3 THEN 'triple' ELSE 'multiple' END AS kind FROM y""")
def dominant_composition(spark, sf):
    """Weekly shares among the frames at or above the week's mean, the others at zero."""
    w = series.weekly(daily(spark, sf), "f", "d").withColumn("m", F.avg("proportion").over(Window.partitionBy("week")))
    got = paradigm.composition(w, "f", "week", "proportion", F.round("proportion", 9) >= F.round("m", 9))
    return _round(got.withColumn("kind", paradigm.size_label(F.col("size"))), "share")


@query("regime_durations", """WITH p AS (SELECT CAST(ts AS DATE) AS d, event_type AS k, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT d, k, round(avg(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS v FROM p),
l AS (SELECT d, arg_max(k, (v, k)) AS after FROM s GROUP BY d), x AS (SELECT d, lag(after) OVER (ORDER BY d) AS before, after FROM l), r AS (SELECT d AS shift_date, before, after FROM x WHERE before <> after),
n AS (SELECT *, lead(shift_date) OVER (ORDER BY shift_date) AS nx, lead(after) OVER (ORDER BY shift_date) AS back FROM r)
SELECT shift_date, CAST(coalesce(nx, DATE '2024-12-31') - shift_date AS INTEGER) AS regime_days, coalesce(nx, DATE '2024-12-31') - shift_date >= 91 AS structural, coalesce(back = before, FALSE) AS reversible FROM n""")
def regime_durations(spark, sf):
    """How long each regime of the leading event type lasts, and whether the next shift undoes it."""
    p = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.avg("value").alias("v"))
    r = ev.regimes(p, "kind", "day", "v").select(F.col("day").alias("shift_date"), F.array("before").alias("before"), F.array("after").alias("after"))
    return paradigm.qualify(r, F.lit("2024-12-31").cast("date")).select("shift_date", "regime_days", "structural", "reversible")


@query("twosided_composite", f"WITH {ZED} SELECT f AS frame, d AS day, round(0.7 * coalesce(z2, 0) + 0.3 * coalesce(greatest(z2, 0), 0), 6) + 0.0 AS composite FROM z")
def twosided_composite(spark, sf):
    """A composite of a two-sided and a one-sided score."""
    s = series.trailing_z(daily(spark, sf), "proportion", ["f"], "d", one_sided=False).withColumnRenamed("z", "a")
    s = series.trailing_z(s, "proportion", ["f"], "d").withColumnRenamed("z", "b")
    return s.select(F.col("f").alias("frame"), F.col("d").alias("day"), rounded(series.composite({"a": 0.7, "b": 0.3})).alias("composite"))


# --- rows and sources ----------------------------------------------------------------


@query("source_profiles", "SELECT l_orderkey AS doc, l_returnflag AS source, round(count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey), 6) + 0.0 AS share FROM lineitem GROUP BY 1, 2")
def source_profiles(spark, sf):
    """The shares of its sources in each document's sentences."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"))
    return n.select("doc", "source", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("doc"))).alias("share"))


@query("source_shares_by_burst", f"WITH {INSIDE} SELECT burst_id, s AS source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY burst_id), 6) + 0.0 AS share FROM x GROUP BY 1, 2")
def source_shares_by_burst(spark, sf):
    from ..operators.relational import range_join

    w = windows(spark, sf)
    x = range_join(articles(spark, sf), w, ["f"], "d", "onset", "end").groupBy("burst_id", F.col("s").alias("source")).agg(F.count("*").alias("n"))
    return x.select("burst_id", "source", "n", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("burst_id"))).alias("share"))


@query("adjacency", "WITH x AS (SELECT DISTINCT l_orderkey AS k, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), e AS (SELECT a.b AS node, z.b AS partner, count(*) AS weight FROM x a JOIN x z ON a.k = z.k AND a.b <> z.b GROUP BY 1, 2) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength, arg_max(partner, (weight, partner)) AS closest FROM e GROUP BY 1")
def adjacency(spark, sf):
    """Of each brand the brands that share documents with it: how many, how strongly, and the closest."""
    from ..operators.relational import co_edges

    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    e = co_edges(li.join(p, li.l_partkey == p.p_partkey), ["l_orderkey"], "p_brand")
    two = e.select(F.col("src").alias("node"), F.col("dst").alias("partner"), "weight").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("partner"), "weight"))
    return two.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"), F.max_by("partner", F.struct("weight", "partner")).alias("closest"))


@query("annotated_rows", "SELECT f, count(*) AS n FROM (SELECT l_returnflag AS f, l_discount AS v FROM lineitem) WHERE v > 0 GROUP BY f")
def annotated_rows(spark, sf):
    """Rows with an annotation, whose column is the bare one, else the sum, else the mean."""
    from ..functions.exprs import annotation

    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_discount").alias("mark_mean"))
    return li.where(annotation(li, "mark") > 0).groupBy("f").agg(F.count("*").alias("n"))


@query("valid_rows", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL AND year(o_orderdate) < 1999")
def valid_rows(spark, sf):
    """Rows with a key and a day before a year."""
    return src.valid(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate", 1999)


@query("titled_counts", "SELECT count(*) AS sentences, count(DISTINCT conv_id) FILTER (role IS NOT NULL) AS titled FROM conversations")
def titled_counts(spark, sf):
    return src.sentence_counts(table(spark, sf, "conversations"), "conv_id", "role")


@query("sliced_scan", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1995-06-01' AND o_orderdate < DATE '2000-03-02' GROUP BY 1")
def sliced_scan(spark, sf):
    """A range of days read as 7 slices that are put together again."""
    from datetime import date

    cut = src.slices(date(1995, 6, 1), date(2000, 3, 1), 7)
    parts = [table(spark, sf, "orders").where((F.col("o_orderdate") >= F.lit(a)) & (F.col("o_orderdate") < F.lit(b))) for a, b in cut]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("csv_dimension", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_dimension(spark, sf):
    """A dimension written as CSV and loaded again."""
    place = os.path.join(shared_dir(spark), f"dimension-{uuid.uuid4().hex[:8]}")
    table(spark, sf, "nation").write.option("header", True).csv(place)
    return src.dimension(spark, place, "n_nationkey int, n_name string, n_regionkey int")


@query("catalog_columns", "SELECT column_name, CAST(ordinal_position AS INTEGER) AS position FROM information_schema.columns WHERE table_name = 'lineitem'")
def catalog_columns(spark, sf):
    """The columns of a table, as the catalog has them."""
    table(spark, sf, "lineitem").createOrReplaceTempView("tidemark_lineitem")
    names = [n for n, _ in src.columns_of(spark, "tidemark_lineitem")]
    return spark.createDataFrame(list(zip(names, range(1, len(names) + 1))), "column_name string, position int")


@query("concurrent_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "customer", "part")))
def concurrent_counts(spark, sf):
    """Several queries at once, on one session."""
    got = src.run_all({t: table(spark, sf, t).count for t in ("orders", "customer", "part")})
    return spark.createDataFrame(sorted(got.items()), "name string, n long")


@query("json_round_trip", "SELECT o_orderstatus AS s, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds, count(*) AS n FROM orders GROUP BY 1")
def json_round_trip(spark, sf):
    """An index with nested columns, saved as JSON and loaded again."""
    place = os.path.join(shared_dir(spark), f"index-{uuid.uuid4().hex[:8]}")
    x = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"), F.count("*").alias("n"))
    src.save_index(x, place, "json")
    return src.load_index(spark, place, "json", x.schema).withColumn("kinds", F.array_join("kinds", ","))


@query("cached_result", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def cached_result(spark, sf):
    """A result that is kept by the digest of its query, taken the second time."""
    cache = src.QueryCache(spark, os.path.join(shared_dir(spark), f"cache-{uuid.uuid4().hex[:8]}"), most=4)
    make = lambda: table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    cache.get("customers by nation", make)
    return cache.get("customers by nation", make)
