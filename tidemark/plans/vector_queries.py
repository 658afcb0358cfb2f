"""Queries over embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rounded
from ..operators import vectors
from .tables import student_tail, table

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


BASE = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c, max(n) AS n FROM (SELECT label, i, avg(v[i]) AS m, count(*) AS n FROM e, range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"""


def _pairs(of: str, by: str) -> str:
    """Mean cosine of all pairs of rows of a table with unit vectors u, by columns."""
    return f"(SELECT {by}, (list_dot_product(s, s) - n) / (n * (n - 1)) AS sim, n FROM (SELECT {by}, list(x ORDER BY i) AS s, max(n) AS n FROM (SELECT {by}, i, sum(u[i]) AS x, count(*) AS n FROM {of}, range(1, 65) t(i) GROUP BY {by}, i) GROUP BY {by}))"


def _e(spark, sf):
    return table(spark, sf, "embeddings")


@query("label_centroids", f"WITH {BASE} SELECT label, n, unnest(range(0, 64)) AS pos, round(unnest(c), 6) + 0 AS value FROM c")
def label_centroids(spark, sf):
    c = vectors.centroids(_e(spark, sf), ["label"], "embedding", DIM)
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "value")).select("label", "n", F.col("pos").cast("long").alias("pos"), rounded(F.col("value")).alias("value"))


@query("centroid_cosine", f"WITH {BASE} SELECT vec_id, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c)), 6) + 0 AS similarity FROM e JOIN c USING (label)")
def centroid_cosine(spark, sf):
    return vectors.centroid_similarity(_e(spark, sf), "label", "embedding", DIM).select("vec_id", rounded(F.col("similarity")).alias("similarity"))


@query("centroid_distance", f"WITH {BASE} SELECT label, round(avg(1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c))), 6) + 0 AS distance FROM e JOIN c USING (label) GROUP BY label")
def centroid_distance(spark, sf):
    x = vectors.centroid_similarity(_e(spark, sf), "label", "embedding", DIM)
    return x.groupBy("label").agg(rounded(F.avg(1 - F.col("similarity"))).alias("distance"))


@query("mean_pairwise_cosine", f"WITH {BASE} SELECT label, CAST(n AS BIGINT) AS n, round(sim, 6) + 0 AS similarity FROM {_pairs('u', 'label')}")
def mean_pairwise_cosine(spark, sf):
    return vectors.mean_pairwise(_e(spark, sf), ["label"], "embedding", DIM).withColumn("similarity", rounded(F.col("similarity")))


@query("cross_group_alignment", f"WITH {BASE}, cu AS (SELECT 1 AS one, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM c WHERE n >= 2) SELECT CAST(n AS BIGINT) AS groups, round(sim, 6) + 0 AS alignment FROM {_pairs('cu', 'one')}")
def cross_group_alignment(spark, sf):
    return vectors.group_alignment(_e(spark, sf), "label", "embedding", DIM).withColumn("alignment", rounded(F.col("alignment")))


@query("residual_similarity", f"WITH {BASE}, a AS (SELECT 1 AS one, u FROM u), b AS (SELECT sim AS b FROM {_pairs('a', 'one')}) SELECT label, round(least(greatest((sim - b) / (1 - b), 0), 1), 6) AS residual FROM {_pairs('u', 'label')}, b")
def residual_similarity(spark, sf):
    """Mean pairwise cosine of each label beyond that of the whole corpus, whose exact value is one pass."""
    e = _e(spark, sf)
    base = vectors.mean_pairwise(e, [], "embedding", DIM).select(F.col("similarity").alias("b"))
    x = vectors.mean_pairwise(e, ["label"], "embedding", DIM).crossJoin(F.broadcast(base))  # one row
    return x.select("label", rounded(vectors.residual(F.col("similarity"), F.col("b"))).alias("residual"))


@query("convergence_trend", f"""WITH {BASE}, k AS (SELECT label, u, least((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // (count(*) OVER (PARTITION BY label) // 5), 4) AS k FROM u QUALIFY count(*) OVER (PARTITION BY label) >= 10),
p AS (SELECT label, k, sim FROM {_pairs('k', 'label, k')}), r AS (SELECT label, regr_slope(sim, k) AS slope, regr_r2(sim, k) AS r2, count(*) AS chunks FROM p GROUP BY label)
SELECT label, round(slope, 6) + 0 AS slope, round(r2, 5) + 0 AS r2, round(2 * {student_tail("sqrt(r2 * (chunks - 2) / (1 - r2))", "(chunks - 2)")}, 5) + 0.0 AS p, chunks FROM r""")
def convergence_trend(spark, sf):
    x = vectors.convergence_trend(_e(spark, sf), "label", ["vec_id"], "embedding", DIM)
    return x.select("label", rounded(F.col("slope")).alias("slope"), rounded(F.col("r2"), 5).alias("r2"), rounded(F.col("p"), 5).alias("p"), "chunks")


@query("top_quartile_centroid", f"""WITH {BASE}, q AS (SELECT label, quantile_cont(vec_id, 0.75) AS q FROM e GROUP BY label), t AS (SELECT e.label, v, vec_id AS w FROM e JOIN q USING (label) WHERE vec_id >= q)
SELECT label, i - 1 AS pos, round(sum(v[i] * w) / sum(w), 6) + 0 AS value FROM t, range(1, 65) r(i) GROUP BY label, i""")
def top_quartile_centroid(spark, sf):
    """Weighted mean of the quarter of each label's rows with the strongest signal, here the row's id."""
    c = vectors.top_quartile_centroid(_e(spark, sf).withColumn("signal", F.col("vec_id").cast("double")), "label", "signal", "embedding", DIM)
    return c.select("label", F.posexplode("centroid").alias("pos", "value")).select("label", F.col("pos").cast("long").alias("pos"), rounded(F.col("value")).alias("value"))


@query("vector_lookup", "SELECT vec_id, label, len(embedding) AS dim, round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS norm2 FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def vector_lookup(spark, sf):
    from ..functions.exprs import dot

    e = _e(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return e.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), rounded(dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"))


@query("blended_vectors", f"""WITH {BASE}, t AS (SELECT label, list(m ORDER BY i) AS t FROM (SELECT label, i, max(v[i]) AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e) x, range(1, 65) g(i) WHERE r = 1 GROUP BY label, i) GROUP BY label),
b AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e) x, range(1, 65) g(i) WHERE r > 1 GROUP BY label, i)
SELECT b.label, i - 1 AS pos, round(0.3 * t.t[i] + 0.7 * m, 6) + 0 AS value FROM b JOIN t USING (label)""")
def blended_vectors(spark, sf):
    """Three tenths of a label's first vector, as its title, and seven of the mean of the others."""
    from pyspark.sql import Window

    e = _e(spark, sf).withColumn("part", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    got = vectors.blended_vectors(e, "label", "part", "embedding", DIM, F.lit(True))
    return got.select("label", F.posexplode("embedding").alias("pos", "value")).select("label", F.col("pos").cast("long").alias("pos"), rounded(F.col("value")).alias("value"))


@query("near_duplicates", f"""WITH RECURSIVE {BASE}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM u), sim AS MATERIALIZED (SELECT a.label, a.i, b.vec_id AS other, list_dot_product(a.u, b.u) AS s FROM o a JOIN o b ON a.label = b.label AND b.i < a.i WHERE list_dot_product(a.u, b.u) > 0.95),
g(label, i, kept, vec_id, hit) AS (SELECT label, i, [vec_id], vec_id, CAST(NULL AS BIGINT) FROM o WHERE i = 1 UNION ALL
SELECT label, i, CASE WHEN hit IS NULL THEN list_append(kept, vec_id) ELSE kept END, vec_id, hit FROM (SELECT o.label, o.i, any_value(g.kept) AS kept, o.vec_id, arg_max(sim.other, (sim.s, -sim.other)) FILTER (list_contains(g.kept, sim.other)) AS hit FROM g JOIN o ON o.label = g.label AND o.i = g.i + 1 LEFT JOIN sim ON sim.label = o.label AND sim.i = o.i GROUP BY o.label, o.i, o.vec_id))
SELECT label, vec_id, hit IS NULL AS kept, hit AS duplicate_of FROM g""")
def near_duplicates(spark, sf):
    return vectors.near_duplicates(_e(spark, sf), "label", "vec_id", "embedding")


@query("novelty_decay", f"""WITH {BASE}, o AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM e), r AS (SELECT label, i, j, v[j] AS x, sum(v[j]) OVER (PARTITION BY label, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM o, range(1, 65) g(j)),
n AS (SELECT label, i, CASE WHEN i = 0 THEN 1 ELSE 1 - sum(x * t) / sqrt(sum(x * x)) / sqrt(sum(t * t)) END AS nov FROM r GROUP BY 1, 2), k AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, max(CASE WHEN i = 0 THEN nov END) OVER (PARTITION BY label) AS first FROM n)
SELECT label, max(n) AS n, round(-regr_slope(nov, i), 6) + 0.0 AS decay, round(avg(nov) FILTER (i >= n - greatest(1, n // 5)), 6) + 0.0 AS last_novelty, CAST(min(i) FILTER (nov <= first / 2) AS DOUBLE) AS half_life FROM k GROUP BY label""")
def novelty_decay(spark, sf):
    got = vectors.novelty(_e(spark, sf), "label", ["vec_id"], "embedding")
    return got.withColumns({"decay": rounded(F.col("decay")), "last_novelty": rounded(F.col("last_novelty"))})
