"""Vectors as array columns: means, similarities, trends; and greedy or ordered kernels by group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import cosine, dot
from ..functions.stats import t_sf
from .ranks import quantile


def mean_vector(vector: str, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: the mean of a vector column, weighted if so asked; one pass, no exploded rows."""
    e = [F.get(vector, F.lit(i)).cast("double") for i in range(dim)]
    if weight is None:
        return F.array(*[F.avg(x) for x in e])
    return F.array(*[F.sum(x * weight) / F.sum(weight) for x in e])


def centroids(df: DataFrame, groups: Sequence[str], vector: str, dim: int, weight: Column | None = None) -> DataFrame:
    return df.groupBy(*groups).agg(mean_vector(vector, dim, weight).alias("centroid"), F.count("*").alias("n"))


def unit(vector: Column) -> Column:
    n = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def mean_pairwise(df: DataFrame, groups: Sequence[str], vector: str, dim: int) -> DataFrame:
    """(groups, n, similarity): mean cosine of all pairs, in one linear pass: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    u = df.withColumn("_u", unit(F.col(vector)))
    s = u.groupBy(*groups).agg(F.array(*[F.sum(F.get("_u", F.lit(i))) for i in range(dim)]).alias("_s"), F.sum(dot(F.col("_u"), F.col("_u"))).alias("_own"), F.count("*").alias("n"))
    n = F.col("n")
    return s.select(*groups, "n", F.when(n > 1, (dot(F.col("_s"), F.col("_s")) - F.col("_own")) / (n * (n - 1))).otherwise(0.0).alias("similarity"))


def centroid_similarity(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """``df`` with the cosine of each row with its group's mean."""
    return df.join(centroids(df, [group], vector, dim).drop("n"), group).withColumn("similarity", cosine(F.col(vector), F.col("centroid"))).drop("centroid")


def group_alignment(df: DataFrame, group: str, vector: str, dim: int, least: int = 2) -> DataFrame:
    """Mean cosine of all pairs of group means, of groups with ``least`` rows and more."""
    c = centroids(df, [group], vector, dim).where(F.col("n") >= least).drop("n")
    return mean_pairwise(c, [], "centroid", dim).select(F.col("n").alias("groups"), F.col("similarity").alias("alignment"))


def residual(similarity: Column, baseline: Column | float) -> Column:
    """A similarity beyond what any two rows of the corpus have, 0 to 1."""
    b = F.lit(baseline) if isinstance(baseline, float) else baseline
    return F.least(F.greatest((similarity - b) / (1 - b), F.lit(0.0)), F.lit(1.0))


def convergence_trend(df: DataFrame, group: str, order: Sequence[str], vector: str, dim: int, chunks: int = 5, least: int = 10) -> DataFrame:
    """(group, slope, r2, p, chunks): the mean pairwise cosine over ``chunks`` equal parts of a group's rows, in order.

    The last part takes what is over; groups of fewer than ``least`` rows are left out.
    ``p`` is the slope's two-sided p-value, 1 without enough parts.
    """
    w = Window.partitionBy(group).orderBy(*order)
    x = df.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") >= max(least, chunks))
    part = x.withColumn("_c", F.least(F.floor((F.row_number().over(w) - 1) / F.floor(F.col("_n") / chunks)), F.lit(chunks - 1)))
    sims = mean_pairwise(part, [group, "_c"], vector, dim)
    got = sims.groupBy(group).agg(F.regr_slope("similarity", "_c").alias("slope"), F.regr_r2("similarity", "_c").alias("r2"), F.count("*").alias("chunks"))

    def tail(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([2 * t_sf(math.sqrt(a * (k - 2) / (1 - a)), k - 2) if k > 2 and a is not None and 0 <= a < 1 else 0.0 if k > 2 and a == 1 else 1.0 for a, k in zip(r2, n)], dtype=float)

    return got.select(group, "slope", "r2", F.pandas_udf(tail, "double")("r2", "chunks").alias("p"), "chunks")  # a row a group


def top_quartile_centroid(df: DataFrame, group: str, signal: str, vector: str, dim: int) -> DataFrame:
    """Signal-weighted mean of the rows whose signal is in their group's top quarter."""
    limit = quantile(df, [group], signal, 0.75).withColumnRenamed("quantile", "_q")
    return centroids(df.join(limit, group).where(F.col(signal) >= F.col("_q")), [group], vector, dim, F.col(signal))


def near_duplicates(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.95, most: int = 20_000) -> DataFrame:
    """(group, key, kept, duplicate_of): in key order, a row goes if an earlier kept one is closer than ``threshold``.

    Greedy order makes this a kernel by group.  It streams a group's batches and holds
    the kept vectors only; a group that keeps more than ``most`` is refused, not cut.
    """

    def run(batches):
        now, keys, kept = None, [], None
        for pdf in batches:
            out = []
            for g, k, v in zip(pdf[group], pdf[key], pdf[vector]):
                if g != now:
                    now, keys, kept = g, [], np.zeros((0, len(v)))
                v = np.asarray(v, float)
                n = np.linalg.norm(v)
                v = v / n if n else v
                sims = kept[: len(keys)] @ v if keys else np.zeros(0)
                hit = int(sims.argmax()) if len(sims) and sims.max() > threshold else -1
                out.append((g, k, hit < 0, None if hit < 0 else keys[hit]))
                if hit < 0:
                    if len(keys) >= most:
                        raise ValueError(f"group {g!r} keeps more than {most} rows: give a finer group")
                    if len(keys) == len(kept):
                        kept = np.vstack([kept, np.zeros((max(64, len(kept)), len(v)))])
                    kept[len(keys)] = v
                    keys.append(k)
            yield pd.DataFrame(out, columns=[group, key, "kept", "duplicate_of"]).astype({"duplicate_of": "Int64"})

    types = dict(df.dtypes)
    schema = f"{group} {types[group]}, {key} {types[key]}, kept boolean, duplicate_of long"
    return df.select(group, key, vector).repartition(group).sortWithinPartitions(group, key).mapInPandas(run, schema)


def novelty(df: DataFrame, group: str, order: Sequence[str], vector: str, least: int = 5) -> DataFrame:
    """(group, n, decay, last_novelty, half_life): how far each row is from the mean of those before it, over time.

    A running sum is all that a group leaves in memory, besides one number a row.
    """

    def close(g, nov):
        if len(nov) < least:
            return (g, len(nov), None, None, None)
        x = np.arange(len(nov), dtype=float)
        slope = float(np.polyfit(x, nov, 1)[0])
        half = np.flatnonzero(np.array(nov) <= nov[0] / 2)
        return (g, len(nov), -slope, float(np.mean(nov[-max(1, len(nov) // 5) :])), float(half[0]) if len(half) else None)

    def run(batches):
        now, total, nov = None, None, []
        for pdf in batches:
            out = []
            for g, v in zip(pdf[group], pdf[vector]):
                v = np.asarray(v, float)
                if g != now:
                    if nov:
                        out.append(close(now, nov))
                    now, total, nov = g, np.zeros(len(v)), []
                n = np.linalg.norm(v) * np.linalg.norm(total)
                nov.append(1.0 - float(v @ total) / n if n > 0 else 1.0)
                total = total + v
            yield pd.DataFrame(out, columns=cols)
        if nov:
            yield pd.DataFrame([close(now, nov)], columns=cols)

    cols = [group, "n", "decay", "last_novelty", "half_life"]
    schema = f"{group} {dict(df.dtypes)[group]}, n long, decay double, last_novelty double, half_life double"
    return df.select(group, *[c for c in order if c not in (group, vector)], vector).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def blended_vectors(rows: DataFrame, doc: str, part: str, vector: str, dim: int, flag: Column, title_weight: float = 0.3) -> DataFrame:
    """(doc, vector): title_weight * title (part 0) + rest * mean of the flagged rows; what is missing gives way, all rows if both are."""
    title = F.array(*[F.max(F.when(F.col(part) == 0, F.get(vector, F.lit(i)).cast("double"))) for i in range(dim)])
    hit = flag & (F.col(part) != 0)
    body = F.array(*[F.avg(F.when(hit, F.get(vector, F.lit(i)).cast("double"))) for i in range(dim)])
    agg = rows.groupBy(doc).agg(title.alias("_t"), body.alias("_b"), mean_vector(vector, dim).alias("_a"), F.max((F.col(part) == 0).cast("int")).alias("_ht"), F.max(hit.cast("int")).alias("_hb"))
    mixed = F.zip_with("_t", "_b", lambda t, b: title_weight * t + (1 - title_weight) * b)
    return agg.select(doc, F.when((F.col("_ht") == 1) & (F.col("_hb") == 1), mixed).when(F.col("_hb") == 1, F.col("_b")).when(F.col("_ht") == 1, F.col("_t")).otherwise(F.col("_a")).alias(vector))



def profile_correlations(rows: DataFrame, groups: Sequence[str], actor: str, item: str, items: Sequence, tenths: int = 7) -> DataFrame:
    """(groups, actors, pairs): actors with a varied profile of counts over ``items``, and pairs of them whose profiles correlate by ``tenths`` / 10 or more.

    Actors of one profile count together: distinct profiles are compared, as arrays of
    whole numbers, so that a correlation right at the threshold is decided exactly, and
    no number of actors is ever gathered.
    """
    k = len(items)
    counts = rows.groupBy(*groups, actor).agg(F.array(*[F.count(F.when(F.col(item) == F.lit(i), 1)) for i in items]).alias("_v"))
    prof = counts.groupBy(*groups, "_v").agg(F.count("*").alias("_n"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    inner = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    prof = prof.withColumn("_t", total("_v")).withColumn("_q", k * inner("_v", "_v") - F.col("_t") * F.col("_t")).where("_q > 0")
    from ..functions.staging import stage

    prof = stage(prof, "profiles")
    other = prof.select(*groups, *[F.col(c).alias(f"{c}2") for c in ("_v", "_n", "_t", "_q")])
    cov = k * inner("_v", "_v2") - F.col("_t") * F.col("_t2")
    alike = prof.join(other, list(groups)).withColumn("_c", cov).where((F.col("_c") > 0) & (100 * F.col("_c") * F.col("_c") >= tenths * tenths * F.col("_q") * F.col("_q2")))
    # ordered pairs of actors of two profiles, and of one; half of them all
    both = F.when(F.col("_v") == F.col("_v2"), F.col("_n") * (F.col("_n") - 1)).otherwise(F.col("_n") * F.col("_n2"))
    pairs = alike.groupBy(*groups).agg((F.sum(both) / 2).cast("long").alias("pairs"))
    return prof.groupBy(*groups).agg(F.sum("_n").alias("actors")).join(pairs, list(groups), "left").fillna(0, ["pairs"])


def convergence_metrics(rows: DataFrame, group: str, key: str, day: str, outlet: str, actor: str, vector: str, dim: int, threshold: float = 0.95) -> DataFrame:
    """Everything that says whether a group's rows come to say the same, one row a group:

    n, syndicated (rows that repeat an earlier one), syndication (their share), similarity
    (mean cosine of all pairs of the others), slope and r2 of its trend over five parts
    in time (0 below ten rows), alignment (of the outlets' means, two rows and more),
    decay and last_novelty, and coordination (of the actors' means over all rows).
    """
    from ..functions.staging import stage

    x = stage(rows.where(F.col(vector).isNotNull()).select(group, key, day, outlet, actor, vector).dropDuplicates([group, key]), "vectors")
    gone = near_duplicates(x, group, key, vector, threshold).where("NOT kept").select(group, key)
    keep = stage(x.join(gone, [group, key], "left_anti"), "kept-vectors")
    base = x.groupBy(group).agg(F.count("*").alias("n")).join(gone.groupBy(group).agg(F.count("*").alias("syndicated")), group, "left").fillna(0, ["syndicated"])
    sim = mean_pairwise(keep, [group], vector, dim).select(group, "similarity")
    trend = convergence_trend(keep, group, [day, key], vector, dim).select(group, "slope", "r2")
    means = lambda by, df, least: mean_pairwise(centroids(df, [group, by], vector, dim).where(F.col("n") >= least).drop("n"), [group], "centroid", dim)
    align = means(outlet, keep, 2).select(group, F.col("similarity").alias("alignment"))
    together = means(actor, x, 1).select(group, F.col("similarity").alias("coordination"))
    fresh = novelty(keep, group, [day, key], vector).select(group, "decay", "last_novelty")
    out = base.withColumn("syndication", F.col("syndicated") / F.col("n"))
    for part in (sim, trend, align, fresh, together):
        out = out.join(part, group, "left")
    return out.fillna(0.0, ["similarity", "slope", "r2", "alignment", "decay", "last_novelty", "coordination"])


def driver_alignment(links: DataFrame, sources: DataFrame, target: str, source: str, strength: str, vector: str, dim: int) -> DataFrame:
    """``links`` (target, source, strength, driver boolean) with the cosine of each source's vector and its target's drivers' mean, weighted by strength; null without drivers."""
    x = links.join(sources.select(source, unit(F.col(vector)).alias("_u")), source, "left")
    d = x.where(F.col("driver") & F.col("_u").isNotNull() & (F.col(strength) > 0))
    mean = d.groupBy(target).agg(mean_vector("_u", dim, F.col(strength)).alias("_m"))
    return x.join(mean, target, "left").withColumn("alignment", F.when(F.col("_m").isNotNull() & F.col("_u").isNotNull(), cosine(F.col("_u"), F.col("_m")))).drop("_u", "_m")
