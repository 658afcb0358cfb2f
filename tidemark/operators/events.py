"""Events: rows of a type gathered into occurrences, soft membership, attribution to bursts, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cluster
from .ranks import quantile, weighted_percentile
from .relational import small


def seeds(rows: DataFrame, kind: str, weight: str, overall: str, share: float = 0.5, percentile: float = 0.5) -> DataFrame:
    """Rows whose weight is half their type's largest and whose blended score reaches the type's median."""
    score = 0.6 * F.col(weight) + 0.4 * F.col(overall)
    x = rows.where(F.col(weight) > 0).withColumn("score", score)
    top = x.groupBy(kind).agg(F.max(weight).alias("_m"))
    x = x.join(top, kind).where(F.col(weight) >= share * F.col("_m"))
    mid = quantile(x, [kind], "score", percentile).select(kind, F.greatest("quantile", F.lit(1e-6)).alias("_t"))
    return x.join(mid, kind).where(F.col("score") >= F.col("_t")).drop("_m", "_t")


def distance(vectors: np.ndarray, days: np.ndarray, entities: list[set], base: float = 0.0, half: float = 14.0) -> np.ndarray:
    """0.5 of residual cosine, 0.3 of time, 0.2 of entities (neutral where both have none)."""
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)
    sem = 1 - np.clip((u @ u.T - base) / (1 - base), 0, 1)
    tim = 1 - np.exp(-np.abs(days[:, None] - days[None, :]) / half)
    ent = np.full(sem.shape, 0.5)
    if any(entities):
        words = {e: i for i, e in enumerate(sorted(set().union(*entities)))}
        m = np.zeros((len(entities), len(words)))
        for i, s in enumerate(entities):
            m[i, [words[e] for e in s]] = 1
        inter = m @ m.T
        union = m.sum(1)[:, None] + m.sum(1)[None, :] - inter
        ent = np.where(union > 0, 1 - np.divide(inter, union, out=np.zeros_like(inter), where=union > 0), 0.5)
    d = 0.5 * sem + 0.3 * tim + 0.2 * ent
    np.fill_diagonal(d, 0)
    return d


def _distances_of(u: np.ndarray, days: np.ndarray, entities: list[set], base: float, half: float = 14.0) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of ``distance``, when asked for."""
    words = {e: i for i, e in enumerate(sorted(set().union(*entities)))}
    has = np.array([len(s) for s in entities], float)
    holders: list[list[int]] = [[] for _ in words]
    for i, s in enumerate(entities):
        for e in s:
            holders[words[e]].append(i)

    def rows(at: np.ndarray) -> np.ndarray:
        d = 0.5 * (1 - np.clip((u[at] @ u.T - base) / (1 - base), 0, 1)) + 0.3 * (1 - np.exp(-np.abs(days[at][:, None] - days[None, :]) / half))
        if words:
            inter = np.zeros(d.shape)
            for i, a in enumerate(at):
                for e in entities[a]:
                    inter[i, holders[words[e]]] += 1
            union = has[at][:, None] + has[None, :] - inter
            d += 0.2 * np.where(union > 0, 1 - np.divide(inter, union, out=np.zeros_like(inter), where=union > 0), 0.5)
        else:
            d += 0.1
        d[np.arange(len(at)), at] = 0
        return d

    return rows


def cluster_seeds(seed: DataFrame, kind: str, key: str, day: str, vector: str, entities: str | None = None, cut: float = 0.30, base: float = 0.0, most: int = 100_000) -> DataFrame:
    """(kind, key, occurrence): average-linkage clusters of each type's seeds, cut at a distance; singletons stay.

    A type is one task, whose time grows as the square of its seeds and whose memory as
    their number; more than ``most`` seeds of a type are refused rather than dropped.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{len(pdf)} seeds of a type: raise the seed percentile or give finer types")
        pdf = pdf.sort_values([day, key]).reset_index(drop=True)
        sets = [set(x) for x in pdf[entities]] if entities else [set()] * len(pdf)
        u, days = _units(np.stack(pdf[vector].to_numpy()).astype(float)), pd.to_datetime(pdf[day]).map(pd.Timestamp.toordinal).to_numpy(float)
        label = cluster.average_cut(_distances_of(u, days, sets, base), len(pdf), cut)
        return pd.DataFrame({kind: pdf[kind], key: pdf[key], "occurrence": [f"{k}:{c}" for k, c in zip(pdf[kind], label)]})

    types = dict(seed.dtypes)
    cols = [kind, key, day, vector, *([entities] if entities else [])]
    return seed.select(*cols).groupBy(kind).applyInPandas(run, f"{kind} {types[kind]}, {key} {types[key]}, occurrence string")


def occurrences(members: DataFrame, rows: DataFrame, kind: str, key: str, day: str, weight: str) -> DataFrame:
    """One row an occurrence: size, mass, first, median and last day (weighted 10th, 50th, 90th percentile), confidence."""
    x = members.join(rows.select(key, day, weight), key).withColumn("_x", F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double"))
    base = x.groupBy("occurrence", kind).agg(F.count("*").alias("seeds"), F.sum(weight).alias("mass"), F.avg(weight).alias("intensity"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    for p, name in ((0.1, "core_start"), (0.5, "peak"), (0.9, "core_end")):
        q = weighted_percentile(x, ["occurrence"], "_x", weight, p).select("occurrence", F.date_add(F.lit("1970-01-01").cast("date"), F.round("percentile").cast("int")).alias(name))
        base = base.join(q, "occurrence", "left")
    one = F.lit(1.0)
    span = F.datediff("core_end", "core_start")
    conf = 0.2 * F.least(one, F.log2(1 + F.col("mass")) / 5) + 0.2 * F.least(one, F.col("seeds") / 5) + 0.2 * F.least(one, F.col("intensity")) + 0.2 * F.exp(-span / 30) + 0.2 * F.when(F.col("seeds") > 1, 1.0).otherwise(0.5)
    return base.withColumn("confidence", conf)


def soft_assign(rows: DataFrame, centres: DataFrame, kind: str, key: str, day: str, vector: str, weight: str, tau: float = 0.5, most: int = 50_000) -> DataFrame:
    """(key, occurrence, belonging): how far each row belongs to each occurrence of its type; only what is above zero.

    Distance: 0.30 time, 0.45 cosine, 0.25 the row's own weight.  Centres (occurrence,
    kind, peak, centroid) are broadcast after a check of their number; beyond ``most``
    they are so in blocks, one after another.
    """
    n = centres.limit(most + 1).count()
    if n > most:
        from ..functions.staging import stage

        held = stage(centres.select("occurrence", kind, "peak", "centroid"), "centres")
        blocks = -(-2 * held.count() // max(1, most))  # by hash, so half full on average
        mine, out = stage(rows.select(kind, key, day, vector, weight), "assign-rows"), None
        for k in range(blocks):
            block = held.where(F.pmod(F.xxhash64("occurrence"), F.lit(blocks)) == k)
            got = stage(_assign(mine, block, kind, key, day, vector, weight, tau), "assigned")
            out = got if out is None else out.unionByName(got)
        return out
    return _assign(rows, centres, kind, key, day, vector, weight, tau)


def _assign(rows: DataFrame, centres: DataFrame, kind: str, key: str, day: str, vector: str, weight: str, tau: float) -> DataFrame:
    """Each row against all centres of its type, which are broadcast."""
    near = distances(rows, centres, kind, key, day, vector, weight, tau, {"time": 0.30, "meaning": 0.45, "weight": 0.25})
    return near.select(key, "occurrence", (1 - F.col("d") / tau).alias("belonging"))


def distances(rows: DataFrame, centres: DataFrame, kind: str, key: str, day: str, vector: str, weight: str, most: float, share: dict[str, float], entities: str | None = None) -> DataFrame:
    """(key, occurrence, d) of each row and centre of its type at a distance below ``most``.

    ``share`` weighs time, meaning, the row's own weight and, with ``entities`` (columns of
    rows and centres), Jaccard distance of entities, which is neutral where both have none.
    """
    cols = ["occurrence", kind, "peak", "centroid", *([entities] if entities else [])]
    local = centres.select(*cols).toPandas()
    c = {k: (g["occurrence"].tolist(), pd.to_datetime(g["peak"]).map(pd.Timestamp.toordinal).to_numpy(float), _units(np.stack(g["centroid"].to_numpy()).astype(float)), [frozenset(x if x is not None else ()) for x in g[entities]] if entities else None) for k, g in local.groupby(kind)}
    held = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for pdf in batches:
            out = []
            for k, g in pdf.groupby(kind):
                if k not in held.value:
                    continue
                names, peaks, u, sets = held.value[k]
                t = pd.to_datetime(g[day]).map(pd.Timestamp.toordinal).to_numpy(float)
                d = share["time"] * (1 - np.exp(-np.abs(t[:, None] - peaks[None, :]) / 14)) + share["meaning"] * (1 - np.maximum(0, _units(np.stack(g[vector].to_numpy()).astype(float)) @ u.T)) + share["weight"] * (1 - np.minimum(1, g[weight].to_numpy(float)))[:, None]
                if entities:
                    mine = [frozenset(x if x is not None else ()) for x in g[entities]]
                    d += share["entities"] * np.array([[1 - len(a & b) / len(a | b) if a or b else 0.5 for b in sets] for a in mine])
                i, j = np.nonzero(d < most)
                keys = g[key].to_numpy()
                out += [(keys[a], names[b], float(d[a, b])) for a, b in zip(i, j)]
            yield pd.DataFrame(out, columns=[key, "occurrence", "d"])

    return rows.select(kind, key, day, vector, weight, *([entities] if entities else [])).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, occurrence string, d double")


def assign_twice(rows: DataFrame, seeds: DataFrame, centres: DataFrame, kind: str, key: str, day: str, vector: str, weight: str, dim: int, entities: str | None = None, rounds: int = 2, least: float = 0.05, most: float = 0.50) -> tuple[DataFrame, DataFrame]:
    """((key, occurrence, belonging), centres): soft membership with a threshold for each occurrence, in two rounds.

    Distance: 0.25 time, 0.35 meaning, 0.25 weight, 0.15 entities (a constant half without).
    The first threshold is twice the median distance of the seeds (twice the largest of
    fewer than three), the second twice the median of the rows whose belonging is in the
    top quarter; both within ``least`` and ``most``.  Between them centres move to the mean
    of their rows, by belonging and weight.  Seeds always belong, if only by 0.
    """
    from ..functions.staging import stage
    from .vectors import mean_vector

    share = {"time": 0.25, "meaning": 0.35, "weight": 0.25, "entities": 0.15}
    now, held = centres, None
    for k in range(rounds):
        reach = most if entities else most - 0.075
        d = distances(rows, now, kind, key, day, vector, weight, reach, share, entities)
        d = stage(d if entities else d.withColumn("d", F.col("d") + 0.075), "distances")
        if held is None:
            at = d.join(seeds.select(key, "occurrence"), [key, "occurrence"]).groupBy("occurrence").agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("mid"), F.max("d").alias("far"))
            tau = at.select("occurrence", (2 * F.when(F.col("n") >= 3, F.col("mid")).otherwise(F.col("far"))).alias("tau"))
        else:
            high = held.where("belonging > 0").groupBy("occurrence").agg(F.percentile("belonging", F.lit(0.75)).alias("p75"))
            top = held.join(high, "occurrence").where(F.col("belonging") >= F.col("p75")).select(key, "occurrence")
            tau = d.join(top, [key, "occurrence"]).groupBy("occurrence").agg((2 * F.percentile("d", F.lit(0.5))).alias("tau"))
        tau = now.select("occurrence").join(tau, "occurrence", "left").select("occurrence", F.least(F.greatest(F.coalesce("tau", F.lit(most)), F.lit(least)), F.lit(most)).alias("tau"))
        near = d.join(tau, "occurrence").select(key, "occurrence", (1 - F.col("d") / F.col("tau")).alias("belonging")).where("belonging > 0")
        kept = seeds.select(key, "occurrence").distinct().withColumn("belonging", F.lit(0.0))
        held = stage(near.unionByName(kept).groupBy(key, "occurrence").agg(F.max("belonging").alias("belonging")), "belonging")
        if k + 1 < rounds:
            w = F.col("belonging") * F.greatest(F.col(weight), F.lit(0.01))
            v = rows.select(kind, key, vector, weight).join(now.select("occurrence", kind), kind).join(held.where("belonging > 0"), [key, "occurrence"])
            moved = v.groupBy("occurrence").agg(mean_vector(vector, dim, w).alias("_c"))
            now = stage(now.join(moved, "occurrence", "left").withColumn("centroid", F.coalesce("_c", F.col("centroid").cast("array<double>"))).drop("_c"), "centres")
    return held, now


def merge_types(members: DataFrame, clusters: DataFrame, occurrence: DataFrame, key: str) -> DataFrame:
    """(kind, key, occurrence): seeds once events of several types are merged into one occurrence of their heaviest type.

    Events of one type keep the occurrences that they consist of.
    """
    x = clusters.join(occurrence.select("occurrence", "kind", "mass"), "occurrence")
    by = x.groupBy("cluster", "kind").agg(F.sum("mass").alias("mass"))
    lead = by.groupBy("cluster").agg(F.count("*").alias("kinds"), F.max_by("kind", F.struct("mass", "kind")).alias("lead"))
    many = lead.where("kinds > 1").select("cluster", "lead")
    to = clusters.join(many, "cluster", "left").select("occurrence", F.when(F.col("lead").isNotNull(), F.concat(F.lit("event "), F.col("cluster").cast("string"))).otherwise(F.col("occurrence")).alias("_to"), "lead")
    return members.join(to, "occurrence", "left").select(F.coalesce("lead", "kind").alias("kind"), key, F.coalesce("_to", "occurrence").alias("occurrence")).distinct()


def retype(belonging: DataFrame, scores: DataFrame, occurrence: DataFrame, key: str, titles: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(occurrence, kind, type_score, best, best_score, type_confidence, retyped): does an occurrence's type fit its rows?

    ``scores`` (key, kind, value) are the rows' values for each type; a type's score is
    half the mean by belonging, over that of the best type, and half the likeness of
    ``titles`` (occurrence, kind, similarity).  Below ``least`` of the best score the best
    type takes over (of equal ones the first by name).
    """
    v = belonging.where("belonging > 0").join(scores, key).groupBy("occurrence", F.col("kind").alias("_k")).agg(F.sum(F.col("belonging") * F.col("value")).alias("_v"))
    total = belonging.where("belonging > 0").groupBy("occurrence").agg(F.sum("belonging").alias("_b"))
    kinds = scores.select(F.col("kind").alias("_k")).distinct()
    x = occurrence.select("occurrence", "kind").crossJoin(F.broadcast(kinds)).join(v, ["occurrence", "_k"], "left").join(total, "occurrence", "left")  # the closed list of types
    mean = F.coalesce(F.col("_v") / F.col("_b"), F.lit(0.0))
    top = F.max(mean).over(Window.partitionBy("occurrence"))
    x = x.withColumn("_n", F.when(top > 0, mean / top).otherwise(0.0))
    if titles is not None:
        x = x.join(titles.select("occurrence", F.col("kind").alias("_k"), "similarity"), ["occurrence", "_k"], "left")
        x = x.withColumn("_s", 0.5 * F.col("_n") + 0.5 * F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)))
    else:
        x = x.withColumn("_s", 0.5 * F.col("_n"))
    best = x.groupBy("occurrence", "kind").agg(F.max(F.when(F.col("kind") == F.col("_k"), F.col("_s"))).alias("type_score"), F.max("_s").alias("best_score"), F.min_by("_k", F.struct((-F.col("_s")).alias("s"), "_k")).alias("best")).fillna(0.0, ["type_score"])
    bad = (F.col("best_score") > 0) & (F.col("type_score") < least * F.col("best_score"))
    conf = F.when(bad, 1.0).when(F.col("best_score") > 0, F.col("type_score") / F.col("best_score")).otherwise(1.0)
    return best.select("occurrence", F.when(bad, F.col("best")).otherwise(F.col("kind")).alias("kind"), "type_score", "best", "best_score", conf.alias("type_confidence"), bad.alias("retyped"))


def remap(clusters: DataFrame, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(occurrence, cluster): events by the final occurrences, found by type and set of seeds; those without one go."""
    sign = lambda m, name: m.select("occurrence", "kind", key).distinct().groupBy("occurrence", "kind").agg(F.array_sort(F.collect_list(key)).alias("_s")).withColumnRenamed("occurrence", name)
    x = clusters.join(sign(old, "_old"), F.col("occurrence") == F.col("_old")).drop("occurrence", "_old")
    got = x.join(sign(new, "_new"), ["kind", "_s"]).select(F.col("_new").alias("occurrence"), "cluster").distinct()
    rank = got.groupBy("cluster").agg(F.min("occurrence").alias("_f"))
    return got.join(rank, "cluster").select("occurrence", F.sha2(F.concat_ws("|", F.col("cluster").cast("string"), "_f"), 256).substr(1, 12).alias("cluster"))


def type_ranking(clusters: DataFrame, occurrence: DataFrame) -> DataFrame:
    """(cluster, kind, mass, place): types of an event by the mass of their occurrences."""
    m = clusters.join(occurrence.select("occurrence", "kind", "mass"), "occurrence").groupBy("cluster", "kind").agg(F.sum("mass").alias("mass"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mass"), "kind")))


def occurrence_strength(occurrence: DataFrame, belonging: DataFrame, rows: DataFrame, key: str, outlet: str, tones: Sequence[str]) -> DataFrame:
    """(occurrence, outlets, temporal_intensity, emotional_intensity, tone_coherence), ``tones`` being positive, neutral and negative.

    Intensity: mass a day of the core, and mean |positive - negative| by belonging;
    coherence: one less the entropy of tones over log2 3.
    """
    x = belonging.join(rows.select(key, outlet, *tones), key)
    b = F.when(F.col("belonging") > 0, F.col("belonging"))
    t = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in tones]
    a = x.groupBy("occurrence").agg(F.count_distinct(outlet).alias("outlets"), F.sum(b).alias("_b"), F.sum(b * F.abs(t[0] - t[2])).alias("_e"), *[F.sum(b * c).alias(f"_t{i}") for i, c in enumerate(t)])
    total = sum((F.col(f"_t{i}") for i in range(1, len(tones))), F.col("_t0"))
    parts = [F.when((total > 0) & (F.col(f"_t{i}") > 0), -F.col(f"_t{i}") / total * F.log2(F.col(f"_t{i}") / total)).otherwise(0.0) for i in range(len(tones))]
    h = sum(parts[1:], parts[0])
    days = F.greatest(F.datediff("core_end", "core_start"), F.lit(1))
    y = occurrence.join(a, "occurrence", "left")
    return y.select("occurrence", F.coalesce("outlets", F.lit(0)).alias("outlets"), (F.col("mass") / days).alias("temporal_intensity"), F.when(F.col("_b") > 0, F.col("_e") / F.col("_b")).otherwise(0.0).alias("emotional_intensity"), F.when(F.col("_b") > 0, 1 - h / math.log2(3)).otherwise(0.0).alias("tone_coherence"))


def occurrence_entities(belonging: DataFrame, entities: DataFrame, key: str, entity: str, least: int = 3) -> DataFrame:
    """(occurrence, entity, n): entities that ``least`` or more of an occurrence's rows mention."""
    x = belonging.select(key, "occurrence").distinct().join(entities.select(key, entity).distinct(), key)
    return x.groupBy("occurrence", entity).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def occurrence_confidence(occurrence: DataFrame, belonging: DataFrame, seeds: DataFrame, rows: DataFrame, key: str, outlet: str, coherence: DataFrame | None = None, baseline: float = 0.0, low: float = 0.40) -> DataFrame:
    """(occurrence, tightness, coherence, diversity, recruitment, size, confidence, low_confidence): five parts, a fifth each.

    tightness: mean belonging; coherence: likeness (occurrence, similarity) beyond the
    corpus ``baseline``; diversity: 1 - 1 / outlets; recruitment: rows over seeds, less one,
    by two; size: mass by ten.  All from 0 to 1.
    """
    one = F.lit(1.0)
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), one)
    b = belonging.join(rows.select(key, outlet), key).join(seeds.select(key, "occurrence").distinct().withColumn("_s", F.lit(1)), [key, "occurrence"], "left")
    a = b.groupBy("occurrence").agg(F.avg("belonging").alias("tightness"), F.count_distinct(outlet).alias("_m"), F.count("*").alias("_n"), F.count("_s").alias("_s"), F.sum("belonging").alias("_mass"))
    x = occurrence.select("occurrence").join(a, "occurrence")
    x = x.join(coherence.select("occurrence", "similarity"), "occurrence", "left") if coherence is not None else x.withColumn("similarity", F.lit(0.0))
    parts = {"coherence": unit((F.coalesce("similarity", F.lit(0.0)) - baseline) / (1 - baseline)), "diversity": 1 - 1 / F.greatest("_m", F.lit(1)), "recruitment": unit((F.col("_n") / F.greatest("_s", F.lit(1)) - 1) / 2), "size": F.least(one, F.col("_mass") / 10)}
    x = x.withColumns(parts)
    x = x.withColumn("confidence", 0.2 * (F.col("tightness") + F.col("coherence") + F.col("diversity") + F.col("recruitment") + F.col("size")))
    return x.select("occurrence", "tightness", *parts, "confidence", (F.col("confidence") < low).alias("low_confidence"))


def ranked_types(members: DataFrame, clusters: DataFrame, occurrence: DataFrame, key: str, scores: DataFrame | None = None) -> DataFrame:
    """(cluster, kind, connectivity, role, score, place): types of an event, half by structure and half by ``scores`` (occurrence, kind, score).

    structure: 0.6 of the share of mass and 0.4 of the mean Jaccard overlap of rows with the
    event's other types (1 for a single type); both halves are over their best.  A type
    without overlap, among several, is a satellite.  Overlaps come from a join on rows.
    """
    m = clusters.join(occurrence.select("occurrence", "kind", "mass"), "occurrence")
    mass = m.groupBy("cluster", "kind").agg(F.sum("mass").alias("_mass"))
    mass = mass.withColumns({"_share": F.col("_mass") / F.sum("_mass").over(Window.partitionBy("cluster")), "_k": F.count("*").over(Window.partitionBy("cluster"))})
    held = clusters.join(members.select("occurrence", "kind", key), "occurrence").select("cluster", "kind", key).distinct()
    n = held.groupBy("cluster", "kind").agg(F.count("*").alias("_n"))
    both = held.withColumnRenamed("kind", "k1").join(held.withColumnRenamed("kind", "k2"), ["cluster", key]).where("k1 <> k2").groupBy("cluster", "k1", "k2").agg(F.count("*").alias("_c"))
    j = both.join(n.select("cluster", F.col("kind").alias("k1"), F.col("_n").alias("_n1")), ["cluster", "k1"]).join(n.select("cluster", F.col("kind").alias("k2"), F.col("_n").alias("_n2")), ["cluster", "k2"])
    links = j.groupBy("cluster", F.col("k1").alias("kind")).agg(F.sum(F.col("_c") / (F.col("_n1") + F.col("_n2") - F.col("_c"))).alias("_j"))
    x = mass.join(links, ["cluster", "kind"], "left").withColumn("connectivity", F.when(F.col("_k") > 1, F.coalesce("_j", F.lit(0.0)) / (F.col("_k") - 1)).otherwise(1.0))
    x = x.withColumn("_s", 0.6 * F.col("_share") + 0.4 * F.col("connectivity"))
    best = lambda c: F.max(c).over(Window.partitionBy("cluster"))
    over = lambda c: F.when(best(c) > 0, F.col(c) / best(c)).otherwise(0.0)
    if scores is not None:
        total = m.groupBy("cluster").agg(F.sum("mass").alias("_all"))
        by = clusters.join(occurrence.select("occurrence", "mass"), "occurrence").join(scores.select("occurrence", "kind", "score"), "occurrence").groupBy("cluster", "kind").agg(F.sum(F.col("mass") * F.col("score")).alias("_w")).join(total, "cluster").select("cluster", "kind", (F.col("_w") / F.col("_all")).alias("_l"))
        x = x.join(by, ["cluster", "kind"], "full")
    else:
        x = x.withColumn("_l", F.lit(0.0))
    x = x.fillna(0.0, ["_s", "_l", "connectivity"]).withColumn("score", 0.5 * over("_s") + 0.5 * over("_l")).where("score > 0")
    role = F.when(F.col("_k").isNull(), "absent").when((F.col("_k") == 1) | (F.col("connectivity") > 0), "constitutive").otherwise("satellite")
    return x.select("cluster", "kind", "connectivity", role.alias("role"), "score", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 12)), "kind")).alias("place"))


def burst_metrics(links: DataFrame, occurrence: DataFrame, burst: str = "burst_id", low: float = 0.40) -> DataFrame:
    """One row a burst over its occurrences: number, types, mean confidence, how many are below ``low``, mean and total mass, and temporal_overlap.

    temporal_overlap is the share of pairs whose cores meet.  Pairs aren't formed: two cores
    don't meet if one begins after the other ends, so for each end the later starts are counted.
    """
    x = links.select(burst, "occurrence").distinct().join(occurrence, "occurrence")
    base = x.groupBy(burst).agg(F.count("*").alias("n_occurrences"), F.count_distinct("kind").alias("n_types"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") < low).alias("n_low_confidence"), F.avg("mass").alias("mean_mass"), F.sum("mass").alias("total_mass"))
    marks = x.select(burst, F.explode(F.array(F.struct(F.col("core_start").alias("day"), F.lit(0).alias("is_end")), F.struct(F.col("core_end").alias("day"), F.lit(1).alias("is_end")))).alias("m")).select(burst, "m.*")
    # starts before an end or on its day come first
    seen = F.sum(1 - F.col("is_end")).over(Window.partitionBy(burst).orderBy("day", "is_end").rowsBetween(Window.unboundedPreceding, 0))
    apart = marks.withColumn("_seen", seen).withColumn("_all", F.sum(1 - F.col("is_end")).over(Window.partitionBy(burst))).where("is_end = 1").groupBy(burst).agg(F.sum(F.col("_all") - F.col("_seen")).alias("_apart"))
    n = F.col("n_occurrences")
    return base.join(apart, burst).withColumn("temporal_overlap", F.when(n > 1, 1 - F.col("_apart") / (n * (n - 1) / 2)).otherwise(0.0)).drop("_apart")


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def attribute(occurrence: DataFrame, belonging: DataFrame, bursts: DataFrame, rows: DataFrame, key: str, day: str) -> DataFrame:
    """(occurrence, burst_id, days, shared): occurrences whose core overlaps a burst and that share rows with it.

    Membership is joined to the bursts' days by equality; overlap is computed on what matches.
    A one-day overlap counts as none.
    """
    days = small(bursts.select("burst_id", "onset", "end")).withColumn(day, F.explode(F.sequence("onset", "end")))
    inside = rows.select(key, day).join(days, day)
    x = inside.join(belonging, key).join(occurrence.select("occurrence", "core_start", "core_end"), "occurrence")
    overlap = F.datediff(F.least("end", "core_end"), F.greatest("onset", "core_start"))
    return x.withColumn("days", overlap).where("days > 0").groupBy("occurrence", "burst_id").agg(F.first("days").alias("days"), F.count_distinct(key).alias("shared"), F.sum("belonging").alias("mass"))


def strength(mass: Column, coverage: Column, intensity: Column, coherence: Column, diversity: Column) -> Column:
    one = F.lit(1.0)
    return 0.20 * F.least(one, F.log2(1 + mass) / math.log2(101)) + 0.25 * coverage + 0.20 * F.least(one, F.log2(1 + intensity) / math.log2(51)) + 0.15 * coherence + 0.20 * diversity


def overlaps(held: DataFrame, name: str, item: str) -> DataFrame:
    """(a, b, c, na, nb): how many items two holders share, and how many each has; joined on the items."""
    h = held.select(name, item).distinct()
    n = h.groupBy(name).agg(F.count("*").alias("_n"))
    both = h.withColumnRenamed(name, "a").join(h.withColumnRenamed(name, "b"), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    return both.join(n.select(F.col(name).alias("a"), F.col("_n").alias("na")), "a").join(n.select(F.col(name).alias("b"), F.col("_n").alias("nb")), "b")


def group_occurrences(occurrence: DataFrame, members: DataFrame, centres: DataFrame, key: str, entities: DataFrame | None = None, most: int = 5000) -> DataFrame:
    """(occurrence, cluster): occurrences of any type joined to events: time .25, meaning .20, entities .15, shared rows .30 and type .10; best silhouette, then refined.

    Shared rows and ``entities`` (occurrence, entity) are counted by joins; what is gathered
    is a row for each occurrence, whose number is checked, and for each pair that shares
    something.  Entities are neutral (a half) where neither has any.
    """
    o = occurrence.join(centres.select("occurrence", "centroid"), "occurrence")
    shared = overlaps(members, "occurrence", key).select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jac"), F.lit("rows").alias("what"))
    o = o.select("occurrence", "kind", "peak", "centroid", F.lit(False).alias("named")) if entities is None else o.join(entities.select("occurrence").distinct().withColumn("named", F.lit(True)), "occurrence", "left").select("occurrence", "kind", "peak", "centroid", F.coalesce("named", F.lit(False)).alias("named"))
    if entities is not None:
        shared = shared.unionByName(overlaps(entities, "occurrence", "entity").select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jac"), F.lit("entities").alias("what")))

    def run(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{len(pdf)} occurrences: raise the confidence limit")
        pdf = pdf.sort_values("occurrence").reset_index(drop=True)
        t = pd.to_datetime(pdf["peak"]).map(pd.Timestamp.toordinal).to_numpy(float)
        u = _units(np.stack(pdf["centroid"].to_numpy()).astype(float))
        place = {x: i for i, x in enumerate(pdf["occurrence"])}
        named = pdf["named"].to_numpy(bool)
        far = {"rows": np.ones((len(pdf), len(pdf))), "entities": np.where(named[:, None] | named[None, :], 1.0, 0.5)}
        for x, y, j, what in zip(links["a"], links["b"], links["jac"], links["what"]):
            if x in place and y in place:
                far[what][place[x], place[y]] = far[what][place[y], place[x]] = 1 - j
        same = np.array(pdf["kind"])[:, None] != np.array(pdf["kind"])[None, :]
        d = 0.25 * (1 - np.exp(-np.abs(t[:, None] - t[None, :]) / 14)) + 0.20 * (1 - np.clip(u @ u.T, 0, 1)) + 0.15 * far["entities"] + 0.30 * far["rows"] + 0.10 * same
        np.fill_diagonal(d, 0)
        label = cluster.refine(d, cluster.cluster_or_single(d))
        return pd.DataFrame({"occurrence": pdf["occurrence"], "cluster": label.astype(int)})

    one = F.lit(1).alias("_g")
    return o.select(one, "occurrence", "kind", "peak", "centroid", "named").groupBy("_g").cogroup(shared.select(one, "*").groupBy("_g")).applyInPandas(run, "occurrence string, cluster int")


def deduplicate(members: DataFrame, occurrence: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Occurrences of a type that share half of their rows with a heavier one that stays go.

    Overlaps come from a join on rows; the greedy pass then runs over the few overlapping
    pairs of a type.
    """
    m = members.select("occurrence", "kind", key).distinct()
    size = m.groupBy("occurrence").agg(F.count("*").alias("k"))
    both = m.withColumnRenamed("occurrence", "a").join(m.withColumnRenamed("occurrence", "b"), ["kind", key]).where("a < b").groupBy("kind", "a", "b").agg(F.count("*").alias("c"))
    x = both.join(size.select(F.col("occurrence").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("occurrence").alias("b"), F.col("k").alias("kb")), "b").where(F.col("c") / (F.col("ka") + F.col("kb") - F.col("c")) >= threshold)
    mass = occurrence.select("occurrence", "mass")
    x = x.join(mass.select(F.col("occurrence").alias("a"), F.col("mass").alias("ma")), "a").join(mass.select(F.col("occurrence").alias("b"), F.col("mass").alias("mb")), "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = {**dict(zip(pdf["a"], pdf["ma"])), **dict(zip(pdf["b"], pdf["mb"]))}
        near: dict[str, set] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        kept: set[str] = set()
        gone = []
        for o in sorted(weight, key=lambda o: (-weight[o], o)):
            if near[o] & kept:
                gone.append(o)
            else:
                kept.add(o)
        return pd.DataFrame({"occurrence": gone}, dtype=object)

    gone = x.select("kind", "a", "b", "ma", "mb").groupBy("kind").applyInPandas(run, "occurrence string")
    return occurrence.join(gone, "occurrence", "left_anti")


def regimes(daily: DataFrame, kind: str, day: str, value: str) -> DataFrame:
    """Days on which the leading type of the smoothed profile changes: (day, before, after)."""
    w3 = Window.partitionBy(kind).orderBy(day).rowsBetween(-1, 1)
    smooth = daily.withColumn("_v", F.avg(value).over(w3))
    lead = smooth.groupBy(day).agg(F.max_by(kind, F.struct("_v", kind)).alias("after"))
    x = lead.withColumn("before", F.lag("after").over(Window.orderBy(day)))  # one row a day
    return x.where("before <> after").select(day, "before", "after")


def split_disconnected(clusters: DataFrame, occurrence: DataFrame, members: DataFrame, centres: DataFrame, key: str, near: float = 0.5, gap_days: int = 30) -> DataFrame:
    """(occurrence, cluster): clusters split into parts that hang together, by shared rows, or by likeness within some days.

    Links are joined inside each cluster, and parts are the links' components.
    """
    from ..functions.exprs import cosine
    from .graph import components

    o = clusters.join(occurrence.select("occurrence", "peak"), "occurrence").join(centres.select("occurrence", "centroid"), "occurrence").withColumn("id", F.col("occurrence"))
    held = clusters.join(members.select("occurrence", key).distinct(), "occurrence").withColumn("id", F.col("occurrence")).select("cluster", key, "id")
    shared = held.withColumnRenamed("id", "src").join(held.withColumnRenamed("id", "dst"), ["cluster", key]).where("src < dst").select("src", "dst")
    a, b = o.select("cluster", F.col("id").alias("src"), F.col("peak").alias("p1"), F.col("centroid").alias("c1")), o.select("cluster", F.col("id").alias("dst"), F.col("peak").alias("p2"), F.col("centroid").alias("c2"))
    alike = a.join(b, "cluster").where((F.col("src") < F.col("dst")) & (F.abs(F.datediff("p1", "p2")) <= gap_days) & (cosine(F.col("c1"), F.col("c2")) >= near)).select("src", "dst")
    part = components(shared.unionByName(alike))
    x = o.join(part, F.col("id") == F.col("node"), "left").select("occurrence", "cluster", F.coalesce("component", "id").alias("part"))
    return x.select("occurrence", F.concat_ws("/", "cluster", F.dense_rank().over(Window.partitionBy("cluster").orderBy("part"))).alias("cluster"))


def contained(clusters: DataFrame, members: DataFrame, key: str, threshold: float = 0.70, peaks: DataFrame | None = None, gap_days: int = 14) -> DataFrame:
    """(small, large, share): clusters most of whose rows another, larger one holds; ties go to the smaller name.

    With ``peaks`` (cluster, kind, peak), clusters of different types count only if their
    peaks are ``gap_days`` apart at most.
    """
    m = clusters.join(members.select("occurrence", key).distinct(), "occurrence").select("cluster", key).distinct()
    size = m.groupBy("cluster").agg(F.count("*").alias("n"))
    both = m.withColumnRenamed("cluster", "a").join(m.withColumnRenamed("cluster", "b"), key).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c"))
    x = both.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a").cast("string") > F.col("b").cast("string")))
    if peaks is not None:
        p = peaks.select("cluster", "kind", "peak")
        x = x.join(p.toDF("a", "_k1", "_p1"), "a").join(p.toDF("b", "_k2", "_p2"), "b").where((F.col("_k1") == F.col("_k2")) | (F.abs(F.datediff("_p1", "_p2")) <= gap_days))
    return x.where(first & (F.col("c") / F.col("na") >= threshold)).select(F.col("a").alias("small"), F.col("b").alias("large"), (F.col("c") / F.col("na")).alias("share"))


def absorb(clusters: DataFrame, members: DataFrame, key: str, threshold: float = 0.70, rounds: int = 10_000) -> DataFrame:
    """(occurrence, cluster): contained clusters are absorbed by the largest that holds them, until none is."""
    from ..functions.staging import stage

    now = stage(clusters.select("occurrence", F.col("cluster").cast("string").alias("cluster")), "absorb")
    for _ in range(rounds):
        into = contained(now, members, key, threshold).groupBy("small").agg(F.max_by("large", F.struct("share", "large")).alias("large"))
        into = stage(into, "absorb-into")
        if into.isEmpty():
            break
        # a cluster that is absorbed itself in this round takes nothing in
        free = into.join(into.select(F.col("small").alias("large")), "large", "left_anti")
        x = now.join(free, F.col("cluster") == F.col("small"), "left")
        now = stage(x.select("occurrence", F.coalesce("large", "cluster").alias("cluster")), "absorb")
    else:
        raise RuntimeError(f"absorption did not settle in {rounds} rounds")
    return now


def type_structure(clusters: DataFrame, occurrence: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(cluster, kind, mass, links, role): types of an event; constitutive ones share rows with another type or lead in mass."""
    held = clusters.join(members.select("occurrence", "kind", key).distinct(), "occurrence").select("cluster", "kind", key).distinct()
    pairs = held.withColumnRenamed("kind", "k1").join(held.withColumnRenamed("kind", "k2"), ["cluster", key]).where("k1 <> k2").groupBy("cluster", F.col("k1").alias("kind")).agg(F.count_distinct("k2").alias("links"))
    mass = clusters.join(occurrence.select("occurrence", "kind", "mass"), "occurrence").groupBy("cluster", "kind").agg(F.sum("mass").alias("mass"))
    top = F.max("mass").over(Window.partitionBy("cluster"))
    x = mass.join(pairs, ["cluster", "kind"], "left").fillna(0, ["links"])
    return x.withColumn("role", F.when((F.col("links") > 0) | (F.col("mass") == top), "constitutive").otherwise("satellite"))


def summarise(clusters: DataFrame, occurrence: DataFrame, belonging: DataFrame, rows: DataFrame, key: str, outlet_count: int) -> DataFrame:
    """One row an event: occurrences, types, mass, core days (extremes of its occurrences), coverage, strength."""
    o = clusters.join(occurrence, "occurrence")
    base = o.groupBy("cluster").agg(F.count("*").alias("occurrences"), F.count_distinct("kind").alias("kinds"), F.sum("mass").alias("mass"), F.avg("intensity").alias("intensity"), F.avg("confidence").alias("confidence"), F.min("core_start").alias("core_start"), F.max("core_end").alias("core_end"), F.max_by("peak", "mass").alias("peak"))
    docs = clusters.join(belonging, "occurrence").groupBy("cluster").agg(F.count_distinct(key).alias("rows"), F.avg("belonging").alias("coherence"))
    x = base.join(docs, "cluster", "left").fillna(0, ["rows", "coherence"])
    total = rows.agg(F.count_distinct(key).alias("_t"))
    x = x.crossJoin(F.broadcast(total))  # one row
    return x.withColumn("strength", strength(F.col("mass"), F.col("rows") / F.greatest(F.col("_t"), F.lit(1)), F.col("intensity"), F.col("coherence"), F.least(F.lit(1.0), F.col("kinds") / outlet_count))).drop("_t")


def coherence_gate(clusters: DataFrame, members: DataFrame, rows: DataFrame, key: str, vector: str, diameter: float = 0.16, least: int = 4, most: int = 20_000) -> DataFrame:
    """(cluster, key, part): rows of an event shattered by meaning and regrouped by complete linkage up to a diameter.

    Events under ``least`` rows stay whole; one beyond ``most`` is refused.
    """
    x = clusters.join(members.select("occurrence", key).distinct(), "occurrence").select(F.col("cluster").cast("string").alias("cluster"), key).distinct().join(rows.select(key, vector).dropDuplicates([key]), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"an event has {len(pdf)} rows: split it first")
        pdf = pdf.sort_values(key).reset_index(drop=True)
        label = np.zeros(len(pdf), int)
        if len(pdf) >= least:
            u = _units(np.stack(pdf[vector].to_numpy()).astype(float))
            d = np.clip(1 - u @ u.T, 0, 2)
            np.fill_diagonal(d, 0)
            fine = cluster.refine(d, np.zeros(len(pdf), int))
            far = np.array([[d[np.ix_(fine == a, fine == b)].max() for b in range(fine.max() + 1)] for a in range(fine.max() + 1)])
            np.fill_diagonal(far, 0)
            label = cluster.cut(cluster.linkage(far, "complete"), len(far), height=diameter)[fine] if len(far) > 1 else fine
        return pd.DataFrame({"cluster": pdf["cluster"], key: pdf[key], "part": label.astype(int)})

    return x.groupBy("cluster").applyInPandas(run, f"cluster string, {key} {dict(rows.dtypes)[key]}, part int")
