"""Bursts of groups in daily series: segmentation, proportion tests, extension, false-discovery control, scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs, stats
from ..functions.exprs import clip


@dataclass(frozen=True)
class Settings:
    """Thresholds of the detector; the defaults are those in use."""

    penalty: float = 2.0
    least_days: int = 7
    smooth: int = 7
    lift: float = 0.3
    p: float = 0.01
    effect: float = 0.05
    ratio: float = 1.2
    q: float = 0.05
    shortest: int = 3
    reach: int = 7
    patience: int = 2
    sizes: tuple[int, ...] = (5, 7, 10, 14, 21, 28)


Span = tuple[int, int]


def merge(spans: list[Span], gap: int = 1) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Detector:
    """One group's series: counts n of totals, and a composite signal, a row a day."""

    def __init__(self, n: np.ndarray, total: np.ndarray, composite: np.ndarray, s: Settings = Settings()) -> None:
        self.n, self.total, self.z, self.s = n.astype(float), total.astype(float), composite.astype(float), s
        self.prop = np.divide(self.n, self.total, out=np.zeros(len(n)), where=self.total > 0)
        self.base = float(self.n.sum() / max(1.0, self.total.sum()))
        self.local = self._baselines()

    def _baselines(self, first: int = 97, last: int = 8, least: int = 45, least_total: int = 200) -> np.ndarray:
        """The last known pooled proportion of the days ``first`` to ``last`` ago; the run's before any is known."""
        cn, ct = np.concatenate([[0], np.cumsum(self.n)]), np.concatenate([[0], np.cumsum(self.total)])
        out, known = np.empty(len(self.n)), self.base
        for t in range(len(self.n)):
            a, b = max(0, t - first), max(0, t - last + 1)
            if b - a >= least and ct[b] - ct[a] >= least_total:
                known = max((cn[b] - cn[a]) / max(1.0, ct[b] - ct[a]), 1e-6)
            out[t] = known
        return out

    def test(self, span: Span, base: float | None = None) -> tuple[float, float, float]:
        """(p, h, ratio) of a span's pooled proportion against a baseline, by default that of its start."""
        a, b = span
        k, t = self.n[a : b + 1].sum(), self.total[a : b + 1].sum()
        base = self.local[a] if base is None else base
        if not t:
            return 1.0, 0.0, 0.0
        q, c = k / t, min(max(base, 1e-6), 1.0)
        return stats.binom_sf(int(k), int(t), c), 2 * math.asin(math.sqrt(q)) - 2 * math.asin(math.sqrt(c)), q / c

    def accept(self, span: Span) -> bool:
        p, h, r = self.test(span)
        return p < self.s.p and h > self.s.effect and r > self.s.ratio

    def segments(self, a: int, b: int, penalty: float, least: int, smooth: int, level: float) -> list[Span]:
        x = stats.centred_mean(self.z[a : b + 1], smooth)
        ends = stats.pelt(x, penalty, least)
        starts = [0, *ends[:-1]]
        return merge([(a + i, a + j - 1) for i, j in zip(starts, ends) if x[i:j].mean() > level])

    def by_segments(self) -> list[tuple[Span, str]]:
        level = float(self.z.mean() + self.s.lift * self.z.std())
        out: list[tuple[Span, str]] = []
        for a, b in self.segments(0, len(self.z) - 1, self.s.penalty, self.s.least_days, self.s.smooth, level):
            if self.accept((a, b)):
                out.append(((a, b), "pelt"))
            elif b - a + 1 >= 5:
                part = self.z[a : b + 1]
                inner = self.segments(a, b, 1.0, min(3, len(part) // 2), 3, float(part.mean()))
                out += [(x, "pelt_refined") for x in inner if self.accept(x)]
        return out

    def by_windows(self) -> list[tuple[Span, str]]:
        hits: list[Span] = []
        cn, ct = np.concatenate([[0], np.cumsum(self.n)]), np.concatenate([[0], np.cumsum(self.total)])
        for size in self.s.sizes:
            a = np.arange(max(0, len(self.n) - size + 1))
            k, t = cn[a + size] - cn[a], ct[a + size] - ct[a]
            over = np.flatnonzero((t > 0) & (k > self.local[a] * t) & (k > self.base * t))
            for i in over.tolist():
                p, h, r = self.test((i, i + size - 1), self.base)
                if p < self.s.p and (h > self.s.effect or r > self.s.ratio):
                    hits.append((i, i + size - 1))
        out = []
        for a, b in merge(hits, 0):
            if self.accept((a, b)):
                out.append(((a, b), "sliding_prop"))
            else:
                inside = [x for x in hits if a <= x[0] and x[1] <= b]
                out.append((max(inside, key=lambda x: (self.test(x, self.base)[1], -x[0])), "sliding_prop"))
        return out

    def extend(self, span: Span) -> Span:
        """Both ends moved out while the smoothed proportion is above the baseline, over a few lower days."""
        smooth = stats.centred_mean(self.prop, 5)

        def walk(at: int, step: int) -> int:
            best, low = at, 0
            for k in range(1, self.s.reach + 1):
                i = at + step * k
                if not 0 <= i < len(smooth):
                    break
                if smooth[i] > self.base:
                    best, low = i, 0
                else:
                    low += 1
                    if low > self.s.patience:
                        break
            return best

        return walk(span[0], -1), walk(span[1], 1)

    def bursts(self) -> list[dict]:
        found = self.by_segments() + self.by_windows()
        how = lambda span: "+".join(sorted({m for (a, b), m in found if a <= span[1] and span[0] <= b}))
        spans = [x for x in merge([x for x, _ in found]) if self.accept(x)]
        spans = [x for x in merge([self.extend(x) for x in spans]) if self.accept(x)]
        tests = [self.test(x) for x in spans]
        q = stats.benjamini_hochberg(np.array([t[0] for t in tests])) if tests else []
        out = []
        for (a, b), (p, h, r), qv in zip(spans, tests, q):
            if qv >= self.s.q or b - a + 1 < self.s.shortest:
                continue
            peak = a + int(np.argmax(self.z[a : b + 1]))
            before = self.prop[max(0, a - 90) : a]
            inside = self.prop[a : b + 1]
            mwu = stats.mann_whitney(inside, before)[1] if len(inside) >= 3 and len(before) >= 5 else 1.0
            out.append({"start": a, "peak": peak, "end": b, "days": b - a + 1, "articles": int(self.n[a : b + 1].sum()), "p": p, "q": float(qv), "effect": h, "ratio": r, "intensity": float(inside.mean() / self.base) if self.base else 0.0, "composite_peak": float(self.z[a : b + 1].max()), "mwu_p": mwu, "method": how((a, b))})
        return out


BURST = "burst_id string, {g} string, onset date, peak date, end date, days int, articles long, p double, q double, effect double, ratio double, intensity double, composite_peak double, mwu_p double, method string"


def detect_bursts(series: DataFrame, group: str, day: str, composite: str, settings: Settings = Settings()) -> DataFrame:
    """Validated bursts of each group of a dense daily series (n, total, composite), a task a group.

    A group's series has a row a day, whatever the number of rows it counts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        g, days = str(pdf[group].iloc[0]), pdf[day].tolist()
        rows = Detector(pdf["n"].to_numpy(), pdf["total"].to_numpy(), pdf[composite].to_numpy(), settings).bursts()
        return pd.DataFrame([(f"{g}:{days[r['start']]}", g, days[r["start"]], days[r["peak"]], days[r["end"]], r["days"], r["articles"], r["p"], r["q"], r["effect"], r["ratio"], r["intensity"], r["composite_peak"], r["mwu_p"], r["method"]) for r in rows], columns=["burst_id", group, "onset", "peak", "end", "days", "articles", "p", "q", "effect", "ratio", "intensity", "composite_peak", "mwu_p", "method"])

    return series.select(group, day, "n", "total", composite).groupBy(group).applyInPandas(run, BURST.format(g=group))


def stair(p: Column) -> Column:
    return F.when(p < 0.001, 1.0).when(p < 0.01, 0.5).when(p < 0.05, 0.25).otherwise(0.0)


def classify(score: Column) -> Column:
    return F.when(score >= 0.65, "strong").when(score >= 0.40, "moderate").when(score >= 0.25, "weak").otherwise("none")


def network_terms(inside: DataFrame, day: str, actor: str) -> DataFrame:
    """(burst_id, nodes, edges, density, modularity, clustering): each burst's network of actors with rows on one day, a task a burst that holds a row an actor and day."""
    rows = inside.select("burst_id", day, actor).where(F.col(actor).isNotNull()).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = graphs.Blocks(pdf[day].astype(str), pdf[actor])
        got = [(str(pdf["burst_id"].iloc[0]), *graphs.block_summary(g))] if g.n else []
        return pd.DataFrame(got, columns=["burst_id", "nodes", "edges", "density", "modularity", "clustering"])

    return rows.groupBy("burst_id").applyInPandas(run, "burst_id string, nodes long, edges long, density double, modularity double, clustering double")


def participation_terms(bursts: DataFrame, rows: DataFrame, group: str, day: str, actor: str, outlet: str, network: bool = True, outlets: int = 20) -> DataFrame:
    """One row a burst: counts, and the six terms of participation.

    diversity: entropy of the ten busiest actors; cross_media: outlets of ``outlets``;
    newcomers: share of actors without a row in the 90 days before; growth: share of days
    on which actors joined; structure: clustering over density, a twentieth of it (0.5
    below five nodes); cohesion: one less modularity.
    """
    key = ["burst_id"]
    days = bursts.select(*key, group, "onset", "end", F.explode(F.sequence("onset", "end")).alias(day))
    inside = rows.join(days, [group, day])
    base = inside.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(actor).alias("n_actors"), F.count_distinct(outlet).alias("n_outlets"))

    counts = inside.where(F.col(actor).isNotNull()).groupBy(*key, actor).agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), actor))).where("r <= 10")
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*key))
    diversity = top.withColumn("p", share).groupBy(*key).agg(F.when(F.count("*") > 1, -F.sum(F.col("p") * F.ln("p")) / F.ln(F.count("*").cast("double"))).otherwise(0.0).alias("diversity"))

    ahead = bursts.select(*key, group, F.explode(F.sequence(F.date_sub("onset", 90), F.date_sub("onset", 1))).alias(day))
    before = rows.join(ahead, [group, day]).select(*key, actor).distinct()
    fresh = inside.select(*key, actor).distinct().join(before, [*key, actor], "left_anti").groupBy(*key).agg(F.count(actor).alias("n_new"))

    first = inside.groupBy(*key, actor).agg(F.min(day).alias(day)).groupBy(*key, day).agg(F.count("*").alias("new"))
    w = Window.partitionBy(*key).orderBy(day)
    grown = days.select(*key, day).join(first, [*key, day], "left").fillna(0, ["new"]).withColumn("r", F.row_number().over(w))
    growth = grown.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("r") > 1, (F.col("new") > 0).cast("double"))), F.lit(0.0)).alias("growth"), (F.sum("new") / F.count("*")).alias("velocity"))

    x = bursts.select(*key).join(base, key, "left")
    for part in (diversity, fresh, growth):
        x = x.join(part, key, "left")
    x = x.fillna(0, ["n_rows", "n_actors", "n_outlets", "n_new", "diversity", "growth", "velocity"])
    x = x.withColumns({"cross_media": F.least(F.lit(1.0), F.col("n_outlets") / outlets), "newcomers": F.when(F.col("n_actors") > 0, F.col("n_new") / F.col("n_actors")).otherwise(0.0)})
    if network:
        x = x.join(network_terms(inside, day, actor), key, "left")
        nodes, density = F.coalesce("nodes", "n_actors"), F.coalesce("density", F.lit(0.0))
        structure = F.when((density > 0) & (nodes >= 5), F.least(F.lit(1.0), F.col("clustering") / density / 20)).when(nodes < 5, 0.5).otherwise(0.0)
        x = x.withColumns({"structure": structure, "cohesion": clip(1 - F.coalesce("modularity", F.lit(0.0)), 0, 1)}).drop("nodes", "density", "modularity", "clustering")
    return x


def source_terms(bursts: DataFrame, rows: DataFrame, group: str, day: str, source: str, kinds: int) -> DataFrame:
    """One row a burst: decline and concentration, from the entropy of sources over ``kinds`` kinds.

    Entropies are shares of ln ``kinds``, and 0.5 without a source.  decline: by how much
    it falls from the first half of the burst to the second, damped by log2 of the rows
    over log2 100; concentration: one less the entropy of all.
    """
    days = bursts.select("burst_id", group, "onset", "end", F.explode(F.sequence("onset", "end")).alias(day))
    inside = rows.join(days, [group, day]).withColumn("half", F.when(2 * F.datediff(day, "onset") <= F.datediff("end", "onset"), 1).otherwise(2))
    n = inside.groupBy("burst_id", "half", source).agg(F.count("*").alias("_n"))

    def entropy(counts: DataFrame, by: list[str], name: str) -> DataFrame:
        p = counts.where(F.col(source).isNotNull()).groupBy(*by, source).agg(F.sum("_n").alias("_n")).withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*by)))
        return p.groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p")) / math.log(max(2, kinds))).alias(name))

    size = n.groupBy("burst_id").agg(F.sum("_n").alias("_all"), F.count_if(F.col("half") == 1).alias("_one"), F.count_if(F.col("half") == 2).alias("_two"))
    halves = entropy(n, ["burst_id", "half"], "h").groupBy("burst_id").agg(F.max(F.when(F.col("half") == 1, F.col("h"))).alias("h1"), F.max(F.when(F.col("half") == 2, F.col("h"))).alias("h2"))
    x = size.join(halves, "burst_id", "left").join(entropy(n, ["burst_id"], "h"), "burst_id", "left")
    h1, h2 = F.coalesce("h1", F.lit(0.5)), F.coalesce("h2", F.lit(0.5))
    damp = clip(F.log2(F.col("_all").cast("double")) / math.log2(100), 0, 1)
    decline = F.when((F.col("_one") > 0) & (F.col("_two") > 0) & (h1 > 0), clip((h1 - h2) / h1 * damp, 0, 1)).otherwise(0.0)
    return x.select("burst_id", decline.alias("decline"), clip(1 - F.coalesce("h", F.lit(0.5)), 0, 1).alias("concentration"))


def outlet_likeness(bursts: DataFrame, rows: DataFrame, group: str, day: str, outlet: str, source: str) -> DataFrame:
    """(burst_id, alignment): mean cosine of the outlets' source shares, where rows have no vectors."""
    days = bursts.select("burst_id", group, F.explode(F.sequence("onset", "end")).alias(day))
    mix = rows.join(days, [group, day]).groupBy("burst_id", outlet, source).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("burst_id", outlet)))
    lengths = mix.groupBy("burst_id", outlet).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("l"))
    sums = mix.join(lengths, ["burst_id", outlet]).groupBy("burst_id", source).agg(F.sum(F.col("p") / F.col("l")).alias("_su"))
    k = lengths.groupBy("burst_id").agg(F.count("*").alias("k"))
    got = sums.groupBy("burst_id").agg(F.sum(F.col("_su") * F.col("_su")).alias("ss")).join(k, "burst_id")
    return got.select("burst_id", F.when(F.col("k") > 1, (F.col("ss") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("alignment"))


def score_bursts(bursts: DataFrame, rows: DataFrame, group: str, day: str, actor: str, outlet: str, source: str, key: str | None = None, vector: str | None = None, dim: int = 0, kinds: int | None = None) -> DataFrame:
    """Four dimensions and a total of each burst: temporal (4 terms), participation (6), convergence (4), source (3).

    Rows of the bursts' days are joined by exploded days.  With a ``vector`` (and its row
    ``key``) convergence has four terms: similarity less half of the syndication, trend,
    alignment of outlets and decay of novelty; source has the coordination of actors as
    its third.  Without vectors, convergence is the likeness of the outlets' sources.
    ``kinds`` is the number of kinds of sources, else those that occur.  A burst of fewer
    than three rows, or without actors, scores 0.
    """
    from ..functions.staging import stage
    from . import vectors as vec

    bursts = stage(bursts, "bursts-scored")
    kinds = kinds or rows.select(source).where(F.col(source).isNotNull()).distinct().count()
    one = F.lit(1.0)
    x = bursts.join(participation_terms(bursts, rows, group, day, actor, outlet), "burst_id", "left").join(source_terms(bursts, rows, group, day, source, kinds), "burst_id", "left").fillna(0.0, ["decline", "concentration"])
    if vector:
        days = bursts.select("burst_id", group, F.explode(F.sequence("onset", "end")).alias(day))
        inside = rows.join(days, [group, day])
        m = vec.convergence_metrics(inside, "burst_id", key, day, outlet, actor, vector, dim)
        m = m.select("burst_id", F.col("n").alias("_vectors"), "similarity", "syndication", "slope", F.col("alignment").alias("outlets_alike"), "decay", "coordination")
        x = x.join(m, "burst_id", "left").fillna(0.0, ["similarity", "syndication", "slope", "outlets_alike", "decay", "coordination"]).fillna(0, ["_vectors"])
        parts = (clip(F.col("similarity"), 0, 1) * (1 - 0.5 * F.col("syndication")) + clip((F.col("slope") + 0.05) / 0.10, 0, 1) + clip(F.col("outlets_alike"), 0, 1) + clip(F.col("decay") * F.col("n_rows") / 0.5, 0, 1)) / 4
        x = x.withColumn("convergence", F.when(F.col("_vectors") >= 2, parts).otherwise(0.0)).withColumn("coordination", clip(F.col("coordination"), 0, 1))
        source_score = (F.col("decline") + F.col("concentration") + F.col("coordination")) / 3
    else:
        x = x.join(outlet_likeness(bursts, rows, group, day, outlet, source), "burst_id", "left").withColumn("convergence", clip(F.coalesce("alignment", F.lit(0.0)), 0, 1))
        source_score = (F.col("decline") + F.col("concentration")) / 2
    temporal = (F.least(one, F.col("intensity") / 5) + F.least(one, F.col("velocity") / 3) + F.least(one, F.col("days") / 30) + stair(F.col("mwu_p"))) / 4
    participation = (F.col("diversity") + F.col("cross_media") + F.col("newcomers") + F.col("growth") + F.col("structure") + F.col("cohesion")) / 6
    weight = F.least(one, F.log2(F.greatest(F.col("n_outlets").cast("double"), one)) / math.log2(10))
    x = x.withColumns({"temporal": temporal, "participation": participation, "source": source_score})
    total = clip((F.col("temporal") + F.col("participation") + F.col("convergence") + F.col("source")) / 4 * weight, 0, 1)
    x = x.withColumn("total", F.when((F.col("n_rows") < 3) | (F.col("n_actors") == 0), 0.0).otherwise(total))
    return x.select("burst_id", group, "onset", "peak", "end", "days", "n_rows", "n_actors", "n_outlets", "n_new", "q", "effect", "ratio", "method", "temporal", "participation", "convergence", "source", "total", classify(F.col("total")).alias("classification"))
