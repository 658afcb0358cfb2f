"""What drives what: prevalence and surges, stability-selected regressions, permutation tests, succession."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.exprs import gaussian
from .relational import range_join

ROLES = ("driver", "suppressor", "neutral")


def prevalence(rows: DataFrame, windows: DataFrame, group: str, day: str, flags: dict[str, Column]) -> DataFrame:
    """Share of a group's rows with each flag inside and outside of its windows, odds with interval, exact p and q.

    Four counts for each group and flag come from one aggregation; tests run on those.
    """
    days = range_join(rows.select(group, day).distinct(), windows.select(group, "onset", "end"), [group], day, "onset", "end").select(group, day).distinct().withColumn("_in", F.lit(1))
    x = rows.join(days, [group, day], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    long = x.select(group, "_in", F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), F.coalesce(c, F.lit(False)).alias("hit")) for k, c in flags.items()])).alias("_f"))
    n = lambda i, h: F.count(F.when((F.col("_in") == i) & (F.col("_f.hit") == h), 1))
    table = long.groupBy(group, "_f.flag").agg(n(1, True).alias("a"), n(1, False).alias("b"), n(0, True).alias("c"), n(0, False).alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([group, "flag"]).reset_index(drop=True)
        odds = [stats.odds_ratio(*r) for r in pdf[["a", "b", "c", "d"]].itertuples(index=False)]
        p = np.array([stats.fisher_exact(*map(int, r)) for r in pdf[["a", "b", "c", "d"]].itertuples(index=False)])
        pdf["odds"], pdf["low"], pdf["high"] = zip(*odds)
        pdf["p"], pdf["q"] = p, stats.benjamini_hochberg(p)
        return pdf

    return table.groupBy().applyInPandas(run, f"{group} string, flag string, a long, b long, c long, d long, odds double, low double, high double, p double, q double")


def surge(rows: DataFrame, windows: DataFrame, group: str, day: str, before: int = 7, baseline: int = 30) -> DataFrame:
    """Rows a day in the week before each window against the month before that week; null without a baseline."""
    spans = windows.select("burst_id", group, "onset", F.explode(F.sequence(F.date_sub("onset", before + baseline), F.date_sub("onset", 1))).alias(day))
    x = spans.join(rows.groupBy(group, day).agg(F.count("*").alias("n")), [group, day], "left").fillna(0, ["n"])
    near = F.datediff("onset", day) <= before
    a, b = F.sum(F.when(near, F.col("n")).otherwise(0)) / before, F.sum(F.when(~near, F.col("n")).otherwise(0)) / baseline
    return x.groupBy("burst_id", group).agg(a.alias("rate"), b.alias("base")).withColumn("surge", F.when(F.col("base") > 0, F.col("rate") / F.col("base")))


def lagged_mass(belonging: DataFrame, rows: DataFrame, key: str, day: str, weight: Column) -> DataFrame:
    """(occurrence, day, mass): belonging times a row's weight, summed by day."""
    return belonging.join(rows, key).groupBy("occurrence", day).agg(F.sum(F.col("belonging") * weight).alias("mass"))


EFFECT = "{m} string, entity string, frequency double, beta double, low double, high double, p double, p_wald double, role string, r2 double, n_selected int"


def select_drivers(target: DataFrame, mass: DataFrame, model: str, day: str, value: str, entity: str, lags: int = 3, ar: bool = False, samples: int = 100, bootstraps: int = 500, alpha: float = 0.10, seed: int = 42) -> DataFrame:
    """Entities whose lagged mass drives a model's series: stability selection, then least squares with bootstrap intervals.

    A model is one group: its daily series and the daily masses of its entities meet by
    cogrouping, and the design (days by entities and lags) exists only inside the task.
    A trend, and with ``ar`` the series' own lags of the order of least BIC, are controls.
    ``p`` comes from the bootstrap, ``p_wald`` from a one-sided test of the sum over lags
    (Newey-West errors with ``ar``).
    """

    def run(y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        cols = [model, "entity", "frequency", "beta", "low", "high", "p", "p_wald", "role", "r2", "n_selected"]
        y = y.sort_values(day)
        if len(y) < 30 or x.empty:
            return pd.DataFrame([], columns=cols)
        wide = x.pivot_table(index=day, columns=entity, values="mass", aggfunc="sum").reindex(y[day]).fillna(0.0)
        t = y[value].to_numpy(float)
        design = stats.lagged(wide.to_numpy(float), lags)
        names, k = list(wide.columns), wide.shape[1]
        owner = np.tile(np.arange(k), lags + 1)
        trend = np.linspace(-1, 1, len(t))[:, None]
        controls = np.column_stack([trend, stats.ar_columns(t, stats.ar_order(t))]) if ar else trend
        freq, stable = stats.stability_selection(t, np.column_stack([design, controls]), controls.shape[1], samples, seed=seed)
        by_entity = np.array([freq[owner == i].max() for i in range(k)])
        picked = np.flatnonzero(stable)
        if not len(picked):
            return pd.DataFrame([(str(y[model].iloc[0]), str(names[i]), by_entity[i], 0.0, 0.0, 0.0, 1.0, 1.0, "neutral", 0.0, 0) for i in range(k)], columns=cols)
        full = np.column_stack([design[:, picked], controls, np.ones(len(t))])
        fit = stats.ols(t, full, "hac" if ar else "plain")
        groups = [i for i in range(k) if (owner[picked] == i).any()]
        boots = stats.bootstrap_sums(t, full, [np.flatnonzero(owner[picked] == i) for i in groups], bootstraps, seed)
        out = []
        for i in range(k):
            if i not in groups:
                out.append((str(y[model].iloc[0]), str(names[i]), by_entity[i], 0.0, 0.0, 0.0, 1.0, 1.0, "neutral", fit.r2, len(picked)))
                continue
            b, s = float(fit.beta[np.flatnonzero(owner[picked] == i)].sum()), boots[:, groups.index(i)]
            low, high = np.quantile(s, [alpha / 2, 1 - alpha / 2])
            p = float(min(1.0, 2 * min((s <= 0).mean(), (s >= 0).mean())))
            role = "driver" if low > 0 else "suppressor" if high < 0 else "neutral"
            wald = stats.wald(fit, np.flatnonzero(owner[picked] == i), len(t) - full.shape[1])
            out.append((str(y[model].iloc[0]), str(names[i]), by_entity[i], b, float(low), float(high), p, wald, role, fit.r2, len(picked)))
        return pd.DataFrame(out, columns=cols)

    left = target.select(F.col(model).cast("string").alias(model), day, value).groupBy(model)
    right = mass.select(F.col(model).cast("string").alias(model), day, entity, "mass").groupBy(model)
    return left.cogroup(right).applyInPandas(run, EFFECT.format(m=model))


def validate(target: DataFrame, model: str, day: str, value: str, folds: int = 3, share: float = 0.7) -> DataFrame:
    """(model, fold, r2): an autoregression on expanding windows, and on the last part after ``share``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values(day)[value].to_numpy(float)
        p = stats.ar_order(t)
        x = np.column_stack([stats.ar_columns(t, p), np.ones(len(t))])
        cuts = np.linspace(0, len(t), folds + 3).astype(int)
        parts = [(slice(p, cuts[k + 2]), slice(cuts[k + 2], cuts[k + 3]), f"fold {k + 1}") for k in range(folds)]
        parts.append((slice(p, int(share * len(t))), slice(int(share * len(t)), len(t)), "test"))
        out = []
        for train, test, name in parts:
            b = stats.ols(t[train], x[train]).beta
            e, total = ((t[test] - x[test] @ b) ** 2).sum(), ((t[test] - t[train].mean()) ** 2).sum()
            out.append((str(pdf[model].iloc[0]), name, float(1 - e / total) if total > 0 else 0.0))
        return pd.DataFrame(out, columns=[model, "fold", "r2"])

    return target.groupBy(model).applyInPandas(run, f"{model} string, fold string, r2 double")


def validate_drivers(target: DataFrame, mass: DataFrame, model: str, day: str, value: str, entity: str, lags: int = 3, ar: bool = True, folds: int = 3, share: float = 0.7, samples: int = 100, least: int = 30, seed: int = 42) -> DataFrame:
    """(model, fold, r2, n_stable): how well selected drivers foretell what they weren't fitted to.

    Selection and fit are made anew on each expanding part (of ``folds`` + 1 equal ones, of
    ``least`` rows at least) and tried on the next, and on the first ``share`` and the rest.
    Without a stable driver the forecast is the mean.
    """

    def run(y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out, y = [], y.sort_values(day)
        if x.empty or y.empty:
            return pd.DataFrame(out, columns=[model, "fold", "r2", "n_stable"])
        wide = x.pivot_table(index=day, columns=entity, values="mass", aggfunc="sum").reindex(y[day]).fillna(0.0)
        t = y[value].to_numpy(float)
        design = stats.lagged(wide.to_numpy(float), lags)
        trend = np.linspace(-1, 1, len(t))[:, None]
        controls = np.column_stack([trend, stats.ar_columns(t, stats.ar_order(t))]) if ar else trend
        seg = len(t) // (folds + 1)
        parts = [(f"fold {k + 1}", (k + 1) * seg, (k + 2) * seg) for k in range(folds)] if seg >= least else []
        if len(t) - int(share * len(t)) >= 10:
            parts.append(("test", int(share * len(t)), len(t)))
        for name, a, b in parts:
            _, stable = stats.stability_selection(t[:a], np.column_stack([design[:a], controls[:a]]), controls.shape[1], samples, seed=seed)
            full = np.column_stack([np.ones(b), controls[:b], design[:b][:, stable]])
            guess = full[a:] @ np.linalg.lstsq(full[:a], t[:a], rcond=None)[0] if stable.any() else np.full(b - a, t[:a].mean())
            total = float(((t[a:b] - t[a:b].mean()) ** 2).sum())
            out.append((str(y[model].iloc[0]), name, float(1 - ((t[a:b] - guess) ** 2).sum() / total) if total > 0 else 0.0, int(stable.sum())))
        return pd.DataFrame(out, columns=[model, "fold", "r2", "n_stable"])

    left = target.select(F.col(model).cast("string").alias(model), day, value).groupBy(model)
    right = mass.select(F.col(model).cast("string").alias(model), day, entity, "mass").groupBy(model)
    return left.cogroup(right).applyInPandas(run, f"{model} string, fold string, r2 double, n_stable int")


def responses(pairs: DataFrame, pair: str, day: str, shock: str, target: str, horizons: int = 14) -> DataFrame:
    """(pair, h, response, error, p): local projections of each pair's target on its shock, HAC errors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        rows = stats.local_projection(pdf[target].to_numpy(float), pdf[shock].to_numpy(float), horizons)
        return pd.DataFrame([(str(pdf[pair].iloc[0]), *r) for r in rows], columns=[pair, "h", "response", "error", "p"])

    return pairs.groupBy(pair).applyInPandas(run, f"{pair} string, h int, response double, error double, p double")


def impact_table(series: DataFrame, events: DataFrame, group: str, day: str, value: str, peak: str, event: str, permutations: int = 200, seed: int = 42) -> DataFrame:
    """Each event and group: difference in means around the peak, its p, a circular-shift p, and the strongest lagged correlation."""

    def run(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values(day)
        x, days = s[value].to_numpy(float), {d: i for i, d in enumerate(s[day])}
        out = []
        for r in e.sort_values(event).to_dict("records"):
            i = days.get(r[peak])
            if i is None:
                continue
            did, p = stats.diff_in_diff(x, i)
            perm = stats.circular_shift_p(lambda t: stats.diff_in_diff(t, i)[0], x, permutations, seed) if np.isfinite(did) else float("nan")
            pulse = np.exp(-np.abs(np.arange(len(x)) - i) / 7.0)
            lag, corr, pc = stats.cross_correlation(pulse, x)
            out.append((str(r[group]), str(r[event]), did, p, perm, lag, corr, pc))
        return pd.DataFrame(out, columns=[group, "event", "did", "did_p", "perm_p", "lag", "corr", "corr_p"])

    return series.groupBy(group).cogroup(events.groupBy(group)).applyInPandas(run, f"{group} string, event string, did double, did_p double, perm_p double, lag int, corr double, corr_p double")


def proximity(a: str, b: str, sigma: float = 21.0) -> Column:
    return gaussian(F.datediff(a, b), sigma)


def confidence(did: Column, corr: Column, near: Column, content: Column, scale: float = 0.05) -> Column:
    """Evidence of effect, dose and time, gated by content."""
    return (0.4 * F.abs(F.tanh(did / scale)) + 0.3 * F.abs(corr) + 0.3 * near) * (0.5 + 0.5 * content)


def succession(bursts: DataFrame, group: str, within: int = 21, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """(before, after, n, z): how often a group's burst follows another's, against shuffled labels; one row a burst is gathered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("burst_id")
        names, g = np.unique(pdf[group], return_inverse=True)
        a = pd.to_datetime(pdf["onset"]).map(pd.Timestamp.toordinal).to_numpy()
        b = pd.to_datetime(pdf["end"]).map(pd.Timestamp.toordinal).to_numpy()
        order = np.argsort(a, kind="stable")
        low, high = np.searchsorted(a[order], b + 1), np.searchsorted(a[order], b + within + 1)
        i = np.repeat(np.arange(len(a)), high - low)
        j = order[np.concatenate([np.arange(x, y) for x, y in zip(low, high)])] if len(i) else np.zeros(0, int)
        k = len(names)
        count = lambda lab: np.bincount(lab[i] * k + lab[j], minlength=k * k)
        rng = np.random.default_rng(seed)
        null = np.array([count(rng.permutation(g)) for _ in range(permutations)])
        seen, sd = count(g), null.std(0)
        z = np.divide(seen - null.mean(0), sd, out=np.zeros(k * k), where=sd > 0)
        return pd.DataFrame([(names[x // k], names[x % k], int(seen[x]), float(z[x])) for x in range(k * k)], columns=["before", "after", "n", "z"])

    return bursts.select("burst_id", group, "onset", "end").groupBy().applyInPandas(run, "before string, after string, n long, z double")


def near_pairs(left: DataFrame, right: DataFrame, left_day: str, right_day: str, sigma: float = 21.0, least: float = 0.01) -> DataFrame:
    """Rows of two tables whose days are near: Gaussian proximity of ``least`` and more, as ``proximity``.

    The gate bounds the days between them, so both are joined on buckets of that many
    days (each row meets its own and the next ones), not all with all.
    """
    reach = int(math.floor(sigma * math.sqrt(-2 * math.log(least))))
    epoch = F.lit("1970-01-01").cast("date")
    a = left.withColumn("_k", F.floor(F.datediff(left_day, epoch) / (reach + 1)))
    b = right.withColumn("_k", F.explode(F.array(*[F.floor(F.datediff(right_day, epoch) / (reach + 1)) + i for i in (-1, 0, 1)])))
    return a.join(b, "_k").withColumn("proximity", proximity(left_day, right_day, sigma)).where(F.col("proximity") >= least).drop("_k")


def content_relevance(affinity: Column, alignment: Column, saturation: float = 0.20, floor: float = 0.30) -> Column:
    """A gate from ``floor`` to 1: 0.6 of the share of a frame (full at ``saturation``), 0.4 of likeness (half if unknown)."""
    raw = 0.60 * F.least(F.lit(1.0), affinity / saturation) + 0.40 * F.coalesce(F.least(F.greatest(alignment, F.lit(0.0)), F.lit(1.0)), F.lit(0.5))
    return floor + (1 - floor) * F.least(F.lit(1.0), raw)


def attribution_confidence(p: Column, permuted: Column, content: Column, near: Column, alpha: float = 0.10, fdr: float = 0.10) -> Column:
    """0.30 of the best p-value, 0.30 of the permutation's, 0.25 of content, 0.15 of time; each 0 to 1."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return 0.30 * unit(1 - p / alpha) + 0.30 * unit(1 - permuted / fdr) + 0.25 * unit(content) + 0.15 * unit(near)


def magnitude(effects: DataFrame, source: str, beta: str, weight: str) -> DataFrame:
    """(source, magnitude): the length of a source's effects over all targets, times its weight."""
    return effects.groupBy(source).agg((F.sqrt(F.sum(F.col(beta) * F.col(beta))) * F.max(weight)).alias("magnitude"))


def shift_contribution(effects: DataFrame, timeline: DataFrame, source: str, target: str, beta: str, peak: str, day: str, value: str, window: int = 7) -> DataFrame:
    """(source, contribution): sum over targets of |effect| times the change of the target from ``window`` rows before the peak to as many after.

    The timeline's rows are numbered once for all targets; the row nearest to the peak
    (the earlier of two) is found by an ordered pass over both, not pair by pair.
    """
    days = timeline.select(day).distinct().withColumn("_i", F.row_number().over(Window.orderBy(day)))  # a row a day
    last = days.agg(F.max("_i").alias("_n"))
    asked = effects.select(F.col(peak).alias(day)).distinct()
    both = asked.withColumn("_ask", F.lit(1)).unionByName(days.select(day, F.lit(0).alias("_ask")))
    w = Window.orderBy(day, F.desc("_ask"))
    at = F.when(F.col("_ask") == 0, F.col(day))
    before = F.last(at, True).over(Window.orderBy(day, "_ask").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"_b": before, "_a": after}).where("_ask = 1")
    near = near.withColumn("_d", F.when(F.col("_a").isNull() | (F.datediff(day, "_b") <= F.datediff("_a", day)), F.col("_b")).otherwise(F.col("_a")))
    spot = near.select(F.col(day).alias(peak), F.col("_d").alias(day)).join(days, day).crossJoin(F.broadcast(last)).select(peak, F.greatest(F.col("_i") - window, F.lit(1)).alias("_lo"), F.least(F.col("_i") + window, "_n").alias("_hi"))
    v = timeline.select(target, day, value).join(days, day)
    x = effects.join(spot, peak)
    x = x.join(v.select(target, F.col("_i").alias("_lo"), F.col(value).alias("_v0")), [target, "_lo"]).join(v.select(target, F.col("_i").alias("_hi"), F.col(value).alias("_v1")), [target, "_hi"])
    return x.groupBy(source).agg(F.sum(F.abs(beta) * F.abs(F.col("_v1") - F.col("_v0"))).alias("contribution"))
