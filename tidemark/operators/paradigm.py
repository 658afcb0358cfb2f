"""Which groups dominate over time: states, shifts, episodes, and what drives them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dominance as dom
from ..functions.exprs import clip, cosine
from . import series

STATE = "window_end date, dominant array<string>, kind string, scores array<double>, concentration double, coherence double"


def states(weekly: DataFrame, group: str, week: str, value: str, groups: list[str], weeks: int = 12, step_days: int = 1, least: int = 11) -> DataFrame:
    """The state of each window of ``weeks`` weeks that ends on a day: scores of the groups, the dominant ones.

    A window's weekly means are trailing means of seven days, taken a week apart: each
    day's mean goes to ``weeks`` window ends.  Each window is then a group of its own
    (weeks times groups numbers), so that windows spread over all tasks.
    """
    daily = series.interpolate_daily(weekly, group, week, value)
    ends = daily.agg(F.min(week).alias("a"), F.max(week).alias("b"))
    last7 = Window.partitionBy(group).orderBy(F.datediff(week, F.lit("1970-01-01").cast("date"))).rangeBetween(-6, 0)
    mean = daily.withColumns({"v": F.avg(value).over(last7), "n": F.count("*").over(last7)}).where("n = 7")
    wide = mean.crossJoin(F.broadcast(ends)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))).withColumn("window_end", F.date_add(week, 7 * F.col("k")))  # one row
    means = wide.where((F.col("window_end") <= F.col("b")) & (F.pmod(F.datediff("window_end", "a"), F.lit(step_days)) == 0)).select("window_end", group, "k", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="k", columns=group, values="v").sort_index(ascending=False).reindex(columns=groups).fillna(0.0).to_numpy()
        if len(x) < least:
            return pd.DataFrame([], columns=["window_end", "dominant", "kind", "scores", "concentration", "coherence"])
        s = dom.scores(x)
        top = dom.dominant(s)
        p = s / s.sum() if s.sum() else np.full(len(s), 1 / len(s))
        inner = np.corrcoef(x[:, top].T) if len(top) > 1 else np.ones((1, 1))
        coherence = float(np.nan_to_num(inner[np.triu_indices(len(top), 1)]).mean()) if len(top) > 1 else 1.0
        row = (pdf["window_end"].iloc[0], sorted(groups[i] for i in top), dom.kind(len(top)), s.tolist(), float((p * p).sum()), coherence)
        return pd.DataFrame([row], columns=["window_end", "dominant", "kind", "scores", "concentration", "coherence"])

    return means.groupBy("window_end").applyInPandas(run, STATE)


def shifts(state: DataFrame, far: float = 0.3) -> DataFrame:
    """States that differ from the one before: type, groups that enter and leave, magnitude; ids are content hashes.

    One row a window is ordered; nothing here grows with the rows behind them.
    """
    w = Window.orderBy("window_end")
    b = state.select("*", *[F.lag(c).over(w).alias(f"{c}_before") for c in ("window_end", "dominant", "scores", "concentration")]).where("dominant_before is not null")
    enter, leave = F.array_except("dominant", "dominant_before"), F.array_except("dominant_before", "dominant")
    common = F.size(F.array_intersect("dominant", "dominant_before"))
    j = 1 - common / F.size(F.array_union("dominant", "dominant_before"))
    v = 1 - cosine(F.col("scores"), F.col("scores_before"))
    d = F.col("concentration") - F.col("concentration_before")
    changed = (F.size("entering") > 0) | (F.size("exiting") > 0)
    kind = F.when(~changed, "recomposition").when(common == 0, "full_replacement").when((F.size("entering") > 0) & (F.size("exiting") > 0), "recomposition").when(F.size("entering") > 0, "frame_entry").otherwise("frame_exit")
    x = b.withColumns({"entering": F.array_sort(enter), "exiting": F.array_sort(leave), "jaccard_distance": j, "vector_distance": v, "concentration_change": d})
    x = x.where(changed | (F.col("vector_distance") > far)).withColumn("shift_type", kind)
    size = 0.4 * F.col("jaccard_distance") + 0.4 * F.least(F.col("vector_distance"), F.lit(1.0)) + 0.2 * F.least(F.abs("concentration_change"), F.lit(1.0))
    ident = F.substring(F.sha2(F.concat_ws("|", F.col("window_end").cast("string"), F.array_join("dominant_before", ","), F.array_join("dominant", ",")), 256), 1, 12)
    return x.select(ident.alias("shift_id"), F.col("window_end").alias("shift_date"), "shift_type", "entering", "exiting", F.col("dominant_before").alias("before"), F.col("dominant").alias("after"), size.alias("magnitude"), "vector_distance", "jaccard_distance", "concentration_change")


def merge_shifts(shift: DataFrame, within_days: int = 14) -> DataFrame:
    """Shifts close together become one from the first state to the last, unless the next turns the one before back.

    An ordered fold over one row a shift, in a single task.
    """
    cols = ["shift_id", "shift_date", "shift_type", "entering", "exiting", "before", "after", "magnitude", "merged"]

    def kind(before: set, after: set) -> str:
        enter, leave = after - before, before - after
        return "full_replacement" if not before & after else "recomposition" if (enter and leave) or not (enter or leave) else "frame_entry" if enter else "frame_exit"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values("shift_date").to_dict("records"):
            r = {k: (set(v) if k in ("entering", "exiting", "before", "after") else v) for k, v in r.items()}
            last = out[-1] if out else None
            turned = last and ((r["entering"] & last["exiting"]) or (r["exiting"] & last["entering"]))
            if last and (r["shift_date"] - last["end"]).days <= within_days and not turned:
                last.update(end=r["shift_date"], after=r["after"], magnitude=max(last["magnitude"], r["magnitude"]), merged=last["merged"] + 1)
                last.update(entering=last["after"] - last["before"], exiting=last["before"] - last["after"], shift_type=kind(last["before"], last["after"]))
            else:
                out.append({**r, "end": r["shift_date"], "merged": 1})
        return pd.DataFrame([[sorted(o[c]) if isinstance(o[c], set) else o[c] for c in cols] for o in out], columns=cols)

    schema = "shift_id string, shift_date date, shift_type string, entering array<string>, exiting array<string>, before array<string>, after array<string>, magnitude double, merged int"
    return shift.groupBy().applyInPandas(run, schema)


def qualify(shift: DataFrame, period_end: Column) -> DataFrame:
    """How long the new regime lasts, whether it is structural (a quarter and more), and whether the next shift undoes it."""
    w = Window.orderBy("shift_date")
    nxt = F.lead("shift_date").over(w)
    back = F.lead("after").over(w)
    days = F.datediff(F.coalesce(nxt, period_end), "shift_date")
    return shift.withColumns({"regime_days": days, "structural": days >= 91, "reversible": F.coalesce(F.array_sort(back) == F.array_sort("before"), F.lit(False))})


def episodes(shift: DataFrame, gap_days: int = 21) -> DataFrame:
    """Shifts not more than three weeks apart: first and last day, number, largest magnitude, net change."""
    w = Window.orderBy("shift_date")
    new = F.when(F.datediff("shift_date", F.lag("shift_date").over(w)) <= gap_days, 0).otherwise(1)
    x = shift.withColumn("_n", new).withColumn("episode", F.sum("_n").over(w))
    return x.groupBy("episode").agg(F.min("shift_date").alias("start_day"), F.max("shift_date").alias("end_day"), F.count("*").alias("shifts"), F.max("magnitude").alias("magnitude"), F.min_by("before", "shift_date").alias("before"), F.max_by("after", "shift_date").alias("after"))


def weighted_lift(bursts: DataFrame, timeline: DataFrame, group: str, day: str, value: str, after: int = 42, before: int = 14) -> DataFrame:
    """(burst_id, own_lift, structural): what changes with a burst, weights falling linearly over ``after`` days from its onset.

    own_lift: mean of its own group's value less the mean of the days before (of all days
    where there are none).  structural: cosine distance of all groups' values before and after.
    """
    k = F.datediff(day, "onset")
    near = bursts.select("burst_id", F.col(group).alias("_own"), "onset", F.explode(F.sequence(F.date_sub("onset", before), F.date_add("onset", after))).alias(day))
    w = F.when(k >= 0, 1 - k / after)
    x = near.join(timeline.select(group, day, value), day).groupBy("burst_id", "_own", group).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("_post"), F.avg(F.when(k < 0, F.col(value))).alias("_pre"))
    x = x.join(timeline.groupBy(group).agg(F.avg(value).alias("_all")), group).withColumn("_pre", F.coalesce("_pre", "_all"))
    own = F.max(F.when(F.col("_own") == F.col(group), F.col("_post") - F.col("_pre")))
    length = F.sqrt(F.sum(F.col("_pre") * F.col("_pre"))) * F.sqrt(F.sum(F.col("_post") * F.col("_post")))
    far = F.when((F.count("*") > 1) & (length > 0), 1 - F.least(F.lit(1.0), F.sum(F.col("_pre") * F.col("_post")) / length)).otherwise(0.0)
    return x.groupBy("burst_id").agg(F.coalesce(own, F.lit(0.0)).alias("own_lift"), F.coalesce(far, F.lit(0.0)).alias("structural"))


def composition(scores: DataFrame, group: str, day: str, value: str, dominant: Column) -> DataFrame:
    """(day, group, share, size): values of the dominant groups over their sum, zero for the others, and how many dominate."""
    w = Window.partitionBy(day)
    x = scores.withColumn("_v", F.when(dominant, F.col(value)).otherwise(0.0)).withColumn("_k", F.count(F.when(dominant, 1)).over(w))
    total = F.sum("_v").over(w)
    return x.select(day, group, F.when(total > 0, F.col("_v") / total).otherwise(0.0).alias("share"), F.col("_k").alias("size"))


def size_label(size: Column) -> Column:
    return F.when(size == 0, "none").when(size == 1, "mono").when(size == 2, "dual").when(size == 3, "triple").otherwise("multiple")


def attribute(shift: DataFrame, bursts: DataFrame, lifts: DataFrame, group: str, lookback_days: int = 84, least_score: float = 0.40, lift: float = 0.05, moved: float = 0.010) -> DataFrame:
    """Bursts that overlap or precede a shift, with their part in it: amplification (its own group rises),
    destabilisation (the structure of all groups moves, without that) or dormant.

    Joined on exploded lookback days, not pair by pair.
    """
    b = bursts.where(F.col("total") >= least_score).join(lifts, "burst_id", "left").fillna(0.0, ["own_lift", "structural"])
    reach = b.withColumn("shift_date", F.explode(F.sequence(F.col("onset"), F.date_add("end", lookback_days))))
    change = F.abs("concentration_change") if "concentration_change" in shift.columns else F.lit(0.0)
    x = shift.select("shift_id", "shift_date", "entering", "exiting", "after", change.alias("_cc")).join(reach, "shift_date")
    overlap = clip((F.datediff(F.least("end", "shift_date"), F.greatest("onset", F.date_sub("shift_date", lookback_days))) + 1) / lookback_days, 0, 1)
    recent = 1 - clip(F.datediff("shift_date", F.least("end", "shift_date")) / lookback_days, 0, 1)
    x = x.withColumn("temporal_score", 0.5 * overlap + 0.5 * recent)
    align = F.when(F.array_contains("entering", F.col(group)), 1.0).when(F.array_contains("after", F.col(group)), 0.7).otherwise(0.3)
    role = F.when(F.col("own_lift") > lift, "amplification").when(F.col("structural") > moved, "destabilisation").otherwise("dormant")
    size = F.when(role == "destabilisation", F.least(F.col("structural") / 0.10, F.lit(1.0))).otherwise(F.least(F.abs("own_lift") / 0.5, F.lit(1.0)))
    score = F.when(role == "dormant", 0.5 * F.col("temporal_score") + 0.5 * F.col("total")).otherwise(0.30 * F.col("temporal_score") + 0.35 * size + 0.20 * F.col("total") + 0.15 * F.when(role == "destabilisation", F.least(F.col("_cc") / 0.3, F.lit(1.0))).otherwise(align))
    return x.select("shift_id", "burst_id", group, role.alias("role"), score.alias("attribution_score"), "temporal_score", "own_lift", "structural")
