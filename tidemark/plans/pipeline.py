"""The whole analysis, from annotated sentences to drivers, as a bundle of tables that are computed when asked for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean_author, week_end
from ..functions.staging import stage
from ..operators import detect, events, graph, impact, paradigm, relational, series, vectors
from ..sources.tables import export_years, flat


@dataclass(frozen=True)
class Columns:
    """Names of the sentence table's columns; annotations are numbers or text, 0 or 1 in meaning."""

    doc: str = "doc_id"
    sentence: str = "sentence_id"
    day: str = "date"
    author: str = "author"
    outlet: str = "media"
    frames: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    events: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """What is analysed, and the thresholds; weights of the composite are renormalised over the signals there are."""

    columns: Columns
    detector: detect.Settings = field(default_factory=detect.Settings)
    weights: dict[str, float] = field(default_factory=lambda: dict(series.WEIGHTS))
    dim: int = 0
    state_step_days: int = 1
    preload_days: int = 100
    lags: int = 3

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 1e-6:
            raise ValueError("weights of the composite add up to one")
        if not self.columns.frames:
            raise ValueError("there is no frame to analyse")


class Analysis:
    """Results of one run; each table is planned on first use, and staged where several others read it."""

    def __init__(self, config: Config, sentences: DataFrame, vectors_: DataFrame | None = None, start: date | None = None, end: date | None = None, until: date | None = None) -> None:
        """``start`` and ``end`` bound the rows (with days ahead of them); bursts begin from ``start`` to ``until``."""
        self.config, self.sentences, self.vectors, self.start, self.end, self.until = config, sentences, vectors_, start, end, until

    @cached_property
    def clean(self) -> DataFrame:
        """Sentences with a document and a day, in the period and the days ahead of it, annotations as 0 or 1."""
        c, df = self.config.columns, self.sentences
        df = df.withColumn(c.day, F.coalesce(F.expr(f"try_to_date(cast(`{c.day}` as string), 'yyyy-MM-dd')"), F.expr(f"try_to_date(cast(`{c.day}` as string), 'MM-dd-yyyy')"), F.expr(f"try_cast(`{c.day}` as date)")))
        df = df.where(F.col(c.day).isNotNull() & F.col(c.doc).isNotNull())
        if self.start:
            df = df.where(F.col(c.day) >= F.date_sub(F.lit(self.start), self.config.preload_days))
        if self.end:
            df = df.where(F.col(c.day) <= F.lit(self.end))
        df = df.withColumn(c.author, clean_author(F.col(c.author)))
        return relational.binarise(df, [*c.frames, *c.sources, *c.events], "n_annotations", "dominant")

    @cached_property
    def articles(self) -> DataFrame:
        c = self.config.columns
        got = relational.to_articles(self.clean, c.doc, [c.sentence], [c.day, c.author, c.outlet], [*c.frames, *c.sources, *c.events])
        names = {f"{x}_first": x for x in (c.day, c.author, c.outlet)}
        return stage(got.withColumnsRenamed(names), "articles")

    @cached_property
    def mentions(self) -> DataFrame:
        """(doc, day, author, outlet, source, frame): a row for each frame that an article has."""
        c = self.config.columns
        source = F.coalesce(*[F.when(F.col(f"{s}_sum") > 0, F.lit(s)) for s in c.sources], F.lit("none"))
        has = F.filter(F.array(*[F.when(F.col(f"{f}_sum") > 0, F.lit(f)) for f in c.frames]), lambda x: x.isNotNull())
        return self.articles.select(F.col(c.doc).alias("doc"), F.col(c.day).alias("day"), F.col(c.author).alias("author"), F.col(c.outlet).alias("outlet"), source.alias("source"), F.explode(has).alias("frame"))

    @cached_property
    def daily(self) -> DataFrame:
        c = self.config.columns
        n = self.mentions.groupBy("frame", "day").agg(F.count_distinct("doc").alias("n"), F.count_distinct("author").alias("actors"))
        totals = self.articles.groupBy(F.col(c.day).alias("day")).agg(F.count("*").alias("total"))
        grid = series.calendar(self.articles.select(F.col(c.day).alias("day")), "day").crossJoin(F.broadcast(self.mentions.select("frame").distinct()))
        x = grid.join(n, ["frame", "day"], "left").join(totals, "day", "left").fillna(0, ["n", "actors", "total"])
        return stage(x.withColumn("proportion", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)), "daily")

    @cached_property
    def signals(self) -> DataFrame:
        """Five trailing scores by frame and day, each but the first without what the first explains, and their composite."""
        key = ["frame"]
        mix = relational.group_entropy(self.mentions, ["frame", "day"], "source", [*self.config.columns.sources, "none"]).select("frame", "day", "concentration")
        x = series.dominance_ratio(self.daily.join(mix, ["frame", "day"], "left").fillna(0.0, ["concentration"]), "day")
        measures = {"temporal": "proportion", "participation": "actors", "convergence": "dominance", "source": "concentration"}
        if self.vectors is not None:
            v = self.mentions.select("doc", "frame", "day").join(self.article_vectors, "doc")
            sim = vectors.mean_pairwise(v, ["frame", "day"], "vector", self.config.dim).select("frame", "day", F.col("similarity").alias("likeness"))
            x = x.join(sim, ["frame", "day"], "left").fillna(0.0, ["likeness"])
            measures["semantic"] = "likeness"
        for name, value in measures.items():
            x = series.trailing_z(x, value, key, "day").withColumnRenamed("z", f"z_{name}")
        for name in list(measures)[1:]:
            x = series.orthogonalise(x, f"z_{name}", "z_temporal", key, f"z_{name}")
        total = sum(self.config.weights[m] for m in measures)
        x = x.withColumn("composite", series.composite({f"z_{m}": self.config.weights[m] / total for m in measures}))
        return stage(x, "signals")

    @cached_property
    def article_vectors(self) -> DataFrame:
        """Mean of all vectors of a document, its title among them."""
        c = self.config.columns
        return vectors.centroids(self.vectors, [c.doc], "embedding", self.config.dim).select(F.col(c.doc).alias("doc"), F.col("centroid").alias("vector"))

    @cached_property
    def bursts(self) -> DataFrame:
        b = detect.detect_bursts(self.signals, "frame", "day", "composite", self.config.detector)
        b = b.where(F.col("onset") >= F.lit(self.start)) if self.start else b
        return stage(b.where(F.col("onset") <= F.lit(self.until)) if self.until else b, "bursts")

    @property
    def counts(self) -> DataFrame:
        """(frame, classification, n) of the bursts that are left."""
        return self.surges.groupBy("frame", "classification").agg(F.count("*").alias("n"))

    @cached_property
    def surges(self) -> DataFrame:
        kinds = max(2, len(self.config.columns.sources))
        if self.vectors is None:
            return stage(detect.score_bursts(self.bursts, self.mentions, "frame", "day", "author", "outlet", "source", kinds=kinds), "surges")
        rows = self.mentions.join(self.article_vectors, "doc", "left")
        return stage(detect.score_bursts(self.bursts, rows, "frame", "day", "author", "outlet", "source", "doc", "vector", self.config.dim, kinds), "surges")

    @cached_property
    def networks(self) -> DataFrame:
        """Of each burst the co-coverage graph of its authors (same day), summarised."""
        days = self.bursts.select("burst_id", "frame", F.explode(F.sequence("onset", "end")).alias("day"))
        x = self.mentions.join(days, ["frame", "day"]).select("burst_id", "day", "author").where("author <> ''")
        x = x.distinct()
        both = x.withColumnRenamed("author", "src").join(x.withColumnRenamed("author", "dst"), ["burst_id", "day"]).where("src < dst")
        e = both.groupBy(F.col("burst_id").alias("graph"), "src", "dst").agg(F.count("*").alias("weight"))
        return graph.network_summary(e, "graph")

    @cached_property
    def occurrences(self) -> DataFrame:
        return events.occurrences(self._members, self._event_rows, "kind", "doc", "day", "weight")

    @cached_property
    def _event_rows(self) -> DataFrame:
        c = self.config.columns
        kinds = F.filter(F.array(*[F.struct(F.lit(e).alias("kind"), F.col(f"{e}_mean").alias("weight")) for e in c.events]), lambda x: x["weight"] > 0)
        overall = sum((F.col(f"{e}_mean") for e in c.events[1:]), F.col(f"{c.events[0]}_mean")) / len(c.events)
        x = self.articles.select(F.col(c.doc).alias("doc"), F.col(c.day).alias("day"), overall.alias("overall"), F.explode(kinds).alias("k")).select("doc", "day", "overall", "k.*")
        return stage(x.join(self.article_vectors, "doc"), "event-rows")

    @cached_property
    def _members(self) -> DataFrame:
        return stage(events.cluster_seeds(events.seeds(self._event_rows, "kind", "weight", "overall"), "kind", "doc", "day", "vector"), "members")

    @cached_property
    def belonging(self) -> DataFrame:
        centres = vectors.centroids(self._members.join(self.article_vectors, "doc"), ["occurrence"], "vector", self.config.dim).drop("n").join(self.occurrences.select("occurrence", "kind", "peak"), "occurrence")
        return stage(events.soft_assign(self._event_rows, centres, "kind", "doc", "day", "vector", "weight"), "belonging")

    @cached_property
    def attributions(self) -> DataFrame:
        return events.attribute(self.occurrences, self.belonging, self.bursts, self._event_rows.select("doc", "day").distinct(), "doc", "day")

    @cached_property
    def states(self) -> DataFrame:
        weekly = self.daily.groupBy("frame", week_end(F.col("day")).alias("week")).agg(F.avg("proportion").alias("proportion"))
        return stage(paradigm.states(weekly, "frame", "week", "proportion", sorted(self.config.columns.frames), step_days=self.config.state_step_days), "states")

    @cached_property
    def shifts(self) -> DataFrame:
        return stage(paradigm.merge_shifts(paradigm.shifts(self.states)), "shifts")

    @cached_property
    def episodes(self) -> DataFrame:
        return paradigm.episodes(self.shifts)

    @cached_property
    def roles(self) -> DataFrame:
        lifts = paradigm.weighted_lift(self.bursts, self.daily.select("frame", "day", "proportion"), "frame", "day", "proportion")
        return paradigm.attribute(self.shifts, self.surges, lifts, "frame")

    @cached_property
    def drivers(self) -> DataFrame:
        """Occurrences that drive a frame's composite: stability selection over their daily masses."""
        rows = self.mentions.select("doc", "day", "frame")
        mass = self.belonging.join(rows, "doc").groupBy(F.col("frame").alias("model"), "day", F.col("occurrence").alias("entity")).agg(F.sum("belonging").alias("mass"))
        target = self.signals.select(F.col("frame").alias("model"), "day", "composite")
        return impact.select_drivers(target, mass, "model", "day", "composite", "entity", self.config.lags)

    def tables(self) -> dict[str, tuple[DataFrame, str]]:
        """What an export holds, with the day column that it is partitioned by."""
        out = {"daily": (self.daily, "day"), "signals": (self.signals, "day"), "bursts": (self.bursts, "onset"), "surges": (self.surges, "onset"), "states": (self.states, "window_end"), "shifts": (self.shifts, "shift_date")}
        if self.vectors is not None and self.config.columns.events:
            out["occurrences"] = (self.occurrences, "peak")
        return out

    def export(self, folder: str) -> None:
        export_years(self.tables(), folder)

    def to_json(self, name: str) -> DataFrame:
        """A table with its nested columns as JSON text."""
        return flat(self.tables()[name][0])


def run(config: Config, sentences: DataFrame, vectors_: DataFrame | None = None, start: date | None = None, end: date | None = None, until: date | None = None) -> Analysis:
    return Analysis(config, sentences, vectors_, start, end, until)
