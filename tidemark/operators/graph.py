"""Graphs as edge tables (src, dst, weight): table algorithms at any size, and the metric kernel for small graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.staging import stage


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def basic(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree, triangles, transitivity, mean clustering, assortativity, s-metric, R0."""
    two = stage(both_ways(edges), "graph-edges")
    d = stage(two.groupBy("src").agg(F.count("*").alias("k")), "graph-degrees")
    n = d.agg(F.count("*").alias("n"), F.sum("k").alias("m2"), F.avg("k").alias("mean_degree"), F.var_pop("k").alias("_v"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("_t"))
    # edges point to the end of more neighbours, so that a hub's own pairs are few
    up = two.join(d.withColumnRenamed("k", "ka"), "src").join(d.select(F.col("src").alias("dst"), F.col("k").alias("kb")), "dst").where(F.struct("ka", "src") < F.struct("kb", "dst")).select("src", "dst")
    tri = up.alias("a").join(up.alias("b"), F.col("a.dst") == F.col("b.src")).join(up.alias("c"), (F.col("a.src") == F.col("c.src")) & (F.col("b.dst") == F.col("c.dst"))).select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    per = tri.select(F.explode(F.array("x", "y", "z")).alias("src")).groupBy("src").agg(F.count("*").alias("t"))
    local = d.join(per, "src", "left").select(F.coalesce("t", F.lit(0)).alias("t"), F.when(F.col("k") > 1, F.coalesce("t", F.lit(0)) * 2 / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("c"))
    cl = local.agg((F.sum("t") / 3).cast("long").alias("triangles"), F.avg("c").alias("average_clustering"))
    ends = two.join(d.withColumnRenamed("k", "ka"), "src").join(d.select(F.col("src").alias("dst"), F.col("k").alias("kb")), "dst")
    a = ends.agg(F.corr("ka", "kb").alias("assortativity"), (F.sum(F.col("ka") * F.col("kb")) / 2).alias("s_metric"))
    return n.crossJoin(cl).crossJoin(a).select("n", (F.col("m2") / 2).cast("long").alias("m"), (F.col("m2") / (F.col("n") * (F.col("n") - 1))).alias("density"), "mean_degree", "triangles", F.when(F.col("_t") > 0, 3 * F.col("triangles") / F.col("_t")).otherwise(0.0).alias("transitivity"), "average_clustering", "assortativity", "s_metric", (F.col("mean_degree") + F.col("_v") / F.col("mean_degree")).alias("R0"))


def pagerank(edges: DataFrame, damping: float = 0.85, tol: float = 1e-6, rounds: int = 60, stride: int = 6) -> DataFrame:
    """Unweighted PageRank by joins, until the ranks move by less than ``tol`` a node in all.

    ``stride`` rounds make up a job, whose result is staged, so that no plan grows with the
    rounds.  A node's row carries its ranks along, so each round is one join and one
    aggregation, and the round that ends it is found afterwards.
    """
    two = stage(both_ways(edges), "pr-edges")
    d = stage(two.groupBy("src").agg(F.count("*").alias("k")), "pr-degrees")
    n = d.count()
    own = d.select("src", F.col("src").alias("dst"), F.lit(1).cast("long").alias("k"), F.lit(True).alias("own"))
    links = stage(two.join(d, "src").select("src", "dst", "k", F.lit(False).alias("own")).unionByName(own), "pr-links")
    rank = stage(d.select(F.col("src").alias("node"), F.array(F.lit(1.0 / max(1, n))).alias("r")), "pr")
    done = 0
    while n and done < rounds:
        steps = min(stride, rounds - done)
        for _ in range(steps):
            x = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.when(~F.col("own"), F.element_at("r", -1) / F.col("k"))).alias("got"), F.first(F.when(F.col("own"), F.col("r")), ignorenulls=True).alias("r"))
            rank = x.select(F.col("dst").alias("node"), F.concat("r", F.array(F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0)))).alias("r"))
        rank = stage(rank, "pr")
        moved = rank.agg(*[F.sum(F.abs(F.get("r", F.lit(i + 1)) - F.get("r", F.lit(i)))).alias(f"m{i}") for i in range(steps)]).first()
        settled = next((i for i in range(steps) if moved[i] < n * tol), None)
        if settled is not None:
            return rank.select("node", F.get("r", F.lit(settled + 1)).alias("rank"))
        rank, done = rank.select("node", F.array(F.element_at("r", -1)).alias("r")), done + steps
    return rank.select("node", F.element_at("r", -1).alias("rank"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each one reaches, by stars that contract (as in map-reduce)."""
    e = stage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    nodes = stage(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "cc-nodes")
    for _ in range(rounds):
        two = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        new = stage(pairs.select("p.*").where("u <> v").distinct(), "cc")
        same = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def core_numbers(edges: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(node, core): each node takes the h-index of its neighbours' numbers, from its degree down, until none moves."""
    two = stage(both_ways(edges), "core-edges")
    core = stage(two.groupBy("src").agg(F.count("*").alias("c")), "core")
    for _ in range(rounds):
        seen = two.join(core.select(F.col("src").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.count("*").alias("n"))
        from pyspark.sql import Window

        at_least = seen.withColumn("a", F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("c"))))
        h = at_least.groupBy("src").agg(F.max(F.least("c", "a")).alias("h"))
        new = stage(core.join(h, "src").select("src", F.least("c", "h").alias("c"), (F.col("h") < F.col("c")).alias("moved")), "core")
        done = new.where("moved").isEmpty()
        core = new.drop("moved")
        if done:
            break
    else:
        raise RuntimeError(f"core numbers did not settle in {rounds} rounds")
    return core.select(F.col("src").alias("node"), F.col("c").alias("core"))


def threshold_spread(edges: DataFrame, seeds: DataFrame, threshold: float = 0.5, rounds: int = 1000) -> DataFrame:
    """(node, step) of nodes that become active once a share of their neighbours is; seeds have step 0."""
    two = stage(both_ways(edges), "lt-edges")
    d = two.groupBy("src").agg(F.count("*").alias("k"))
    active = stage(seeds.select("node", F.lit(0).alias("step")), "lt")
    for step in range(1, rounds):
        hit = two.join(active, F.col("dst") == F.col("node")).groupBy("src").agg(F.count("*").alias("a"))
        new = hit.join(d, "src").where(F.col("a") / F.col("k") >= threshold).join(active, F.col("src") == F.col("node"), "left_anti")
        new = stage(new.select(F.col("src").alias("node"), F.lit(step).alias("step")), "lt-new")
        if new.isEmpty():
            break
        active = stage(active.unionByName(new), "lt")
    return active


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): synchronous majority of neighbours and the node itself, ties to the largest label."""
    two = stage(both_ways(edges), "lp-edges")
    label = stage(two.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct(), "lp")
    for _ in range(rounds):
        heard = two.join(label, F.col("dst") == F.col("node")).select("src", "label").unionByName(label.select(F.col("node").alias("src"), "label"))
        votes = heard.groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", "label")).alias("b"))
        new = stage(best.select(F.col("src").alias("node"), F.col("b.label").alias("label")), "lp")
        same = new.join(label, ["node", "label"], "left_anti").isEmpty()
        label = new
        if same:
            break
    return label


def metrics(edges: DataFrame, graph: str, names: list[str] | None = None, directed: bool = False, series: bool = False) -> DataFrame:
    """(graph, family, metric, node, value) of every small graph: the kernel by group, 63 metrics or those named.

    With ``series``, metrics of walks are the sums of as many terms as ``graphs.SERIES`` says.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = graphs.Graph(pdf["src"], pdf["dst"], pdf["weight"] if "weight" in pdf else None, directed)
        rows = graphs.metrics(g, names, graphs.SERIES if series else None) if g.n else []
        return pd.DataFrame([(str(pdf[graph].iloc[0]), *r) for r in rows], columns=["graph", "family", "metric", "node", "value"])

    return edges.groupBy(graph).applyInPandas(run, "graph string, family string, metric string, node string, value double")


def network_summary(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, nodes, edges, density, modularity, mean_degree, components, clustering) of every small graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = graphs.Graph(pdf["src"], pdf["dst"], pdf["weight"] if "weight" in pdf else None)
        row = (str(pdf[graph].iloc[0]), g.n, g.m, 2 * g.m / (g.n * (g.n - 1)) if g.n > 1 else 0.0, graphs.modularity(g, g.communities), float(g.degree.mean()), len(g.components), float(graphs.REGISTRY["average_clustering"][1](g)))
        return pd.DataFrame([row], columns=["graph", "nodes", "edges", "density", "modularity", "mean_degree", "components", "clustering"])

    return edges.groupBy(graph).applyInPandas(run, "graph string, nodes long, edges long, density double, modularity double, mean_degree double, components long, clustering double")
