"""Names that mean the same entity: blocked pairs, rule scores, components, canonical forms."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import blocking_keys
from ..functions.staging import stage
from .graph import components

SUFFIXES = {"inc", "ltd", "corp", "co", "company", "llc", "gmbh", "sa", "university", "the", "of"}


def person_similarity(a: str, b: str) -> float:
    """1 for equal names; by surname, first name, initial and nickname rules; 0 where first names clash."""
    x, y = a.lower().split(), b.lower().split()
    if x == y:
        return 1.0
    if not x or not y or not set(x) & set(y):
        return 0.95 if SequenceMatcher(None, a.lower(), b.lower()).ratio() > 0.95 else 0.0
    if x[-1] != y[-1]:
        return 0.0
    if len(x) == 1 or len(y) == 1:
        return 0.70
    f, g = x[0].rstrip("."), y[0].rstrip(".")
    if f == g:
        return 0.95
    if f.startswith(g) or g.startswith(f):
        return 0.90
    if f[0] == g[0] and min(len(f), len(g)) / max(len(f), len(g)) >= 0.4 and len(set(f) & set(g)) / max(len(set(f)), len(set(g))) >= 0.75:
        return 0.80
    return 0.0


def organisation_similarity(a: str, b: str) -> float:
    x, y = [w for w in a.lower().split() if w not in SUFFIXES], [w for w in b.lower().split() if w not in SUFFIXES]
    if a.lower() == b.lower():
        return 1.0
    if set(x) == set(y) and x:
        return 0.92
    short, long = sorted((x, y), key=len)
    if len(short) == 1 and len(long) > 1 and short[0] == "".join(w[0] for w in long):
        return 0.95
    return 0.95 if SequenceMatcher(None, a.lower(), b.lower()).ratio() > 0.95 else 0.0


def location_similarity(a: str, b: str) -> float:
    """Equal, contained as whole words, or alike in spelling."""
    x, y = a.lower().strip(), b.lower().strip()
    if x == y:
        return 1.0
    short, long = sorted((x, y), key=len)
    if f" {short} " in f" {long} ":
        return 0.85
    return SequenceMatcher(None, x, y).ratio()


RULES = {"PER": person_similarity, "ORG": organisation_similarity, "LOC": location_similarity}


def pairs(entities: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """(type, a, b, score) of names that share a blocking key; each pair is scored once.

    A key that very many names share is split by AQE; there is no cap on a block.
    """
    e = entities.select(kind, name).distinct().select(F.col(kind).alias("type"), F.col(name).alias("n"), F.explode(blocking_keys(F.col(name))).alias("key"))
    p = e.withColumnRenamed("n", "a").join(e.withColumnRenamed("n", "b"), ["type", "key"]).where("a < b").select("type", "a", "b").distinct()

    def score(kinds: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([RULES.get(k, location_similarity)(x, y) for k, x, y in zip(kinds, a, b)], dtype=float)

    return p.withColumn("score", F.pandas_udf(score, "double")("type", "a", "b"))


def resolve(entities: DataFrame, threshold: float = 0.75, name: str = "name", kind: str = "type", count: str = "n") -> DataFrame:
    """(type, name, n, canonical): names joined at ``threshold`` and above; the canonical one is the longest of the most frequent.

    Components are found on typed names by contraction.  One that holds two names of
    likeness 0 (they clash) is split: its links are taken from the likest on, and none that
    would bring a clashing pair together.
    """
    e = entities.groupBy(F.col(kind).alias("type"), F.col(name).alias("name")).agg(F.sum(count).alias("n"))
    ident = lambda n: F.concat_ws("\u0001", "type", n)
    ids = e.withColumn("id", ident("name"))
    scored = stage(pairs(e).select(ident("a").alias("src"), ident("b").alias("dst"), "score"), "likeness")
    comp = stage(components(scored.where(F.col("score") >= threshold)), "entity-components")
    of = lambda end, c: comp.select(F.col("node").alias(end), F.col("component").alias(c))
    inside = scored.where((F.col("score") >= threshold) | (F.col("score") == 0)).join(of("src", "c"), "src").join(of("dst", "c2"), "dst").where("c = c2").drop("c2")
    inside = stage(inside, "inside-components")
    clash = inside.where("score = 0").select("c").distinct()
    part = inside.join(clash, "c", "left_semi").groupBy("c").applyInPandas(_split, "node string, part string")
    x = ids.join(comp, F.col("id") == F.col("node"), "left").drop("node").join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("part", "component", "id"))
    w = Window.partitionBy("type", "c")
    best = F.max(F.struct("n", F.char_length("name").alias("l"), "name")).over(w)
    return x.select("type", "name", "n", best["name"].alias("canonical"))


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a component, likest first, that bring no two clashing names together."""
    root: dict[str, str] = {n: n for n in sorted({*pdf["src"], *pdf["dst"]})}
    held = {n: {n} for n in root}
    far: dict[str, set[str]] = {n: set() for n in root}
    for a, b in pdf.loc[pdf["score"] == 0, ["src", "dst"]].itertuples(index=False):
        far[a].add(b)
        far[b].add(a)
    links = pdf[pdf["score"] > 0].sort_values(["score", "src", "dst"], ascending=[False, True, True])
    for a, b in links[["src", "dst"]].itertuples(index=False):
        x, y = sorted((root[a], root[b]))
        if x == y or any(far[n] & held[y] for n in held[x]):
            continue
        for n in held[y]:
            root[n] = x
        held[x] |= held.pop(y)
    return pd.DataFrame({"node": list(root), "part": [f"{r}\u0002" for r in root.values()]})
