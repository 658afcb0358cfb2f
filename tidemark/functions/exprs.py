"""Column expressions that several operators share; all of them stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def flag(c: str | Column) -> Column:
    """An annotation of any type as 0 or 1: what isn't a number above zero is 0."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.coalesce(c.try_cast("double"), F.lit(0.0)) > 0).cast("int")


def annotation(df: DataFrame, name: str) -> Column:
    """The values of an annotation: the column of that name, else its sum, else its mean; none is an error."""
    for c in (name, f"{name}_sum", f"{name}_mean"):
        if c in df.columns:
            return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    raise ValueError(f"there is no {name}, {name}_sum or {name}_mean")


def first_max(columns: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Label of the first column that holds the largest value; null if none is above zero."""
    top = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in columns]) if len(columns) > 1 else F.coalesce(F.col(columns[0]), F.lit(0))
    out = F
    for c, label in zip(columns, labels or columns):
        out = out.when(F.coalesce(F.col(c), F.lit(0)) == top, F.lit(label))
    return F.when(top > 0, out)


def entropy(counts: Column, base: float | None = None) -> Column:
    """Shannon entropy of an array of non-negative weights (nats, or to ``base``); 0 for an empty one."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))
    return F.when(total > 0, h / (math.log(base) if base else 1.0)).otherwise(0.0)


def concentration(counts: Column, k: int) -> Column:
    """1 - H / ln k of an array of k weights; 0 without any weight."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, 1 - entropy(counts) / math.log(k)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    c = F.greatest(c, F.lit(float(low))) if low is not None else c
    return F.least(c, F.lit(float(high))) if high is not None else c


def cohen_h(p: Column, q: Column) -> Column:
    """Effect size of two proportions."""
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def week_end(day: Column) -> Column:
    """The Sunday that ends a day's week."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def week_start(day: Column) -> Column:
    """The Monday that starts a day's week."""
    return F.date_trunc("week", day).cast("date")


def era(year: Column, bounds: Sequence[tuple[int, str]]) -> Column:
    """Label of the last bound that a year has reached; null before the first."""
    return reduce(lambda acc, b: F.when(year >= b[0], b[1]).otherwise(acc), sorted(bounds), F.lit(None).cast("string"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


AGENCIES = ("Reuters", "Canadian Press", "Associated Press", "AFP", "Bloomberg", "Postmedia", "Staff")


def clean_author(name: Column, agencies: Sequence[str] = AGENCIES) -> Column:
    """A byline without agency suffixes, trimmed; null is the empty string."""
    return F.trim(reduce(lambda c, a: F.replace(c, F.lit(", " + a), F.lit("")), agencies, F.coalesce(name, F.lit(""))))


def normal_name(name: Column) -> Column:
    """A name for comparison: lower case, single spaces, letters, digits, hyphens and apostrophes only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9À-ɏ' -]", " "), " +", " "))


def clean_entity(name: Column) -> Column:
    """An entity without punctuation at its ends; "Last, First" becomes "First Last"."""
    edge = F.regexp_replace(F.trim(name), r"^[.,;:!?'\"()\[\]-]+|[.,;:!?'\"()\[\]-]+$", "")
    parts = F.split(edge, ", *")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(edge)


def blocking_keys(name: Column) -> Column:
    """Keys of which two names share one if they may be the same: first and last word, prefix, consonants."""
    n = normal_name(name)
    words = F.split(n, " ")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    bones = F.regexp_replace(n, "[aeiouy ]", "")
    keys = F.array(F.concat(F.lit("f:"), first), F.concat(F.lit("l:"), last), F.concat(F.lit("p:"), F.substring(n, 1, 4)), F.concat(F.lit("c:"), F.substring(bones, 1, 4)))
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) > 3))


def tag_present(tags: Column, tag: str, sep: str = ",") -> Column:
    """Whether a separated list holds a token."""
    return F.coalesce(F.array_contains(F.transform(F.split(tags, sep), lambda t: F.trim(t)), tag), F.lit(False))


def exp_decay(days: Column, half: float) -> Column:
    return F.exp(-F.abs(days) / half)


def gaussian(days: Column, sigma: float) -> Column:
    return F.exp(-F.pow(days / sigma, 2) / 2)
