"""Document quality by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, map_rows, read

HASHED = 256
_SHAPES = 15
#: Bytes that are compressed at a time.
_PIECE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Shape features of a whole text and a hashed profile of its word-final and word-initial bytes."""
    text = text or ""
    out = np.zeros(_SHAPES + HASHED, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        out[0] = 1
        return out
    n, nw = len(raw), len(words)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    ends = int(((raw == 46) | (raw == 44) | (raw == 63) | (raw == 59) | (raw == 58)).sum())
    other = int(((raw > 32) & (raw < 127)).sum()) - upper - lower - digits - ends
    again = sum(map(str.__eq__, words[1:], words))
    lines = text.split("\n")
    out[:_SHAPES] = (
        0,
        np.log1p(n) / 10,
        np.log1p(nw) / 10,
        upper / n,
        digits / n,
        ends / n,
        other / n,
        other / nw,
        min(n / nw, 40) / 10,
        again / nw,
        len(set(words)) / nw,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
        _compressed(raw) / n,
        sum(map(str.isupper, words)) / nw,
    )
    # byte pairs inside and at the ends of words, hashed; frequencies
    pairs = (raw[:-1].astype(np.uint32) * 257 + raw[1:]) * np.uint32(2654435761) >> np.uint32(24)
    if len(pairs):
        out[_SHAPES:] = np.sqrt(np.bincount(pairs, minlength=HASHED)[:HASHED] / len(pairs))
    return out


def _compressed(raw: np.ndarray) -> int:
    """Bytes that the whole text takes when compressed, piece by piece."""
    c = zlib.compressobj(1)
    return sum(len(c.compress(raw[at : at + _PIECE])) for at in range(0, len(raw), _PIECE)) + len(c.flush())


@dataclass
class Model:
    """A standardised one-hidden-layer network and the prior that it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = _hidden((x - self.mean) / self.scale, self.layers)
        return h @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _hidden(z: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    return np.maximum(np.clip(z, -6, 6) @ layers[0] + layers[1], 0)


def indifferent() -> Model:
    """A model that scores every text 1 (to rounding)."""
    dim = _SHAPES + HASHED
    return Model(np.zeros(dim), np.ones(dim), [np.zeros((dim, 1)), np.zeros(1), np.zeros(1), np.array(30.0)], 1.0)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 200, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled: best-bin estimate over one-dimensional scores.

    For each threshold, the unlabelled mass above it divided by the positive mass
    above it bounds the prior from above; the smallest such ratio (with a margin for
    the size of the bins) is the estimate.  Garg and others (2021).
    """
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    at = p[np.unique(np.linspace(min(least, len(p)) - 1, len(p) - 1, 400).astype(int))]
    qp = np.searchsorted(-p, -at, "right") / len(p)
    qu = np.searchsorted(-u, -at, "right") / len(u)
    margin = np.sqrt(np.log(4 / confidence) / 2 / len(p)) + np.sqrt(np.log(4 / confidence) / 2 / len(u))
    best = int(np.argmin(qu / qp + margin / qp))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 60, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> Model:
    """Minimise the non-negative unbiased risk (Kiryo and others, 2017) with the logistic loss.

    R = prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second
    part turns negative, the step climbs it instead, as in the paper.
    """
    rng = np.random.default_rng(seed)
    mean = unlabelled.mean(0) if mean is None else mean
    scale = unlabelled.std(0) + 1e-3 if scale is None else scale
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    dim = p.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, np.sqrt(1 / hidden), hidden).astype(np.float32), np.zeros((), np.float32)]
    m, v, step = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    steps = max(1, -(-max(len(p), len(u)) // batch))
    for epoch in range(epochs):
        for _ in range(steps):
            xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
            x = np.concatenate([xp, xu])
            h = _hidden(x, layers)
            g = h @ layers[2] + layers[3]
            gp, gu = g[:batch], g[batch:]
            soft = lambda a: np.logaddexp(0, a)
            rest = soft(gu).mean() - prior * soft(gp).mean()
            if rest >= 0:
                d = np.concatenate([(-prior * sig(-gp) - prior * sig(gp)) / batch, sig(gu) / batch])
            else:
                d = -np.concatenate([-prior * sig(gp) / batch, sig(gu) / batch])
            dh = np.outer(d, layers[2]) * (h > 0)
            grads = [np.clip(x, -6, 6).T @ dh, dh.sum(0), h.T @ d, d.sum()]
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-5
            for k, gr in enumerate(grads):
                gr = gr + decay * layers[k] if k in (0, 2) else gr
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr**2
                layers[k] = (layers[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, layers, prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 4 is 2: their labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 8000, max_unlabelled: int = 12000, seed: str = "pu") -> Model:
    """Fit on trusted positives (label 1, not held out) and unlabelled web text.

    Both samples are bounded: the ``max_positive`` positives and ``max_unlabelled``
    documents of the smallest hash of id and seed (of all documents; their labels are
    not looked at).  Ids that are labelled more than once count if all labels are 1; of
    several texts of an id the one of the smallest hash is taken.
    The class prior is estimated in two rounds: a first fit scores both samples
    (positives of the other half), and the best-bin estimate of these scores is the
    prior of the final fit.  Null ids and labels are left out of the samples.  Without
    a positive or a document there is no evidence against any text: the model then
    scores every text 1.
    """
    rank = F.xxhash64(F.lit(seed), F.col("d"))
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("d")).agg(F.min(label_col).alias("y")).where("y = 1")
    good = good.join(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d")), "d", "left_semi")
    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"))
    pos = [r.d for r in good.orderBy(rank, "d").limit(max_positive).collect()]
    unl = [r.d for r in some.orderBy(rank, "d").limit(max_unlabelled).collect()]
    if not pos or not unl:
        return indifferent()
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(d,) for d in sorted({*pos, *unl})], "d long")  # at most the sum of both bounds
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).join(F.broadcast(wanted), "d")
    one = texts.groupBy("d").agg(F.min("h").alias("h"))
    texts = texts.join(F.broadcast(one), ["d", "h"]).dropDuplicates(["d"])  # a row for each wanted id

    def rows(c):
        return {"d": c["d"], "x": [features(t).tobytes() for t in c["t"]]}

    at = {r.d: np.frombuffer(bytes(r.x), np.float32) for r in map_rows(texts, ["d", "t"], rows, "d long, x binary").collect()}
    p, u = np.array([at[d] for d in pos]), np.array([at[d] for d in unl])
    if len(p) < 8:
        return fit_pu(p, u, 0.5)
    first = fit_pu(p[::2], u, 0.7, epochs=20)
    prior = estimate_prior(first.logit(p[1::2]), first.logit(u), least=min(200, max(1, len(p) // 8)))
    return fit_pu(p, u, prior)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) of each whole text.

    Null and empty texts are scored like any other, by a feature of their own.
    """
    docs = docs.drop("score")
    schema = StructType(docs.schema.fields + StructType.fromDDL("score double").fields)
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                x = np.array([features(t) for t in part.column(at).to_pylist()], np.float32).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(x).astype(float))], schema=arrow)

    return map_arrow(docs, run, schema)


THRESHOLD = 0.7


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score reaches ``threshold``)."""
    model = train(docs, labels, id_col, text_col, **options)
    return score_quality(docs, model, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = classify_quality(docs, read(spark, sf_dir, "labels"))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")
