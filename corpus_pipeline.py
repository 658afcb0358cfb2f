"""A training corpus from raw documents: five stages, each a whole-table operator.

``STAGES`` are applied in order; each gets what the one before it kept.  All but the
last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, packing, quality, simhash, tokens
from tidemark.llm.common import read, stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    names = docs.columns
    marked = docs.select(F.struct(*names).alias("__tm_r"), F.col("doc_id"), F.col("text"))
    scored = quality.classify_quality(marked, read(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select("__tm_r.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that other documents of a smaller id hold; lengths follow the new texts."""
    names = docs.columns
    got = line_dedup.drop_shared_lines(docs.select("doc_id", "text", F.struct(*names).alias("__tm_r")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return got.select(*[new.get(c, F.col(f"__tm_r.{c}")) for c in names])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokens.default_path())


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_near),
    ("decontamination", decontaminate_documents),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
