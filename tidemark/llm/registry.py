"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, line_dedup, packing, quality, quotes, simhash, suffix_dedup, surrogates, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_surrogates": surrogates.op1_surrogates,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_packing": packing.op6_packing,
        "op7_quotes": quotes.op7_quotes,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_token_store": token_store.op10_token_store,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.OP4_SQL, "op5_decontamination": decontaminate.OP5_SQL}
