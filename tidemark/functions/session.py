"""What a session's Python workers need."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_code(spark: SparkSession) -> SparkSession:
    """Let workers that start from now on import this package from where the driver has it.

    On a cluster whose nodes don't share that folder the package is shipped with
    ``--py-files``; this does no harm there.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [_ROOT, *paths] if p)
    return spark


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with workers that find this package."""
    share_code(df.sparkSession)
    return df.mapInArrow(run, schema)
