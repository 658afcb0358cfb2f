"""Tables written to the folder that all executors share, where lineage is to end."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made, but only for a master in one
    process: executors elsewhere would each write to a disk of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _roots[app] = f"{base.rstrip('/')}/stages-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and its folder can't be removed through it
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends there.

    Every reader sees one result, whatever executors are lost in between.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tm_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    if path := getattr(df, "_tm_path", None):
        _remove(df.sparkSession, path)
