"""What the training-data operators share: staging tables, document keys, components.

Rules that hold for all of them:

* A null ``doc_id`` orders after every other id and is returned as null; a null
  text is an empty one.
* Rows with one ``doc_id`` and one text are told apart nowhere: each comes back,
  with the same result.
* Columns of the input whose names an operator itself returns are replaced; all
  others are left out or passed on untouched, as each docstring says.  Names that
  begin with ``__tm_`` belong to the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import map_arrow, share_code
from ..functions.staging import drop_stage, shared_dir, stage

#: Stands for a null id inside the operators: it orders last.
NULL_ID = 2**63 - 1

def as_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def from_id(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__tm_d id without nulls, __tm_t text without nulls), nothing else."""
    return docs.select(as_id(id_col).alias("__tm_d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__tm_t"))


def map_rows(df: DataFrame, columns: list[str], f: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 256, setup: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``f`` to column lists, ``rows`` at a time, in Python workers over Arrow.

    ``f`` gets and returns columns as Python lists (or Arrow arrays).
    """
    from pyspark.sql.types import StructType

    out_schema = _arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = f({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in ((got[t.name], t) for t in out_schema)], schema=out_schema)

    return map_arrow(df.select(*columns), run, schema)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the links a-b: every value with the smallest value of its component."""
    values, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(values))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            return values, values[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node that has a link: (node long, root long).

    Large-star and small-star rounds (Kiveris and others, 2014), each staged in the
    shared folder.  A round only aggregates and joins on node ids; no component is
    ever gathered in one place, and ``O(log^2 n)`` rounds are enough.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct()
    e = stage(e, "cc")
    for _ in range(max_rounds):
        # large star: each node links its larger neighbours to its smallest neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node links its smaller neighbours and itself to the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.*").where("u <> v").distinct()
        new = stage(small, "cc")
        changed = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        drop_stage(e)
        e = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{table}.parquet")
