"""Helpers the operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def worker_cache(key, build: Callable):
    """What `build()` returns, made once for each Python worker process and kept between its tasks."""
    store = sys.modules.setdefault("_quiremill_worker", types.ModuleType("_quiremill_worker")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def whole_text(c: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder: cuts the lineage of a table that is read several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared checkpoint folder, for tables and files between steps."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use."""
    while name in df.columns:
        name += "_"
    return name


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def map_arrow(df: DataFrame, work: Callable, ddl: str, rows: int = 256) -> DataFrame:
    """`work` turns an Arrow record batch of at most `rows` rows into rows of `ddl`, given as a dict of columns. Spark
    bounds a batch by its bytes; the slices bound what Python objects hold at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out.values(), target)], schema=target)

    return df.mapInArrow(run, ddl)
