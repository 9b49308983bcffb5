"""Finished tables fed to the live monitors as they would have arrived."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import live
from .batch import micros


def replay(rows: DataFrame, monitor: Callable[[DataFrame, int, int], DataFrame], slices: int = 3) -> DataFrame:
    """All rows that `monitor(stream, late_ms, quiet_ms)` reports for `rows` (ts, seq, …), read back from its sink.

    The time span is cut into slices, which arrive one after the other as files, each read whole by one run of the query;
    within a slice rows have no order, and every third row arrives a slice late. `late_ms` covers that, so none is too late.
    In the end a row without `seq` moves the watermark beyond everything, and all keys fall silent. State, input and sink
    are in the checkpoint folder; the query runs in a session of its own, the caller's settings stay as they are.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/replay-{uuid.uuid4().hex}"
    own = spark.newSession()
    own.conf.set(*live.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    at = micros(rows, "ts")
    first, last = rows.agg(F.min(at), F.max(at)).first()
    first, last = first or 0, last or 0
    width = (last - first) // slices + 1
    late_ms = 2 * width // 1000 + 1000
    quiet_ms = (last - first) // 1000 + 1000
    arrives = F.floor((at - first) / width) + F.when(F.pmod(F.xxhash64("seq"), F.lit(3)) == 0, 1).otherwise(0)
    end = F.timestamp_micros(F.lit(last + (2 * late_ms + 2 * quiet_ms + 86_400_000) * 1000))
    closing = spark.range(1).select(*[(end if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    for k in range(slices + 2):
        part = rows.filter(arrives == k) if k <= slices else closing
        part.write.mode("append").parquet(f"{folder}/in")
        told = monitor(own.readStream.schema(rows.schema).parquet(f"{folder}/in"), late_ms, quiet_ms)
        (told.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start(f"{folder}/out").awaitTermination())
    return spark.read.schema(told.schema).parquet(f"{folder}/out")
