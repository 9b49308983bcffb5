"""Ordered computations that survive a hot key.

A plain `Window.partitionBy(key)` puts every row of a key into one task. A document, batch, job or
stream may hold a third of all rows, so running values over such keys are computed in two levels:
a window over (key, bucket of the position) and a window over the much smaller per-bucket summary,
whose result is joined back. Buckets come from the position value itself, so the split is
deterministic and survives recomputation. Keys bounded by the size of a sheet of paper (a page, a
line, a table cell) keep the plain window.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BUCKET = 1 << 16


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result once to the checkpoint folder. The helpers below read their input twice,
    so chains of them start from a cut; it is meant for narrow summary rows (one per table, job, frame)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same for whole rows: they are written as compressed columns, of which a reader takes those that it needs."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _with_bucket(df: DataFrame, position: str, width: float) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(position) / F.lit(width)).cast("long"))


def _join_back(local: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "_bucket"]
    right = summary.select(*[F.col(k).alias(f"_r_{k}") for k in names], *[c for c in summary.columns if c not in names])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys],
                  F.col("_bucket") == F.col("_r__bucket"))
    return local.join(right, cond, "left").drop(*[f"_r_{k}" for k in names])


def running(df: DataFrame, keys: list[str], position: str, aggs: dict[str, tuple[str, Column]],
            ties: list[str] | None = None, width: float = BUCKET) -> DataFrame:
    """Inclusive running `sum` / `max` per key in `position` order. Values are columns of `df`."""
    ties = ties or []
    vals = {out: f"_v_{i}" for i, out in enumerate(aggs)}
    base = _with_bucket(df, position, width).select(
        "*", *[value.alias(vals[out]) for out, (_, value) in aggs.items()])
    fn = {"sum": F.sum, "max": F.max}
    w = (Window.partitionBy(*keys, "_bucket").orderBy(position, *ties)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = base.select("*", *[fn[how](vals[out]).over(w).alias(f"_l_{out}") for out, (how, _) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = (base.groupBy(*keys, "_bucket")
               .agg(*[fn[how](vals[out]).alias(f"_s_{out}") for out, (how, _) in aggs.items()])
               .select(*keys, "_bucket", *[fn[how](f"_s_{out}").over(before).alias(f"_p_{out}")
                                           for out, (how, _) in aggs.items()]))
    joined = _join_back(local, summary, keys)
    exprs = []
    for out, (how, _) in aggs.items():
        here, prior = F.col(f"_l_{out}"), F.col(f"_p_{out}")
        exprs.append((F.coalesce(prior, F.lit(0)) + here if how == "sum"
                      else F.when(prior.isNull() | (here > prior), here).otherwise(prior)).alias(out))
    return joined.select(*df.columns, *exprs)


def row_number(df: DataFrame, keys: list[str], position: str, out: str,
               ties: list[str] | None = None, width: float = BUCKET) -> DataFrame:
    """1-based number of the row within its key, in `position` order."""
    return running(df, keys, position, {out: ("sum", F.lit(1).cast("long"))}, ties, width)


def neighbour(df: DataFrame, keys: list[str], position: str, out: str, value: Column,
              ties: list[str] | None = None, width: float = BUCKET, ahead: bool = False) -> DataFrame:
    """`value` of the previous (or next) row of the key; null at the end."""
    ties = ties or []
    base = _with_bucket(df, position, width).select("*", F.struct(value.alias("v")).alias("_v"))
    order = [position, *ties]
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    step = F.lead if ahead else F.lag
    local = base.withColumn("_l", step("_v").over(w))
    edge = F.min_by if ahead else F.max_by
    wk = Window.partitionBy(*keys).orderBy("_bucket")
    summary = (base.groupBy(*keys, "_bucket").agg(edge("_v", F.struct(*order)).alias("_e"))
               .select(*keys, "_bucket", step("_e").over(wk).alias("_p")))
    joined = _join_back(local, summary, keys)
    return joined.select(*df.columns, F.coalesce("_l", "_p")["v"].alias(out))


def with_group_total(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach per-key aggregates by a pre-aggregated join instead of a whole-key window."""
    totals = df.groupBy(*keys).agg(*aggs)
    return df.join(totals, keys)


def islands(df: DataFrame, keys: list[str], order: list[Column | str], start: Column, out: str) -> DataFrame:
    """Number runs of rows within a small (page- or line-sized) key; `start` opens a new run."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.when(start, 1).otherwise(0)).over(w))
