"""Progress, heartbeat and request streams over finished tables. Each has a streaming form in `live`.

A job, path or stream may hold a third of all events, so running values use the two-level helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered

MICROS = 1_000_000
DAY = 86_400 * MICROS


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a time zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts))
    return F.unix_micros(ts)


def progress_latest(reports: DataFrame) -> DataFrame:
    """Last (loaded, total) per path."""
    last = reports.groupBy("path").agg(F.max_by(F.struct("loaded", "total"), F.struct("ts", "seq")).alias("_l"))
    return last.select("path", "_l.*")


def overall_progress(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Loaded part of all paths that know their size; null when none does."""
    known = F.col("total") > 0
    return latest.groupBy(*keys).agg((F.sum(F.when(known, F.col("loaded"))) / F.sum(F.when(known, F.col("total")))).alias("part"))


def throttled_bytes(chunks: DataFrame, window_ms: int = 250, width: float | None = None) -> DataFrame:
    """Running bytes per path, reported once per window, the last report marked final."""
    step = window_ms * 1000
    per = (chunks.select("path", F.floor(micros(chunks, "ts") / step).alias("win"), "loaded")
           .groupBy("path", "win").agg(F.sum("loaded").alias("_b")))
    per = ordered.cut(per)
    run = ordered.running(per, ["path"], "win", {"loaded": ("sum", F.col("_b"))}, width=width or ordered.BUCKET)
    last = per.groupBy(F.col("path").alias("_path")).agg(F.max("win").alias("_last"))
    return (run.join(last, F.col("path").eqNullSafe(F.col("_path")))
            .select("path", "win", "loaded", (F.col("win") == F.col("_last")).alias("final")))


def stall_limit(phase: Column, percent: Column, size_mb: Column) -> Column:
    """Seconds without a sign of life that count as a stall."""
    return (F.when(phase == "load", F.lit(60.0)).when(percent < 50, F.lit(20.0) + size_mb * 10.0).otherwise(F.lit(600.0)))


def stall_detect(beats: DataFrame, scale: float = 1.0, width: float = DAY, as_of: Column | None = None) -> DataFrame:
    """Heartbeats followed by silence beyond their limit. Needs job, seq, ts, phase, percent, size_mb. With `as_of`, the
    time of looking, the silence behind a job's last heartbeat counts as well."""
    b = beats.withColumn("_us", micros(beats, "ts"))
    nxt = ordered.neighbour(b, ["job"], "_us", "_next", F.col("_us"), ties=["seq"], width=width, ahead=True)
    limit = stall_limit(F.col("phase"), F.col("percent"), F.col("size_mb")) * scale
    until = F.coalesce("_next", F.unix_micros(as_of.cast("timestamp"))) if as_of is not None else F.col("_next")
    silent = (until - F.col("_us")) / MICROS
    return nxt.withColumn("silent_sec", silent).filter(F.col("silent_sec") > limit).select("job", "seq", "ts", "silent_sec")


def retry_state(events: DataFrame, retries: int = 3) -> DataFrame:
    """Attempts and outcome of each job from `kind` (stall / error / done / beat): a stall starts another attempt
    until the last one, an error or success ends the job. Only the first `retries` stalls of a job matter; the
    group limit keeps them before the shuffle."""
    w = Window.partitionBy("job").orderBy("seq")
    first = (events.filter("kind = 'stall'").select("job", "seq").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= retries)
             .groupBy("job").agg(F.array_sort(F.collect_list("seq")).alias("_stalls")))
    ends = events.groupBy("job").agg(F.min(F.when(F.col("kind").isin("error", "done"), F.struct("seq", "kind"))).alias("_end"))
    j = ends.join(first, "job", "left").withColumn("_last", F.get("_stalls", F.lit(retries - 1)))
    gave_up = F.col("_last").isNotNull() & (F.col("_end").isNull() | (F.col("_last") < F.col("_end.seq")))
    j = j.withColumn("_stop", F.when(gave_up, F.col("_last")).otherwise(F.col("_end.seq")))
    before = F.size(F.filter(F.coalesce("_stalls", F.expr("cast(array() as array<bigint>)")), lambda s: F.col("_stop").isNull() | (s < F.col("_stop"))))
    status = F.when(gave_up | (F.col("_end.kind") == "error"), "failed").when(F.col("_end.kind") == "done", "done").otherwise("running")
    return j.select("job", (before + 1).alias("attempts"), status.alias("status"))


def job_status(events: DataFrame) -> DataFrame:
    """Last status of each file."""
    return events.groupBy("job").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("since"))


def match_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """State of each request from the replies that carry its id: the first done / error ends it, progress counts before that."""
    j = requests.select("id", F.col("ts").alias("_asked")).join(
        replies.select("id", F.col("ts").alias("_ts"), "kind", "value", "code"), "id", "left").withColumn("_late", F.col("_ts") < F.col("_asked"))
    ok = ~F.coalesce("_late", F.lit(False))
    end = F.when(ok & F.col("kind").isin("done", "error"), F.struct(F.col("_ts").alias("ts"), "kind", "code"))
    per = j.groupBy("id").agg(F.min(end).alias("_end"))
    prog = (j.filter(ok & (F.col("kind") == "progress")).join(per, "id").filter(F.col("_end").isNull() | (F.col("_ts") < F.col("_end.ts")))
            .groupBy("id").agg(F.max("value").alias("progress"), F.count("*").alias("n_progress")))
    return per.join(prog, "id", "left").select(
        "id", F.coalesce("_end.kind", F.lit("pending")).alias("status"), F.coalesce(F.col("_end.code") == "load", F.lit(False)).alias("reset_worker"),
        "progress", F.coalesce("n_progress", F.lit(0)).alias("n_progress"))


_PAGE_LINE = r"^\((\d+)/(\d+)\) Page"


def line_stage(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("[3/4]")), 3).when(F.contains(line, F.lit("[4/4]")), 4)


def line_progress(line: Column, stage: Column) -> Column:
    done, total = (F.nullif(F.regexp_extract(line, _PAGE_LINE, i), F.lit("")).cast("double") for i in (1, 2))
    part = F.try_divide(done - 1, total)
    return F.when(stage == 3, part * 0.85).otherwise(F.lit(0.85) + part * 0.15)


def ignored_page(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^Ignore page (\d+)", 1), F.lit("")).cast("int")


def stage_progress(logs: DataFrame, width: float = ordered.BUCKET) -> DataFrame:
    """Progress of every page line under the stage last announced, and the pages given up."""
    mark = F.when(line_stage(F.col("line")).isNotNull(), F.struct("seq", line_stage(F.col("line")).alias("stage")))
    r = ordered.running(logs, ["job"], "seq", {"_m": ("max", mark)}, width=width)
    stage = F.coalesce(F.col("_m.stage"), F.lit(0))
    out = r.select("job", "seq", stage.alias("stage"), line_progress(F.col("line"), stage).alias("progress"), ignored_page(F.col("line")).alias("ignored_page"))
    return out.filter("progress is not null or ignored_page is not null")
