"""Structured Streaming forms of the monitors.

Rows may come in any order within `late` of the newest one; what is older is dropped by the watermark, and rows without a
time are left out. State holds one small record for each key, and for monitors whose rule depends on the order a buffer of
the rows that the watermark has not passed. A key that stays silent for `quiet` leaves the state. Monitors that report
changes append one row for each; `latest` gives the last one of every key. A row without `seq` moves the watermark on and
does nothing else.

The keyed monitors need a state store with timers (`ROCKSDB` in the session that starts the query).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import batch

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HOUR = 3_600_000


def _timed(df: DataFrame) -> DataFrame:
    """Event time as watermarks need it (zoned)."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")


def _keyed(df: DataFrame, late: str, key: str, *columns: str) -> DataFrame:
    """(key, ts, at_us, seq, columns) under a watermark."""
    return _timed(df).withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at_us"), F.col("seq").cast("long").alias("seq"), *columns)


def _stateful(src: DataFrame, key: str, processor: StatefulProcessor, out: list[tuple[str, str]]) -> DataFrame:
    """`processor` over the rows of every key: (key, `out`). The key travels as text that is never null, so that rows without
    one are a key like the others."""
    kind = dict(src.dtypes)[key]
    name = F.when(F.col(key).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    told = src.withColumn("_key", name).drop(key).groupBy("_key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=", ".join(["_key string", *(f"{c} {t}" for c, t in out)]),
        outputMode="Append", timeMode="EventTime")
    back = F.when(F.col("_key") != "-", F.substr("_key", F.lit(2))).cast(kind)
    return told.select(back.alias(key), *[c for c, _ in out])


def _plain(v, kind: str):
    """A value as the state store takes it."""
    if v is None or isinstance(v, float) and np.isnan(v):
        return None
    if kind.startswith("array<"):
        return [_plain(x, kind[6:-1]) for x in v]
    return int(v) if kind in ("int", "long", "bigint") else v.item() if isinstance(v, np.generic) else v


class _Quiet:
    """A timer that is moved on with every sign of life of the key."""

    def __init__(self, handle: StatefulProcessorHandle, quiet_ms: int):
        self.handle, self.quiet_ms = handle, quiet_ms
        self.until = handle.getValueState("until", "ms long")

    def alive(self, at_ms: int) -> None:
        due = at_ms + self.quiet_ms
        before = self.until.get()[0] if self.until.exists() else None
        if before is not None and before >= due:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.until.update((due,))
        self.handle.registerTimer(due)

    def over(self, watermark_ms: int) -> bool:
        if self.until.exists() and self.until.get()[0] <= watermark_ms:
            self.until.clear()
            return True
        return False


class _Last(StatefulProcessor):
    """The values of the newest row by (time, seq). One row is reported for each micro-batch that brings a newer one."""

    def __init__(self, values: list[str], types: list[str], quiet_ms: int):
        self.values, self.types, self.quiet_ms = values, types, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(["at_us long", "seq long", *(f"{v} {t}" for v, t in zip(self.values, self.types))]))
        self.quiet = _Quiet(handle, self.quiet_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = newest = tuple(self.last.get()) if self.last.exists() else None
        for frame in rows:
            frame = frame[frame["seq"].notna()]
            if len(frame):
                best = frame.sort_values(["at_us", "seq"]).iloc[-1]
                here = (int(best["at_us"]), int(best["seq"]), *(_plain(best[v], t) for v, t in zip(self.values, self.types)))
                newest = here if newest is None or here[:2] > newest[:2] else newest
        if newest != before:
            self.last.update(newest)
            self.quiet.alive(newest[0] // 1000)
            yield self._frame([(key[0], *newest)])
        else:
            yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.quiet.over(timerValues.getCurrentWatermarkInMs()):
            self.last.clear()
        yield self._frame([])

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_key", "at_us", "seq", *self.values], dtype=object)

    def close(self) -> None:
        pass


def _last(df: DataFrame, key: str, values: list[str], late: str, quiet_ms: int) -> DataFrame:
    src = _keyed(df, late, key, *values)
    kinds = dict(src.dtypes)
    types = [kinds[v] for v in values]
    return _stateful(src, key, _Last(values, types, quiet_ms), [("at_us", "long"), ("seq", "long"), *zip(values, types)])


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The last report of every key: what the batch form gives for the rows so far."""
    values = [c for c in changes.columns if c not in (key, "at_us", "seq")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("at_us", "seq")).alias("_l")).select(key, "_l.*")


def progress_latest(reports: DataFrame, late: str = "1 hour", quiet_ms: int = 24 * HOUR) -> DataFrame:
    """Changes (path, at_us, seq, loaded, total); feed `batch.overall_progress` with the `latest` of them."""
    return _last(reports, "path", ["loaded", "total"], late, quiet_ms)


def job_status(events: DataFrame, late: str = "1 hour", quiet_ms: int = 24 * HOUR) -> DataFrame:
    """Changes (job, at_us, seq, status, since)."""
    return _last(events, "job", ["status"], late, quiet_ms).withColumn("since", F.timestamp_micros("at_us"))


class _RunningBytes(StatefulProcessor):
    """Running bytes of a path from the bytes of its closed windows, which come in order. The newest report is held back
    until another one follows, or the path stays silent and the report is the final one."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "win long, loaded long")
        self.quiet = _Quiet(handle, self.quiet_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        closed, out, end = [], [], 0
        for frame in rows:  # a window is one row, whatever its chunks
            closed += zip(frame["win"].tolist(), frame["bytes"].tolist(), frame["end_ms"].tolist())
        for win, n, end in sorted(closed):
            if held is not None:
                out.append((key[0], *held, False))
            held = (int(win), (held[1] if held else 0) + int(n))
        if closed:
            self.held.update(held)
            self.quiet.alive(int(end))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.quiet.over(timerValues.getCurrentWatermarkInMs()) and self.held.exists():
            out.append((key[0], *self.held.get(), True))
            self.held.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_key", "win", "loaded", "final"], dtype=object)

    def close(self) -> None:
        pass


def throttled_bytes(chunks: DataFrame, window_ms: int = 250, late: str = "10 seconds", quiet_ms: int = HOUR) -> DataFrame:
    """Running bytes per path (path, win, loaded, final), reported once for each window that holds any, when the watermark
    has passed the next one; the last report before `quiet_ms` of silence is final, and a path that goes on begins anew."""
    sums = (_timed(chunks).withWatermark("ts", late).groupBy("path", F.window("ts", f"{window_ms} milliseconds").alias("w"))
            .agg(F.sum("loaded").alias("bytes")))
    closed = sums.select("path", F.window_time("w").alias("closed"), F.unix_millis("w.end").alias("end_ms"),
                         F.floor(F.unix_millis("w.start") / window_ms).alias("win"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return _stateful(closed, "path", _RunningBytes(quiet_ms), [("win", "long"), ("loaded", "long"), ("final", "boolean")])


def match_replies(requests: DataFrame, replies: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests with their replies; a request without a reply in time comes out once, with nulls (left outer)."""
    req = _timed(requests).select(F.col("id").alias("req_id"), F.col("ts").alias("asked")).withWatermark("asked", late)
    rep = _timed(replies).select("id", F.col("ts").alias("answered"), "kind", "value", "code").withWatermark("answered", late)
    cond = F.expr(f"req_id = id and answered >= asked and answered <= asked + interval {within}")
    return req.join(rep, cond, "leftOuter").select("req_id", "asked", "answered", "kind", "value", "code")


class _Stall(StatefulProcessor):
    """Remember the last heartbeat; a timer fires when the watermark passes its limit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, at_ms long, due_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        state = self.last.get() if self.last.exists() else None
        # rows of one key and micro-batch; the source's rate limit bounds them
        beats = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        for seq, at, due in zip(beats["seq"], beats["at_ms"], beats["due_ms"]):
            if state is not None:
                if at <= state[1]:
                    continue
                if at > state[2]:
                    out.append((key[0], int(state[0]), (at - state[1]) / 1000.0))
                self.handle.deleteTimer(int(state[2]) + 1)
            state = (int(seq), int(at), int(due))
        if state is not None:
            self.last.update(state)
            self.handle.registerTimer(state[2] + 1)
        yield pd.DataFrame(out, columns=["_key", "seq", "silent_sec"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        out = []
        if state is not None and expiredTimerInfo.getExpiryTimeInMs() > state[2]:
            out.append((key[0], int(state[0]), (timerValues.getCurrentWatermarkInMs() - state[1]) / 1000.0))
            self.last.clear()
        yield pd.DataFrame(out, columns=["_key", "seq", "silent_sec"])

    def close(self) -> None:
        pass


def stall_detect(beats: DataFrame, scale: float = 1.0, late: str = "10 seconds") -> DataFrame:
    """Alerts (job, seq of the last heartbeat, seconds of silence) as event time passes the limit."""
    limit = batch.stall_limit(F.col("phase"), F.col("percent"), F.col("size_mb")) * scale
    at = F.unix_millis("ts")
    b = _timed(beats).withWatermark("ts", late).select("job", "seq", "ts", at.alias("at_ms"), (at + F.floor(limit * 1000)).alias("due_ms"))
    return _stateful(b, "job", _Stall(), [("seq", "long"), ("silent_sec", "double")])


BLOCK = 4096


class _InOrder(StatefulProcessor):
    """Hands the rows of a key to `step` in the order of (time, seq), whatever order they come in.

    Rows wait until the watermark has passed their slot of `slot_ms`; then they are sorted and taken one after the other.
    Nothing of a slot can come after it was taken: it would be older than the watermark. What a micro-batch brings waits in
    blocks of at most BLOCK rows, each sorted, and one timer stands at the end of the earliest slot: the calls to the state
    grow with micro-batches and blocks, not with slots. Blocks are merged as their time comes, so a call holds a
    chunk of input or the blocks of one time, one for each micro-batch that still waits.
    """

    values: list[tuple[str, str]] = []  # columns of a row and their types
    state = ""  # what is kept between rows
    out: list[tuple[str, str]] = []  # columns of a reported row behind the key

    def __init__(self, slot_ms: int, quiet_ms: int):
        self.slot_ms, self.quiet_ms = slot_ms, quiet_ms

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, at_us: int, seq: int, *values) -> tuple[tuple, list[tuple]]:
        """The state behind a row, and the rows it reports."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)
        self.waiting = handle.getMapState("waiting", "block long", ", ".join(
            ["at_us array<long>", "seq array<long>", *(f"{v} array<{t}>" for v, t in self.values)]))
        self.blocks = handle.getValueState("blocks", "due long, next long, block array<long>, first_us array<long>")
        self.quiet = _Quiet(handle, self.quiet_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["at_us", "seq", *(v for v, _ in self.values)]
        state, held = None, None
        for frame in rows:
            frame = frame[frame["seq"].notna()][columns]
            if len(frame):
                state = state or self._blocks()
                held = frame if held is None else pd.concat([held, frame])
                if len(held) >= BLOCK:
                    self._wait(state, held)
                    held = None
        if held is not None:
            self._wait(state, held)
        if state is not None:
            self._set_timer(state)
        yield self._frame([])

    def _blocks(self) -> dict:
        if not self.blocks.exists():
            return {"due": None, "next": 0, "first": {}}
        due, following, block, first = self.blocks.get()
        return {"due": due, "next": following, "first": dict(zip(block, first))}

    def _wait(self, state: dict, frame: pd.DataFrame) -> None:
        frame = frame.sort_values(["at_us", "seq"], kind="stable")
        for at in range(0, len(frame), BLOCK):
            self._put(state, [[_plain(v, t) for v in frame[c].iloc[at:at + BLOCK]] for c, t in [("at_us", "long"), ("seq", "long"), *self.values]])

    def _put(self, state: dict, columns: list[list]) -> None:
        self.waiting.updateValue((state["next"],), tuple(columns))
        state["first"][state["next"]] = columns[0][0]
        state["next"] += 1

    def _set_timer(self, state: dict) -> None:
        """One timer, at the end of the earliest slot that holds a row."""
        first = state["first"]
        due = (min(first.values()) // (self.slot_ms * 1000) + 1) * self.slot_ms if first else None
        if state["due"] is not None and state["due"] != due:
            self.handle.deleteTimer(state["due"])
        if due is not None and state["due"] != due:
            self.handle.registerTimer(due)
        state["due"] = due
        if first:
            self.blocks.update((due, state["next"], list(first), list(first.values())))
        else:
            self.blocks.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        blocks = self._blocks()
        limit = now // self.slot_ms * self.slot_ms * 1000  # the end of the last slot that the watermark has passed
        if blocks["due"] is not None and min(blocks["first"].values()) < limit:
            state = tuple(self.kept.get()) if self.kept.exists() else self.begin()
            found, newest = [], None
            for at_us, _, seq, *values in self._due(blocks, limit):
                state, more = self.step(state, at_us, seq, *values)
                found += [(key[0], *m) for m in more]
                newest = at_us
                if len(found) >= BLOCK:
                    yield self._frame(found)
                    found = []
            self.kept.update(state)
            if blocks["due"] <= now:  # its timer has fired
                blocks["due"] = None
            self._set_timer(blocks)
            self.quiet.alive(newest // 1000)
            yield self._frame(found)
        if not blocks["first"] and self.quiet.over(now):
            self.kept.clear()
        yield self._frame([])

    def _due(self, blocks: dict, limit: int) -> Iterator[tuple]:
        """The waiting rows before `limit` in order. A block is read when its first row comes and leaves the state; what it
        holds from `limit` on waits again."""
        rows: list[tuple] = []
        later = sorted((first, block) for block, first in blocks["first"].items() if first < limit)
        rest: list[list] = []
        for at, (first, block) in enumerate(later):
            columns = self.waiting.getValue((block,))
            self.waiting.removeKey((block,))
            del blocks["first"][block]
            columns = [list(c) for c in columns]
            cut = bisect.bisect_left(columns[0], limit)
            if cut < len(columns[0]):
                rest.append([c[cut:] for c in columns])
            for row in zip(columns[0][:cut], range(cut), *(c[:cut] for c in columns[1:])):
                rows.append((row[0], (row[2], block, row[1]), *row[2:]))
            until = later[at + 1][0] if at + 1 < len(later) else limit
            rows.sort(key=lambda r: r[:2])
            n = bisect.bisect_left(rows, until, key=lambda r: r[0])
            yield from rows[:n]
            rows = rows[n:]
        for columns in rest:
            self._put(blocks, columns)

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["_key", *(c for c, _ in self.out)], dtype=object)

    def close(self) -> None:
        pass


def _in_order(src: DataFrame, key: str, processor: _InOrder) -> DataFrame:
    return _stateful(src, key, processor, processor.out)


class _Frames(_InOrder):
    """The frame before and the frame whose result is shown."""

    values = [("px", "array<int>")]
    state = "px array<int>, result_of long, skipped long"
    out = [("frame_no", "long"), ("same", "boolean"), ("result_of", "long"), ("skipped", "long")]

    def begin(self):
        return (None, None, 0)

    def step(self, state, at_us, seq, px):
        before, shown, skipped = state
        same = before is not None and len(before) == len(px) and bool((np.abs(np.asarray(before, np.int64) - np.asarray(px, np.int64)) <= 2).all())
        state = (px, shown if same else seq, skipped + same)
        return state, [(seq, same, *state[1:])]


def stream_frame_dedupe(frames: DataFrame, late: str = "10 seconds", slot_ms: int = 10_000, quiet_ms: int = HOUR) -> DataFrame:
    """Live form of same_frame + reuse_results over frames (stream, frame_no, ts, px): (stream, frame_no, same, result_of,
    skipped) of every frame, in the order of time and number."""
    src = _keyed(frames.withColumn("seq", F.col("frame_no")), late, "stream", "px")
    return _in_order(src, "stream", _Frames(slot_ms, quiet_ms))


class _Retry(_InOrder):
    values = [("kind", "string")]
    state = "attempts int, status string"
    out = [("at_us", "long"), ("seq", "long"), ("attempts", "int"), ("status", "string")]

    def __init__(self, slot_ms: int, quiet_ms: int, retries: int):
        super().__init__(slot_ms, quiet_ms)
        self.retries = retries

    def begin(self):
        return (0, "running")

    def step(self, state, at_us, seq, kind):
        attempts, status = now = max(state[0], 1), state[1]
        if status == "running":
            if kind == "stall" and attempts < self.retries:
                now = (attempts + 1, status)
            elif kind in ("stall", "error", "done"):
                now = (attempts, "done" if kind == "done" else "failed")
        return now, [(at_us, seq, *now)] if now != state else []


def retry_state(events: DataFrame, retries: int = 3, late: str = "1 hour", slot_ms: int = HOUR, quiet_ms: int = 24 * HOUR) -> DataFrame:
    """Changes (job, at_us, seq, attempts, status): a job's first event and every event that starts another attempt or ends it."""
    return _in_order(_keyed(events, late, "job", "kind"), "job", _Retry(slot_ms, quiet_ms, retries))


class _Stage(_InOrder):
    values = [("mark", "int"), ("line", "string")]
    state = "stage int"
    out = [("seq", "long"), ("stage", "int"), ("line", "string")]

    def begin(self):
        return (0,)

    def step(self, state, at_us, seq, mark, line):
        stage = state[0] if mark is None else int(mark)
        return (stage,), [(seq, stage, line)] if line is not None else []


def stage_progress(logs: DataFrame, late: str = "1 hour", slot_ms: int = HOUR, quiet_ms: int = 24 * HOUR) -> DataFrame:
    """(job, seq, stage, progress, ignored_page) of every page line under the stage announced before it, and the pages given up."""
    line = F.col("line")
    told = batch.line_progress(line, F.lit(0)).isNotNull() | batch.ignored_page(line).isNotNull()
    src = _keyed(logs.select("job", "ts", "seq", batch.line_stage(line).alias("mark"), F.when(told, line).alias("line"))
                 .filter("mark is not null or line is not null or seq is null"), late, "job", "mark", "line")
    staged = _in_order(src, "job", _Stage(slot_ms, quiet_ms))
    return staged.select("job", "seq", "stage", batch.line_progress(line, F.col("stage")).alias("progress"), batch.ignored_page(line).alias("ignored_page"))
