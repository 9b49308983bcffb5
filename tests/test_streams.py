"""Live forms against their batch twins: the same rows, fed file by file."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quiremill.plans.queries import QUERIES
from quiremill.sources import views as V
from quiremill.streaming import batch, live

FOLDER = "/root/testdata/sf0.001"


def feed(spark, df, tmp_path, order, parts=3, fields=None):
    """Write `df` as a few files in `order` and read them back one file per trigger."""
    path = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame([], df.schema).write.parquet(path)
    total = df.count()
    rows = df.orderBy(order).collect()
    step = -(-total // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, mode):
    name = "q" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_progress_and_status(spark, tmp_path):
    p = V.progress(spark, FOLDER)
    got = run(spark, live.progress_latest(feed(spark, p, tmp_path, "ts")), "append")
    assert rows(live.latest(got, "path"), ["path", "loaded"]) == rows(batch.progress_latest(p), ["path", "loaded"])
    s = V.logs(spark, FOLDER).selectExpr("job", "seq", "ts", "event_type as status")
    got = run(spark, live.job_status(feed(spark, s, tmp_path, "ts")), "append")
    assert rows(live.latest(got, "job"), ["job", "status"]) == rows(batch.job_status(s), ["job", "status"])


def test_a_live_query_leaves_the_session_as_it_is(spark):
    """The live queries are compared in test_oracle; they run in a session of their own."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        cols = ["stream", "frame_no", "result_of", "skipped"]
        assert rows(QUERIES["stream_frame_dedupe"](spark, FOLDER), cols) == rows(QUERIES["reuse_results"](spark, FOLDER), cols)
        assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def shuffled(spark, df, tmp_path, parts=3, seed=5):
    """`df` as files: rows in no order within a file, every third row a file later; in the end a row that closes everything."""
    lo, hi = df.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    width = (hi - lo) // parts + 1
    path = str(tmp_path / uuid.uuid4().hex)
    rng = random.Random(seed)
    kinds = df.withColumn("ts", F.col("ts").cast("timestamp")).schema
    spark.createDataFrame([], kinds).write.parquet(path)
    rows = df.withColumn("ts", F.col("ts").cast("timestamp")).collect()
    files = [[] for _ in range(parts + 1)]
    for r in rows:
        files[int((r["ts"].replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000 - lo) // width) + (rng.random() < 0.33)].append(r)
    for f in files:
        rng.shuffle(f)
        spark.createDataFrame(f, kinds).coalesce(1).write.mode("append").parquet(path)
    end = datetime.datetime(2100, 1, 1)
    spark.createDataFrame([tuple(end if c == "ts" else None for c in kinds.names)], kinds).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path)


def fixture(spark, make):
    """Events of a few jobs over ten days, `make(rng)` gives their values."""
    rng = random.Random(1)
    t0 = datetime.datetime(2024, 1, 1)
    at = sorted(rng.randrange(10 * 86_400) for _ in range(400))
    return [(rng.choice([1, 1, 1, 2, 3, 4, None]), i, t0 + datetime.timedelta(seconds=s), *make(rng)) for i, s in enumerate(at)]


LATE, QUIET = "30 days", 40 * 86_400_000


def test_order_of_arrival_does_not_matter_retries(spark, tmp_path):
    e = spark.createDataFrame(fixture(spark, lambda g: (g.choice(["beat"] * 30 + ["stall"] * 4 + ["error", "done"]),)), "job long, seq long, ts timestamp, kind string")
    got = live.latest(run(spark, live.retry_state(shuffled(spark, e, tmp_path), late=LATE, quiet_ms=QUIET), "append"), "job")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.retry_state(e).collect()))


def test_order_of_arrival_does_not_matter_stages(spark, tmp_path):
    line = lambda g: (g.choice(["(2/10) Page 2", "(9/10) Page 9", "Ignore page 3", "[3/4] parsing", "[4/4] writing (1/10) Page 1", "frame= 7"]),)
    lg = spark.createDataFrame(fixture(spark, line), "job long, seq long, ts timestamp, line string")
    got = run(spark, live.stage_progress(shuffled(spark, lg, tmp_path), late=LATE, quiet_ms=QUIET), "append")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    cols = ["job", "seq", "stage", "progress", "ignored_page"]
    want = sorted(map(key, batch.stage_progress(lg).select(*cols).collect()))
    assert sorted(map(key, got.select(*cols).collect())) == want and {w[2] for w in want} == {0, 3, 4}


def test_running_bytes_are_those_of_the_finished_table(spark, tmp_path):
    p = spark.createDataFrame(fixture(spark, lambda g: (g.randrange(1000), None)), "path long, seq long, ts timestamp, loaded long, total long")
    hours = 6 * 3_600_000
    got = run(spark, live.throttled_bytes(shuffled(spark, p, tmp_path), hours, LATE, QUIET), "append")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    want = sorted(map(key, batch.throttled_bytes(p, hours).collect()))
    assert sorted(map(key, got.collect())) == want and sum(w[0] == -1 for w in want) > 5


def test_a_path_that_falls_silent_is_reported_and_begins_anew(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    p = spark.createDataFrame([(1, 0, at(0), 5), (1, 1, at(1), 6), (1, 2, at(300), 7)], "path long, seq long, ts timestamp, loaded long")
    got = run(spark, live.throttled_bytes(feed(spark, p.unionByName(spark.createDataFrame([(None, None, at(9000), None)], p.schema)), tmp_path, "ts", 4), 1000, "10 seconds"), "append")
    assert [(r.loaded, r.final) for r in got.orderBy("win").collect()] == [(5, False), (11, True), (7, True)]


def state_rows(spark, folder, var):
    return spark.read.format("statestore").option("stateVarName", var).load(folder).count()


@pytest.mark.parametrize("monitor,var", [("progress", "last"), ("status", "last"), ("retry", "kept")])
def test_silent_keys_leave_the_state(spark, tmp_path, monitor, var):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda h: t0 + datetime.timedelta(hours=h)
    rows = [(j, j, at(j % 5), "done", 5, 10) for j in range(40)] + [(99, 99, at(200), "running", 1, 10), (100, 100, at(203), "running", 2, 10)]
    df = spark.createDataFrame(rows, "job long, seq long, ts timestamp, status string, loaded long, total long")
    make = {"progress": lambda s: live.progress_latest(s.withColumnRenamed("job", "path")), "status": live.job_status,
            "retry": lambda s: live.retry_state(s.withColumnRenamed("status", "kind"), slot_ms=60_000)}[monitor]
    source, folder, sink = (str(tmp_path / x) for x in ("in", "state", "out"))
    held = []
    for part in (df.filter("job < 40"), df.filter("job = 99"), df.filter("job = 100")):
        part.coalesce(1).write.mode("append").parquet(source)
        q = make(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", folder)
        q.trigger(availableNow=True).start(sink).awaitTermination()
        held.append(state_rows(spark, folder, var))
    assert held[-1] == (1 if monitor == "retry" else 2)  # of all keys only those of the last hours
    got = spark.read.parquet(sink)
    if monitor == "progress":
        assert rows_of(live.latest(got, "path")) == rows_of(batch.progress_latest(df.withColumnRenamed("job", "path")))
    if monitor == "status":
        assert rows_of(live.latest(got, "job")) == rows_of(batch.job_status(df))
    if monitor == "retry":
        assert got.filter("job < 40 and status = 'done'").count() == 40


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_rows_without_a_time_are_left_out_and_ties_go_by_number(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 2, t0, "done"), (1, 1, t0, "stall"), (1, 0, None, "error"), (2, 5, t0, "error"), (2, 5, t0, "error")],
                              "job long, seq long, ts timestamp, kind string")
    end = spark.createDataFrame([(None, None, datetime.datetime(2100, 1, 1), None)], e.schema)
    got = run(spark, live.retry_state(feed(spark, e.unionByName(end), tmp_path, F.col("ts").asc_nulls_first(), 6)), "append")
    assert rows_of(live.latest(got, "job")) == [(1, 2, "done"), (2, 1, "failed")]


def test_stalls_raise_alerts_by_event_time(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    data = [(1, 0, at(0), "load", 0, 0.0), (1, 1, at(30), "load", 0, 0.0), (1, 2, at(200), "load", 0, 0.0),   # 170 s silent
            (2, 3, at(0), "run", 10, 1.0), (2, 4, at(29), "run", 60, 1.0), (2, 5, at(500), "run", 60, 1.0),   # within limits
            (9, 9, at(5000), "run", 60, 1.0)]                                                                # moves the watermark
    df = spark.createDataFrame(data, "job long, seq long, ts timestamp, phase string, percent int, size_mb double")
    assert rows(batch.stall_detect(df), ["job", "seq", "silent_sec"]) == [(1, 1, 170.0)]
    asked = batch.stall_detect(df, as_of=F.lit(at(1100.5)))
    assert rows(asked, ["job", "seq", "silent_sec"]) == [(1, 1, 170.0), (1, 2, 900.5), (2, 5, 600.5)]
    got = run(spark, live.stall_detect(feed(spark, df, tmp_path, "ts", 7)), "append")
    alerts = sorted((r.job, r.seq) for r in got.collect())
    assert (1, 1) in alerts and (1, 2) in alerts and (2, 5) in alerts and len(alerts) == 3


def test_replies(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    req = spark.createDataFrame([(1, at(0)), (2, at(1)), (3, at(500)), (4, at(1000))], "id long, ts timestamp")
    rep = spark.createDataFrame([(1, at(2), "progress", 0.5, None), (1, at(3), "done", 1.0, None), (3, at(700), "done", 1.0, None), (4, at(1001), "error", None, "load")],
                                "id long, ts timestamp, kind string, value double, code string")
    got = run(spark, live.match_replies(feed(spark, req, tmp_path, "ts", 4), feed(spark, rep, tmp_path, "ts", 4)), "append")
    seen = sorted((r.req_id, r.kind) for r in got.collect() if r.kind)
    assert seen == [(1, "done"), (1, "progress"), (4, "error")]
    assert (2, None) in [(r.req_id, r.kind) for r in got.collect()]  # no reply in time, reported once
    b = {r.id: (r.status, r.reset_worker, r.progress) for r in batch.match_replies(req, rep).collect()}
    assert b == {1: ("done", False, 0.5), 2: ("pending", False, None), 3: ("done", False, None), 4: ("error", True, None)}


def test_overall_progress(spark):
    df = spark.createDataFrame([("a", 50, 100), ("b", 5, None), ("c", 25, 100)], "path string, loaded long, total long").withColumn("g", F.lit(1))
    assert batch.overall_progress(df, ["g"]).first().part == pytest.approx(0.375)
    assert batch.overall_progress(df.filter("path = 'b'"), ["g"]).first().part is None


def test_replay_of_nothing(spark):
    from quiremill.streaming.replay import replay
    none = V.logs(spark, FOLDER).selectExpr("job", "seq", "ts", "event_type as kind").filter("false")
    got = replay(none, lambda s, late, quiet: live.retry_state(s, 3, f"{late} milliseconds", quiet_ms=quiet), slices=1)
    assert got.collect() == [] and got.columns == ["job", "at_us", "seq", "attempts", "status"]


class _Calls:
    """State and timers of one key, counted."""

    def __init__(self):
        self.vars, self.timers, self.n = {}, set(), 0

    def getValueState(self, name, _):
        return _Var(self, self.vars.setdefault(name, {}))

    getMapState = lambda self, name, *_: _Var(self, self.vars.setdefault(name, {}))

    def registerTimer(self, ms):
        self.n += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.n += 1
        self.timers.discard(ms)

    getCurrentWatermarkInMs = lambda self: self.now


class _Var:
    def __init__(self, calls, at):
        self.calls, self.at = calls, at

    def _count(self, v=None):
        self.calls.n += 1
        return v

    exists = lambda self: self._count(() in self.at)
    get = lambda self: self._count(self.at.get(()))
    update = lambda self, v: self._count(self.at.__setitem__((), v))
    clear = lambda self: self._count(self.at.clear())
    getValue = lambda self, k: self._count(self.at.get(k))
    updateValue = lambda self, k, v: self._count(self.at.__setitem__(k, v))
    removeKey = lambda self, k: self._count(self.at.pop(k))
    containsKey = lambda self, k: self._count(k in self.at)
    iterator = lambda self: iter(list(self.at.items()))


@pytest.mark.parametrize("block", [3, 4096])
def test_calls_to_the_state_do_not_grow_with_slots(monkeypatch, block):
    """Every event in a slot of its own, batches that overlap in time: all rows in order, few calls where blocks hold a batch."""
    import pandas as pd
    if hasattr(live, "BLOCK"):
        monkeypatch.setattr(live, "BLOCK", block)

    class Seen(live._InOrder):
        values, state, out = [("kind", "string")], "n long", [("at_us", "long"), ("seq", "long"), ("n", "long"), ("kind", "string")]

        begin = lambda self: (0,)

        def step(self, state, at_us, seq, kind):
            return (state[0] + 1,), [(at_us, seq, state[0], kind)]

    rng, hour = random.Random(3), live.HOUR
    rows = [(rng.randrange(200) * hour * 1000 + rng.randrange(3), i, rng.choice("ab")) for i in range(300)]
    calls, told = _Calls(), []
    p = Seen(hour, 10_000 * hour)
    p.init(calls)

    def fire(now):
        calls.now = now
        for t in sorted(t for t in calls.timers if t <= now):
            if t in calls.timers:
                calls.timers.discard(t)
                for out in p.handleExpiredTimer(("k",), calls, calls):
                    told.extend(out.itertuples(index=False, name=None))
    for k in range(5):
        part = [r for r in rows if r[0] // (40 * hour * 1000) + (r[1] % 3 == 0) == k]
        rng.shuffle(part)
        frames = [pd.DataFrame(part[i:i + 20], columns=["at_us", "seq", "kind"]) for i in range(0, len(part), 20)]
        list(p.handleInputRows(("k",), iter(frames), calls))
        fire(max(0, (k - 1) * 40 * hour))
    rest = [r for r in rows if r[0] // (40 * hour * 1000) + (r[1] % 3 == 0) == 5]
    list(p.handleInputRows(("k",), iter([pd.DataFrame(rest, columns=["at_us", "seq", "kind"])]), calls))
    fire(5000 * hour)
    assert [(a, s, n, c) for _, a, s, n, c in told] == [(a, s, n, c) for n, (a, s, c) in enumerate(sorted(rows))]
    assert not calls.vars["waiting"] and (block == 3 or calls.n < 150)
