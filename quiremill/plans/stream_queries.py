"""H and U: monitors over finished event tables, handler dispatch."""

from pyspark.sql import functions as F

from ..operators import convert as U
from ..sources import views as V
from ..sources.tables import table
from ..streaming import batch as H
from ..streaming import live as L
from ..streaming.replay import replay
from .registry import query


@query("progress_latest", "SELECT path, arg_max(loaded, (ts, seq)) AS loaded, max(total) AS total FROM f_progress GROUP BY path")
def _(spark, d):
    return H.progress_latest(V.progress(spark, d))


@query("overall_progress", """SELECT path % 10 AS grp, round(sum(loaded) FILTER (WHERE total IS NOT NULL)::DOUBLE / sum(total), 9) AS part FROM (
  SELECT path, arg_max(loaded, (ts, seq)) AS loaded, max(total) AS total FROM f_progress GROUP BY path) GROUP BY path % 10""")
def _(spark, d):
    p = H.overall_progress(H.progress_latest(V.progress(spark, d)).withColumn("grp", F.expr("path % 10")), ["grp"])
    return p.select("grp", F.round("part", 9).alias("part"))


@query("throttled_bytes", """SELECT path, win, (sum(b) OVER (PARTITION BY path ORDER BY win))::BIGINT AS loaded, win = max(win) OVER (PARTITION BY path) AS final FROM (
  SELECT path, floor(epoch_us(ts) / 250000)::BIGINT AS win, sum(loaded) AS b FROM f_progress GROUP BY ALL)""")
def _(spark, d):
    return H.throttled_bytes(V.progress(spark, d), 250)


def beats(spark, d):
    return V.logs(spark, d).selectExpr("job", "seq", "ts", "if(seq % 3 = 0, 'load', 'run') as phase", "seq % 100 as percent", "cast(seq % 40 as double) as size_mb")


@query("stall_detect", """SELECT job, seq, ts, round(gap, 6) AS silent_sec FROM (SELECT *, (coalesce(lead(epoch_us(ts)) OVER (PARTITION BY job ORDER BY ts, seq), (SELECT max(epoch_us(ts)) FROM f_logs)) - epoch_us(ts)) / 1000000.0::DOUBLE AS gap FROM f_logs)
WHERE gap > 200 * CASE WHEN seq % 3 = 0 THEN 60 WHEN seq % 100 < 50 THEN 20 + 10 * (seq % 40) ELSE 600 END""")
def _(spark, d):
    seen = beats(spark, d).agg(F.max("ts")).first()[0]  # the time of looking: the last sign of life of any job
    return H.stall_detect(beats(spark, d), 200.0, as_of=F.lit(seen)).withColumn("silent_sec", F.round("silent_sec", 6))


_KIND = "case when event_type = 'error' then 'stall' when event_type = 'purchase' and seq % 4 = 0 then 'error' when event_type = 'signup' and seq % 3 = 0 then 'done' else 'beat' end"
_RETRY = {"f_kind": f"SELECT job, seq, {_KIND} AS kind FROM f_logs",
          "f_retry": """SELECT *, sum((kind = 'stall')::INT) OVER (PARTITION BY job ORDER BY seq) AS stalls, sum((kind IN ('error', 'done'))::INT) OVER (PARTITION BY job ORDER BY seq) AS ends FROM f_kind""",
          "f_stop": """SELECT job, min(seq) FILTER (WHERE (kind = 'stall' AND stalls = 3) OR kind IN ('error', 'done')) AS stop FROM f_retry GROUP BY job"""}


@query("retry_state", """SELECT f.job, count(*) FILTER (WHERE kind = 'stall' AND (stop IS NULL OR seq < stop)) + 1 AS attempts,
  coalesce(max(CASE WHEN seq = stop THEN CASE kind WHEN 'done' THEN 'done' ELSE 'failed' END END), 'running') AS status FROM f_retry f JOIN f_stop s ON f.job = s.job GROUP BY f.job""", _RETRY)
def _(spark, d):
    return H.retry_state(V.logs(spark, d).selectExpr("job", "seq", f"{_KIND} as kind"))


_STATUS = "case event_type when 'signup' then 'waiting' when 'view' then 'converting' when 'click' then 'converting' when 'purchase' then 'done' else 'failed' end"


@query("job_status", f"SELECT job, arg_max({_STATUS}, (ts, seq)) AS status, max(ts) AS since FROM f_logs GROUP BY job")
def _(spark, d):
    return H.job_status(V.logs(spark, d).selectExpr("job", "seq", "ts", f"{_STATUS} as status"))


_REPLY = {"f_req": "SELECT event_id AS id, ts FROM events WHERE event_type = 'view'",
          "f_rep": """SELECT event_id - unnest([1, 2, 3]) AS id, ts, CASE WHEN event_type = 'click' THEN 'progress' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS kind, value,
             CASE WHEN event_id % 3 = 0 THEN 'load' ELSE 'convert' END AS code FROM events WHERE event_type <> 'view'""",
          "f_end": "SELECT r.id, min(p.ts) AS ets, min_by(kind, p.ts) AS kind, min_by(code, p.ts) AS code FROM f_req r JOIN f_rep p ON r.id = p.id AND p.ts >= r.ts AND kind <> 'progress' GROUP BY r.id"}


def requests(spark, d):
    e = table(spark, d, "events")
    req = e.filter("event_type = 'view'").selectExpr("event_id as id", "ts")
    rep = e.filter("event_type <> 'view'").selectExpr(
        "explode(array(event_id - 1, event_id - 2, event_id - 3)) as id", "ts", "case when event_type = 'click' then 'progress' when event_type = 'purchase' then 'done' else 'error' end as kind", "value",
        "if(event_id % 3 = 0, 'load', 'convert') as code")
    return req, rep


@query("match_replies", """SELECT r.id, coalesce(e.kind, 'pending') AS status, coalesce(e.kind IS NOT NULL AND e.code = 'load', false) AS reset_worker, max(p.value) AS progress, count(p.value) AS n_progress
FROM f_req r LEFT JOIN f_end e ON r.id = e.id LEFT JOIN f_rep p ON p.id = r.id AND p.kind = 'progress' AND p.ts >= r.ts AND (e.ets IS NULL OR p.ts < e.ets) GROUP BY r.id, e.kind, e.code""", _REPLY)
def _(spark, d):
    return H.match_replies(*requests(spark, d))


_STAGE = {"f_stage": """SELECT job, seq, line, coalesce(last_value(CASE WHEN contains(line, '[3/4]') THEN 3 WHEN contains(line, '[4/4]') THEN 4 END IGNORE NULLS) OVER (PARTITION BY job ORDER BY seq), 0) AS stage,
   regexp_extract(line, '^\\((\\d+)/(\\d+)\\) Page', 1) AS d, regexp_extract(line, '^Ignore page (\\d+)', 1) AS ig FROM f_logs"""}


@query("stage_progress", """SELECT job, seq, stage, round(CASE WHEN d <> '' THEN CASE WHEN stage = 3 THEN (d::INT - 1) / 10.0::DOUBLE * 0.85 ELSE 0.85 + (d::INT - 1) / 10.0::DOUBLE * 0.15 END END, 9) AS progress, TRY_CAST(ig AS INT) AS ignored_page
FROM f_stage WHERE d <> '' OR ig <> ''""", _STAGE)
def _(spark, d):
    return H.stage_progress(V.logs(spark, d)).withColumn("progress", F.round("progress", 9))


# The live forms over the same tables, fed as they would arrive: slice by slice, out of order within two slices.

@query("live_progress_latest", like="progress_latest")
def _(spark, d):
    return L.latest(replay(V.progress(spark, d), lambda s, late, quiet: L.progress_latest(s, f"{late} milliseconds", quiet)), "path")


@query("live_job_status", like="job_status")
def _(spark, d):
    events = V.logs(spark, d).selectExpr("job", "seq", "ts", f"{_STATUS} as status")
    last = L.latest(replay(events, lambda s, late, quiet: L.job_status(s, f"{late} milliseconds", quiet)), "job")
    return last.withColumn("since", F.col("since").cast(events.schema["ts"].dataType))


@query("live_throttled_bytes", like="throttled_bytes")
def _(spark, d):
    return replay(V.progress(spark, d), lambda s, late, quiet: L.throttled_bytes(s, 250, f"{late} milliseconds", quiet))


@query("live_retry_state", like="retry_state")
def _(spark, d):
    events = V.logs(spark, d).selectExpr("job", "seq", "ts", f"{_KIND} as kind")
    return L.latest(replay(events, lambda s, late, quiet: L.retry_state(s, 3, f"{late} milliseconds", quiet_ms=quiet)), "job")


@query("live_stage_progress", like="stage_progress")
def _(spark, d):
    told = replay(V.logs(spark, d), lambda s, late, quiet: L.stage_progress(s, f"{late} milliseconds", quiet_ms=quiet))
    return told.withColumn("progress", F.round("progress", 9))


def _strict_text(name, content, target):
    if bytes(content[:2]) == b"\xff\xd8":
        return U.Failure("password_needed", name)
    if bytes(content[:4]) == b"\x89PNG":
        raise ValueError("broken")
    return U.text_handler(name, bytes(content[8:]), target)


@query("convert_corpus", """SELECT doc_id AS file_id, CASE WHEN e IS NULL THEN 'convert' WHEN starts_with(hx, 'FFD8') THEN 'password_needed' WHEN starts_with(hx, '89504E47') THEN 'unknown' END AS error_kind,
  CASE WHEN e IS NULL OR starts_with(hx, 'FFD8') OR starts_with(hx, '89504E47') THEN name ELSE stem || '.txt' END AS name,
  CASE WHEN e IS NULL OR starts_with(hx, 'FFD8') OR starts_with(hx, '89504E47') THEN NULL ELSE length(hx) // 2 - 8 END AS size
FROM (SELECT *, CASE WHEN ext IN ('docx', 'hwp', 'hwpx', 'pdf', 'doc') THEN 1 END AS e FROM f_heads)""")
def convert_corpus(spark, d):
    reg = U.Registry().register("office", _strict_text).register("hwp", _strict_text).register("pdf", _strict_text, ("json",))
    files = V.heads(spark, d).select(F.col("doc_id").alias("file_id"), "name", "content")
    return U.convert_corpus(files, reg, "txt").select("file_id", "error_kind", "name", "size")


@query("register_task", """SELECT doc_id AS file_id, CASE WHEN ext IN ('hwp', 'hwpx') THEN 'load' WHEN e IS NULL THEN 'convert' END AS error_kind, CASE WHEN e IS NULL OR ext IN ('hwp', 'hwpx') THEN name ELSE stem || '.txt' END AS name
FROM (SELECT *, CASE WHEN ext IN ('docx', 'hwp', 'hwpx', 'pdf', 'doc') THEN 1 END AS e FROM f_heads)""")
def register_task(spark, d):
    """A task whose modules are missing fails to load; the others go on."""
    reg = U.Registry()
    for name, needs in (("office", ()), ("pdf", ("json",)), ("hwp", ("no_such_module_anywhere",))):
        U.register_task(reg, name, U.text_handler, needs)
    files = V.heads(spark, d).select(F.col("doc_id").alias("file_id"), "name", "content")
    return U.convert_corpus(files, reg, "txt").select("file_id", "error_kind", "name")


_TABLES_JSON = """to_json(collect_list(named_struct('page', cast(l_linenumber as int), 'rows', array(array(l_returnflag, cast(l_partkey as string)), array(l_linestatus, null)))))"""


@query("tables_of", """SELECT l_orderkey AS doc_id, l_linenumber AS page, r AS row_no, CASE WHEN r = 0 THEN l_returnflag || '¦' || l_partkey ELSE l_linestatus || '¦∅' END AS cells FROM lineitem, (SELECT unnest([0, 1]) AS r)""")
def _(spark, d):
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.expr(_TABLES_JSON).alias("tables"))
    t = U.tables_of(docs)
    return t.select("doc_id", "page", "row_no", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("∅"))), "¦").alias("cells"))


@query("tables_of_sql", like="tables_of")
def _(spark, d):
    """The same for SQL users: the table function, a document's rows laterally beside it."""
    view = "documents_with_tables"
    table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.expr(_TABLES_JSON).alias("tables")).createOrReplaceTempView(view)
    spark.udtf.register("tables_of", U.tables_of_udtf())
    t = spark.sql(f"SELECT d.doc_id, t.* FROM {view} d, LATERAL tables_of(d.tables) t")
    return t.select("doc_id", "page", "row_no", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("∅"))), "¦").alias("cells"))
