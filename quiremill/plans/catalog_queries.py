"""A: file corpus, routing and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered
from ..operators import catalog as A
from ..rules import formats as R
from ..sources import views as V
from ..sources.tables import scan_files as scan
from ..sources.tables import table
from .registry import query
from .sqlviews import sql_list


def _values(rows) -> str:
    def lit(v):
        if isinstance(v, (list, tuple)):
            return sql_list(v) if v else "CAST([] AS VARCHAR[])"
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _map_view(d) -> str:
    return f"SELECT * FROM ({_values(list(d.items()))}) t(k, v)"


CAT = {"r_cat": "SELECT * FROM (" + _values(
    [(i, c, v[0], v[1], v[2]) for i, (c, v) in enumerate(R.CATEGORIES.items())]) + ") t(ord, id, engine, exts, targets)",
    "r_ext": "SELECT e AS k, min_by(id, ord) AS cat, min_by(engine, ord) AS engine, min_by(targets, ord) AS targets "
             "FROM (SELECT ord, id, engine, targets, unnest(exts) AS e FROM r_cat) GROUP BY e",
    "r_same": _map_view(R.SAME), "r_not": _map_view(R.NOT_FOR), "r_extra": _map_view(R.EXTRA_FOR), "r_mime": _map_view(R.MIME),
    "f_targets": """SELECT f.*, r_ext.cat, r_ext.engine, coalesce(list_filter(list_concat(r_ext.targets, coalesce(x.v, [])),
        lambda t: t <> coalesce(s.v, f.ext) AND NOT list_contains(coalesce(n.v, []), t)), []) AS targets
        FROM f_ext f LEFT JOIN r_ext ON f.ext = r_ext.k LEFT JOIN r_same s ON f.ext = s.k
        LEFT JOIN r_not n ON f.ext = n.k LEFT JOIN r_extra x ON f.ext = x.k"""}


@query("scan_files")
def _(spark, d):
    return scan(spark, d, "*.parquet").select("name", "size")


@query("dedupe_files", """SELECT doc_id, batch, name, size FROM f_files""")
def _(spark, d):
    f = V.files(spark, d)
    again = f.withColumn("pos", F.col("pos") + (1 << 62))
    return A.dedupe_files(f.unionByName(again), ["batch", "name", "size"], "pos").select("doc_id", "batch", "name", "size")


@query("file_ext_stem", "SELECT doc_id, ext, stem FROM f_ext")
def _(spark, d):
    return A.file_ext_stem(V.files(spark, d)).select("doc_id", "ext", "stem")


@query("file_category", "SELECT doc_id, cat AS category, engine FROM f_targets", CAT)
def _(spark, d):
    return A.file_category(V.files(spark, d)).select("doc_id", "category", "engine")


@query("file_targets", "SELECT doc_id, array_to_string(targets, ',') AS targets FROM f_targets", CAT)
def _(spark, d):
    return A.file_targets(V.files(spark, d)).select("doc_id", F.array_join("targets", ",").alias("targets"))


@query("batch_common_targets", """
SELECT batch, n_files, array_to_string(t, ',') AS targets, CASE WHEN len(t) = 1 THEN t[1] END AS default_target FROM (
  SELECT u.batch, u.n_files, list_concat(coalesce(c.t, []), CASE WHEN n_files > 1 AND all_pdf THEN ['merge'] ELSE [] END) AS t
  FROM (SELECT batch, count(*) AS n_files, bool_and(ext = 'pdf') AS all_pdf FROM f_targets WHERE len(targets) > 0 GROUP BY batch) u
  LEFT JOIN (SELECT batch, list(tg ORDER BY ix) AS t FROM (
      SELECT batch, tg, count(*) AS k, min_by(i, pos) AS ix FROM (
        SELECT batch, pos, unnest(targets) AS tg, unnest(range(len(targets))) AS i FROM f_targets) GROUP BY batch, tg) x
      WHERE k = (SELECT count(*) FROM f_targets y WHERE y.batch = x.batch AND len(y.targets) > 0) GROUP BY batch) c
  ON u.batch = c.batch)""", CAT)
def batch_common_targets(spark, d):
    return (A.batch_common_targets(V.files(spark, d))
            .select("batch", "n_files", F.array_join("targets", ",").alias("targets"), "default_target"))


@query("usable_files", "SELECT doc_id, name FROM f_targets WHERE len(targets) > 0", CAT)
def _(spark, d):
    return A.usable_files(V.files(spark, d)).select("doc_id", "name")


_CHOSEN = "CASE WHEN batch LIKE '%-m2' OR batch LIKE '%-x2' OR batch LIKE '%-x3' THEN 'pdf' WHEN batch LIKE '%-x8' THEN 'merge' ELSE 'png' END"


@query("merge_eligibility", f"""
SELECT batch, n_files, all_pdf, target, n_files > 1 AND target = 'pdf' AND imgs AS images_to_one_pdf,
  target = 'merge' OR (n_files > 1 AND target = 'pdf' AND imgs) AS merging
FROM (SELECT batch, count(*) AS n_files, bool_and(ext = 'pdf') AS all_pdf, bool_and(cat = 'image') AS imgs,
      max({_CHOSEN}) AS target FROM f_targets WHERE len(targets) > 0 GROUP BY batch)""", CAT)
def _(spark, d):
    return A.merge_eligibility(V.files(spark, d), F.expr(_CHOSEN))


@query("target_groups", f"""SELECT doc_id, t AS target, CASE WHEN t IN ('up2','up4','up8') THEN 'upscale'
  WHEN t IN {tuple(R.TOOLS)} THEN 'tool' ELSE 'conversion' END AS grp,
  CASE t WHEN 'up2' THEN '고화질 2배' WHEN 'up4' THEN '고화질 4배' WHEN 'up8' THEN '고화질 8배'
  {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.TOOLS.items())} ELSE upper(t) END AS label
FROM (SELECT doc_id, unnest(targets) AS t FROM f_targets)""", CAT)
def _(spark, d):
    t = A.file_targets(V.files(spark, d)).select("doc_id", F.explode("targets").alias("target"))
    return t.select("doc_id", "target", A.target_group(F.col("target")).alias("grp"), A.target_label(F.col("target")).alias("label"))


@query("signature_check", """SELECT doc_id, ext, starts_with(hx, 'D0CF11E0') AS ole, CASE
  WHEN ext IN ('docx','docm','dotx','xlsx','xlsm','xlsb','pptx','pptm','ppsx') THEN NOT (starts_with(hx,'504B') OR starts_with(hx,'D0CF11E0'))
  WHEN ext IN ('odt','ods','odp') THEN NOT starts_with(hx,'504B') WHEN ext IN ('ppt','pps') THEN NOT starts_with(hx,'D0CF11E0')
  ELSE false END AS damaged FROM f_heads""")
def _(spark, d):
    return A.file_ext_stem(A.signature_check(V.heads(spark, d))).select("doc_id", "ext", "ole", "damaged")


_SNIFF = {f: f"substr(hx, {2 * o + 1}, {len(h)}) = '{h}'" for f, o, h in R.MAGIC_AT} | {
    "mp3": "starts_with(hx,'494433') OR (starts_with(hx,'FF') AND substr(hx,3,1) IN ('E','F'))",
    "aac": "starts_with(hx,'FF') AND substr(hx,3,2) IN ('F0','F1','F8','F9')",
    "opus": "starts_with(hx,'4F676753') AND regexp_matches(hx, '^(..)*4F70757348656164')",
    "mov": "substr(hx,9,8) = '66747970' AND substr(hx,17,4) = '7174'",
    "avi": "starts_with(hx,'52494646') AND substr(hx,17,8) = '41564920'",
    "tiff": "starts_with(hx,'4D4D002A') OR starts_with(hx,'49492A00')",
    "txt": f"regexp_matches(hx, '^(..)*{'한글'.encode().hex().upper()}')",
    "csv": f"regexp_matches(hx, '^(..)*{'철수'.encode().hex().upper()}')"}


@query("sniff_format", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {_SNIFF[f]} THEN '{f}' END" for f in sorted(_SNIFF)) + "], lambda x: x IS NOT NULL), ',') AS formats FROM f_heads")
def _(spark, d):
    return V.heads(spark, d).select("doc_id", F.array_join(A.sniffed_formats(F.col("content")), ",").alias("formats"))


_MARK = "regexp_matches(hx, '^(..)*45006E006300720079007000740069006F006E0049006E0066006F00')"


@query("byte_pattern_scan", f"SELECT doc_id, {_MARK} AS has_marker FROM f_heads")
def _(spark, d):
    return V.heads(spark, d).select("doc_id", A.byte_pattern_scan(F.col("content")).alias("has_marker"))


@query("encryption_route", f"""SELECT doc_id, CASE WHEN ole AND mark AND NOT pw THEN 'needs_password' WHEN pw AND ole THEN 'decrypt_first'
  ELSE 'direct' END AS route FROM (SELECT doc_id, starts_with(hx,'D0CF11E0') AS ole, {_MARK} AS mark, doc_id % 8 = 0 AS pw FROM f_heads)""")
def _(spark, d):
    h = A.signature_check(V.heads(spark, d))
    return h.select("doc_id", A.encryption_route(F.col("ole"), A.byte_pattern_scan(F.col("content")),
                                                 F.expr("doc_id % 8 = 0")).alias("route"))


@query("mime_lookup", "SELECT doc_id, ext, v AS mime FROM f_ext LEFT JOIN r_mime ON ext = k", CAT)
def _(spark, d):
    f = A.file_ext_stem(V.files(spark, d))
    return f.select("doc_id", "ext", A.mime(F.col("ext")).alias("mime"))


_PAGES = {"f_pages": "SELECT doc_id, page, count(*) AS n_lines FROM f_lines GROUP BY doc_id, page"}


def _pages(spark, d):
    return V.lines(spark, d).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


@query("output_names", """SELECT f.doc_id, page, CASE WHEN n = 1 THEN stem || '.png' ELSE stem || '-' || lpad(CAST(page + 1 AS VARCHAR), length(CAST(n AS VARCHAR))::INT, '0') || '.png' END AS rendered,
  stem || '-' || lpad(CAST(page + 1 AS VARCHAR), length(CAST(n AS VARCHAR))::INT, '0') || '.pdf' AS split_name, stem || '_압축.' || 'pdf' AS compressed,
  stem || '_고화질' || (2 ** (f.doc_id % 3 + 1))::INT || '배' || CASE WHEN f.doc_id % 2 = 0 THEN '_그림' ELSE '' END ||
    ['_원본충실', '', '_강하게'][f.doc_id % 3 + 1] || '.png' AS upscaled
FROM f_pages p JOIN f_ext f USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM f_pages GROUP BY doc_id) c USING (doc_id)""", _PAGES)
def _(spark, d):
    pages = ordered.with_group_total(_pages(spark, d), ["doc_id"], F.count("*").alias("n"))
    j = pages.join(A.file_ext_stem(V.files(spark, d)).select("doc_id", "stem"), "doc_id")
    stem, page, n = F.col("stem"), F.col("page") + 1, F.col("n")
    up = A.upscale_suffix(F.expr("cast(pow(2, doc_id % 3 + 1) as int)"),
                          F.expr("element_at(array('original','natural','strong'), cast(doc_id % 3 as int) + 1)"),
                          F.expr("if(doc_id % 2 = 0, 'art', 'photo')"))
    return j.select("doc_id", "page", A.page_output_name(stem, page, n, "png", False).alias("rendered"),
                    A.page_output_name(stem, page, n, "pdf", True).alias("split_name"),
                    F.concat(stem, A.tool_suffix(F.lit("compress")), F.lit(".pdf")).alias("compressed"),
                    F.concat(stem, up, F.lit(".png")).alias("upscaled"))


@query("unique_names", """SELECT doc_id, batch, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '(\\.[^.]+)$', ' (' || k || ')\\1') END AS unique_name
FROM (SELECT doc_id, batch, name, row_number() OVER (PARTITION BY batch, name ORDER BY doc_id) AS k
      FROM (SELECT doc_id, batch, lang || '.' || CASE WHEN ext IN ('jpg','jpeg') THEN 'png' ELSE 'pdf' END AS name FROM f_ext JOIN documents USING (doc_id)))""")
def _(spark, d):
    f = A.file_ext_stem(V.files(spark, d)).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    res = f.select("doc_id", "batch", "pos", F.concat("lang", F.expr("if(ext in ('jpg','jpeg'), '.png', '.pdf')")).alias("name"))
    return A.unique_names(res).select("doc_id", "batch", "unique_name")


_MB = "CASE WHEN {0} >= 1e6 THEN format('{{:.1f}}', {0} / 1e6) || 'MB' ELSE CAST(greatest(1, floor({0} / 1e3 + 0.5))::BIGINT AS VARCHAR) || 'KB' END"
_SIZE2 = {"f_sizes": "SELECT doc_id, size * 37 AS a, size * 37 * (60 + doc_id % 50) // 100 AS b FROM f_files"}


@query("compression_report", f"""SELECT doc_id, b >= a * 0.97 AS keep_original, CASE WHEN b >= a * 0.97 THEN '{R.NOTE_ALREADY_SMALL}'
  ELSE {_MB.format('a')} || ' → ' || {_MB.format('b')} || ' (' || CAST(floor((1 - b::DOUBLE / a) * 100 + 0.5)::BIGINT AS VARCHAR) || '% 줄임)' END AS note
FROM f_sizes""", _SIZE2)
def _(spark, d):
    f = V.files(spark, d).selectExpr("doc_id", "size * 37 as a", "size * 37 * (60 + doc_id % 50) div 100 as b")
    return A.compression_report(f, "a", "b").select("doc_id", "keep_original", "note")


@query("format_size", f"""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{{:.1f}}', n / 1024.0::DOUBLE) || ' KB'
  WHEN n < 1073741824 THEN format('{{:.1f}}', n / 1048576.0::DOUBLE) || ' MB' ELSE format('{{:.1f}}', n / 1073741824.0::DOUBLE) || ' GB' END AS pretty,
  {_MB.format('n')} AS pretty_mb FROM (SELECT doc_id, size * size * (doc_id % 40 + 1) AS n FROM f_files)""")
def _(spark, d):
    f = V.files(spark, d).selectExpr("doc_id", "size * size * (doc_id % 40 + 1) as n")
    return f.select("doc_id", A.pretty_size(F.col("n")).alias("pretty"), A.pretty_mb(F.col("n")).alias("pretty_mb"))


@query("batch_summary", "SELECT batch, count(*) AS n_files, sum(size)::BIGINT AS total_size FROM f_files GROUP BY batch")
def _(spark, d):
    return A.batch_summary(V.files(spark, d))


_JOBS = {"f_jobs": """SELECT job, seq, 'job' || seq AS label, CASE WHEN event_type = 'error' THEN line END AS error,
  CASE WHEN event_type = 'view' THEN line END AS note, CASE WHEN event_type = 'purchase' THEN line END AS warning FROM f_logs"""}


def _jobs(spark, d):
    return V.logs(spark, d).selectExpr(
        "job", "seq", "concat('job', seq) as label", "case when event_type = 'error' then line end as error",
        "case when event_type = 'view' then line end as note", "case when event_type = 'purchase' then line end as warning")


@query("outcome_summary", """SELECT job, n_jobs, n_errors, n_notes, n_warnings, n_jobs - n_errors AS n_done,
  CASE WHEN n_errors = n_jobs THEN 'failed' WHEN n_errors > 0 THEN 'partial' ELSE 'complete' END AS outcome
FROM (SELECT job, count(*) AS n_jobs, count(error) AS n_errors, count(note) AS n_notes, count(warning) AS n_warnings FROM f_jobs GROUP BY job)""", _JOBS)
def _(spark, d):
    return A.outcome_summary(_jobs(spark, d), "job")


@query("outcome_lines", """SELECT job, section, label || ': ' || txt AS line, row_number() OVER (PARTITION BY job, section ORDER BY seq) AS line_no
FROM (SELECT job, seq, label, 0 AS section, error AS txt FROM f_jobs UNION ALL SELECT job, seq, label, 1, note FROM f_jobs
      UNION ALL SELECT job, seq, label, 2, warning FROM f_jobs) WHERE txt IS NOT NULL""", _JOBS)
def _(spark, d):
    return A.outcome_lines(_jobs(spark, d), "job", "seq")


_ERR = {"f_errors": """SELECT seq, CASE WHEN seq % 5 = 0 THEN 'load' ELSE 'convert' END AS stage, seq % 2 = 0 AS pw,
  ['Failed to fetch ', 'Wrong Password ', 'PASSWORD_REQUIRED ', 'broken ', ''][seq % 7 % 5 + 1] || CASE WHEN seq % 7 = 4 THEN '' ELSE line END AS msg FROM f_logs"""}


@query("classify_errors", """SELECT seq, CASE WHEN stage = 'load' OR regexp_matches(msg, '(?i)dynamically imported module|module script failed|failed to fetch|networkerror|load failed') THEN 'load'
  WHEN regexp_matches(msg, '(?i)password') THEN CASE WHEN pw THEN 'password_wrong' ELSE 'password_needed' END
  WHEN msg = '' THEN 'unknown' ELSE 'convert' END AS kind FROM f_errors""", _ERR)
def _(spark, d):
    e = V.logs(spark, d).selectExpr(
        "seq", "if(seq % 5 = 0, 'load', 'convert') as stage", "seq % 2 = 0 as pw",
        "concat(element_at(array('Failed to fetch ', 'Wrong Password ', 'PASSWORD_REQUIRED ', 'broken ', ''), "
        "cast(seq % 7 % 5 as int) + 1), if(seq % 7 = 4, '', line)) as msg")
    return e.select("seq", A.classify_error(F.col("stage"), F.col("msg"), F.col("pw")).alias("kind"))


_FIRST = {"f_first": """SELECT job, min_by(line, seq) FILTER (WHERE event_type = 'view') AS video,
  min_by(line, seq) FILTER (WHERE event_type = 'click') AS audio, min_by(line, seq) FILTER (WHERE event_type = 'signup') AS dur FROM f_logs GROUP BY job"""}


@query("media_plan", r"""SELECT job, coalesce((regexp_matches(video, 'Video: h264\b') AND regexp_matches(video, 'yuvj?420p[(,\s]')) OR contains(video, 'Video: hevc'), false) AS copy_video,
  CASE WHEN contains(video, 'Video: hevc') THEN 'hvc1' END AS tag, audio IS NULL OR regexp_matches(audio, 'Audio: (aac|mp3)\b') AS copy_audio,
  coalesce(regexp_matches(video, 'Video: (vp8|vp9|av1)'), false) AND (audio IS NULL OR regexp_matches(audio, 'Audio: (opus|vorbis)')) AS webm_copy FROM f_first""", _FIRST)
def _(spark, d):
    return A.media_plan(A.first_lines(V.logs(spark, d))).select("job", "copy_video", "tag", "copy_audio", "webm_copy")


@query("parse_media_log", r"""SELECT job, coalesce(CAST(regexp_extract(dur, 'Duration: (\d+):(\d+):([\d.]+)', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(dur, 'Duration: (\d+):(\d+):([\d.]+)', 2) AS DOUBLE) * 60
    + CAST(regexp_extract(dur, 'Duration: (\d+):(\d+):([\d.]+)', 3) AS DOUBLE), 0) AS duration,
  CASE WHEN video IS NULL THEN NULL WHEN TRY_CAST(f AS DOUBLE) > 0 AND TRY_CAST(f AS DOUBLE) <= 120 THEN f ELSE '30' END AS fps,
  TRY_CAST(regexp_extract(audio, '(\d+) kb/s', 1) AS INT) AS kbps, audio IS NOT NULL AS has_audio
FROM (SELECT *, CASE WHEN contains(video, ' fps') THEN regexp_extract(video, '(\d+(\.\d+)?) fps', 1) ELSE regexp_extract(video, '(\d+(\.\d+)?) tbr', 1) END AS f FROM f_first)""", _FIRST)
def _(spark, d):
    return A.parse_media_log(A.first_lines(V.logs(spark, d))).select("job", "duration", "fps", "kbps", "has_audio")


_RULES = {"r_media": _map_view(R.MEDIA_ARGS | {"mov": R.MEDIA_ARGS["mp4"]}),
          "r_shrink": "SELECT * FROM (" + _values([(k, *v) for k, v in R.SHRINK_AUDIO.items()]) + ") t(k, o, a)"}


@query("conversion_rules", f"""SELECT doc_id, t AS target, CASE WHEN t <> 'compress' THEN t WHEN cat = 'video' THEN 'mp4' ELSE coalesce(s.o, 'mp3') END AS out_ext,
  CASE WHEN t <> 'compress' THEN m.v WHEN cat = 'video' THEN '{R.SHRINK_VIDEO_ARGS.replace("'", "''")}' ELSE coalesce(s.a, '{R.SHRINK_AUDIO_OTHER[1]}') END AS args
FROM (SELECT doc_id, ext, cat, unnest(targets) AS t FROM f_targets WHERE engine = 'media') x LEFT JOIN r_media m ON x.t = m.k LEFT JOIN r_shrink s ON x.ext = s.k
WHERE t NOT IN ('up2','up4')""", CAT | _RULES)
def _(spark, d):
    f = A.file_targets(A.file_category(A.file_ext_stem(V.files(spark, d)))).filter("engine = 'media'")
    t = f.select("doc_id", "ext", "category", F.explode("targets").alias("target")).filter(~F.col("target").isin("up2", "up4"))
    to, args = A.conversion_rule(F.col("category"), F.col("ext"), F.col("target"))
    return t.select("doc_id", "target", to.alias("out_ext"), args.alias("args"))


@query("log_tail", "SELECT job, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS n FROM f_logs) WHERE n <= 200")
def _(spark, d):
    return A.log_tail(V.logs(spark, d)).select("job", "seq", "line")


_SIZES = {"f_dims": "SELECT p_partkey AS id, (p_size * 100)::DOUBLE AS w, p_retailprice AS h, [2,4,8][p_partkey % 3 + 1] AS scale FROM part"}


def _dims(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey as id", "cast(p_size * 100 as double) as w", "p_retailprice as h",
                                              "element_at(array(2, 4, 8), cast(p_partkey % 3 as int) + 1) as scale")


def _kfit(k):
    return [f"greatest(1, floor({x} * {k} + 0.5))::BIGINT" for x in ("w", "h")]


_VK = "least(scale::DOUBLE, sqrt(8294400.0::DOUBLE / (w * h)), 3840.0::DOUBLE / greatest(w, h), 2160.0::DOUBLE / least(w, h))"
_SK = "least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h), 720.0::DOUBLE / least(w, h))"
_IK = "greatest(1.0::DOUBLE, least(scale::DOUBLE, sqrt(64000000.0::DOUBLE / (w * h))))"


@query("plan_sizes", f"""SELECT id, greatest(2, floor(w * {_SK} / 2 + 0.5) * 2)::BIGINT AS sv_w, greatest(2, floor(h * {_SK} / 2 + 0.5) * 2)::BIGINT AS sv_h,
  {_kfit('least(1.0::DOUBLE, sqrt(64000000.0::DOUBLE / (w * h)))')[0]} AS cv_w, {_kfit('least(1.0::DOUBLE, sqrt(64000000.0::DOUBLE / (w * h)))')[1]} AS cv_h,
  {_kfit('least(1.0::DOUBLE, 2560.0::DOUBLE / greatest(w, h))')[0]} AS ph_w, {_kfit('least(1.0::DOUBLE, 2560.0::DOUBLE / greatest(w, h))')[1]} AS ph_h,
  {_kfit(_VK)[0]} - {_kfit(_VK)[0]} % 2 AS uv_w, {_kfit(_VK)[1]} - {_kfit(_VK)[1]} % 2 AS uv_h,
  greatest(w::BIGINT, floor(w * {_IK} + 0.5)::BIGINT) AS ui_w, greatest(trunc(h)::BIGINT, floor(h * {_IK} + 0.5)::BIGINT) AS ui_h FROM f_dims""", _SIZES)
def _(spark, d):
    w, h, s = F.col("w"), F.col("h"), F.col("scale")
    pairs = {"sv": A.shrink_video_size(w, h), "cv": A.canvas_size(w, h), "ph": A.photo_size(w, h),
             "uv": A.upscaled_video_size(w, h, s), "ui": A.upscaled_image_size(w, h, s)}
    return _dims(spark, d).select("id", *[c.cast("long").alias(f"{k}_{n}") for k, p in pairs.items() for n, c in zip("wh", p)])


@query("rotate_metadata", """SELECT doc_id, (angle + ad) % 360 AS new_angle, CASE WHEN ad % 180 <> 0 THEN h ELSE w END AS new_w,
  CASE WHEN ad % 180 <> 0 THEN w ELSE h END AS new_h, CASE WHEN ext IN ('jpg','jpeg','jfif','jpe','heic','heif') THEN 'jpg' WHEN ext IN ('tif','tiff') THEN 'tiff'
    WHEN ext IN ('webp','bmp') THEN ext ELSE 'png' END AS new_ext
FROM (SELECT *, doc_id % 4 * 90 AS angle, [90, 270, 180][doc_id % 3 + 1] AS ad, size AS w, doc_id AS h FROM f_ext)""")
def _(spark, d):
    f = A.file_ext_stem(V.files(spark, d)).selectExpr(
        "doc_id", "ext", "doc_id % 4 * 90 as angle", "element_at(array(90, 270, 180), cast(doc_id % 3 as int) + 1) as ad",
        "size as w", "doc_id as h")
    return A.rotate_metadata(f, "angle", F.col("ad"), "w", "h", "ext").select("doc_id", "new_angle", "new_w", "new_h", "new_ext")


@query("verify_manifest", """SELECT m.name, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN sha256(d.text) = m.pin THEN 'ok' ELSE 'mismatch' END AS status, strlen(d.text) AS size
FROM (SELECT CASE WHEN doc_id % 10 = 9 THEN -doc_id - 1 ELSE doc_id END AS name, CASE WHEN doc_id % 10 = 3 THEN sha256(text || 'x') ELSE sha256(text) END AS pin FROM documents) m
LEFT JOIN documents d ON m.name = d.doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    pins = table(spark, d, "documents").selectExpr(
        "if(doc_id % 10 = 9, -doc_id - 1, doc_id) as name",
        "sha2(encode(if(doc_id % 10 = 3, concat(text, 'x'), text), 'UTF-8'), 256) as sha256")
    return A.verify_manifest(docs, pins).select("name", "status", F.col("size").cast("long").alias("size"))


@query("incremental_select", "SELECT doc_id FROM f_files WHERE doc_id % 3 = 0 OR doc_id % 7 < size % 7")
def _(spark, d):
    src = V.files(spark, d).selectExpr("doc_id", "size % 7 as mtime")
    out = V.files(spark, d).filter("doc_id % 3 <> 0").selectExpr("doc_id", "doc_id % 7 as mtime")
    return A.incremental_select(src, out, "doc_id").select("doc_id")


@query("fingerprint_dedupe", """SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, hex(encode(text)) AS hx FROM documents)
GROUP BY length(hx), substr(hx, 201, 2), substr(hx, 2 * (length(hx) // 4) + 1, 2)""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return A.fingerprint_dedupe(docs, "content", "doc_id").select("doc_id")


@query("split_merge_pages", """SELECT doc_id, page, stem || '-' || lpad(CAST(page + 1 AS VARCHAR), length(CAST(n AS VARCHAR))::INT, '0') || '.pdf' AS split_name,
  row_number() OVER (PARTITION BY batch ORDER BY pos, page) AS merged_page
FROM f_pages JOIN f_ext USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM f_pages GROUP BY doc_id) USING (doc_id)""", _PAGES)
def _(spark, d):
    pages = ordered.with_group_total(_pages(spark, d), ["doc_id"], F.count("*").alias("n"))
    j = pages.join(A.file_ext_stem(V.files(spark, d)).select("doc_id", "stem", "batch", "pos"), "doc_id")
    m = A.merge_pages(j, "doc_id", "page", "batch", "pos")
    return m.select("doc_id", "page", A.page_output_name(F.col("stem"), F.col("page") + 1, F.col("n"), "pdf", True).alias("split_name"), "merged_page")


_CSS = {"f_css": """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'auto' ELSE p_size || '.5' || ['px','pt',' PC','mm','cm','in',''][p_partkey % 7 + 1] END AS sw,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || (p_size + 3) || ['','in','mm'][p_partkey % 3 + 1] || ' ' END AS sh,
  CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '0,0,0,10' ELSE '0 0 ' || (p_size * 4) || ', ' || (p_size + 8) END AS vb FROM part""",
        "r_css": "SELECT * FROM (VALUES ('', 1.0::DOUBLE), ('px', 1.0), ('pt', 4.0::DOUBLE / 3.0::DOUBLE), ('pc', 16.0), ('mm', 96.0::DOUBLE / 25.4::DOUBLE), ('cm', 96.0::DOUBLE / 2.54::DOUBLE), ('in', 96.0)) t(u, f)",
        "f_cssn": r"""SELECT id, coalesce(TRY_CAST(regexp_extract(sw, '^\s*([\d.]+)', 1) AS DOUBLE) * a.f, 0) AS w, coalesce(TRY_CAST(regexp_extract(sh, '^\s*([\d.]+)', 1) AS DOUBLE) * b.f, 0) AS h,
  CASE WHEN vb IS NULL OR vb = '0,0,0,10' THEN NULL ELSE TRY_CAST(regexp_split_to_array(vb, '[\s,]+')[3] AS DOUBLE) END AS bw, TRY_CAST(regexp_split_to_array(vb, '[\s,]+')[4] AS DOUBLE) AS bh
  FROM f_css LEFT JOIN r_css a ON lower(trim(regexp_extract(sw, '([a-zA-Z ]*)$', 1))) = a.u LEFT JOIN r_css b ON lower(trim(regexp_extract(sh, '([a-zA-Z]*) *$', 1))) = b.u"""}


@query("css_length_px", """SELECT id, round(CASE WHEN w = 0 AND h = 0 THEN coalesce(bw, 300) WHEN w = 0 THEN coalesce(h * bw / bh, h) ELSE w END, 6) AS px_w,
  round(CASE WHEN w = 0 AND h = 0 THEN CASE WHEN bw IS NULL THEN 150 ELSE bh END WHEN h = 0 THEN CASE WHEN bw IS NULL THEN w ELSE w * bh / bw END ELSE h END, 6) AS px_h FROM f_cssn""", _CSS)
def _(spark, d):
    p = table(spark, d, "part").selectExpr(
        "p_partkey as id", "case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then 'auto' else concat(p_size, '.5', "
        "element_at(array('px','pt',' PC','mm','cm','in',''), cast(p_partkey % 7 as int) + 1)) end as sw",
        "case when p_partkey % 3 = 0 then '' else concat(' ', p_size + 3, element_at(array('','in','mm'), cast(p_partkey % 3 as int) + 1), ' ') end as sh",
        "case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then '0,0,0,10' else concat('0 0 ', p_size * 4, ', ', p_size + 8) end as vb")
    w, h = A.css_size(F.col("sw"), F.col("sh"), F.col("vb"))
    return p.select("id", F.round(w, 6).alias("px_w"), F.round(h, 6).alias("px_h"))


@query("paper_size", "SELECT id, w * 72 / 150 AS pt_w, h * 72 / 150 AS pt_h, w * 0.75::DOUBLE AS layout_w FROM f_dims", _SIZES)
def _(spark, d):
    return _dims(spark, d).select("id", A.paper_size(F.col("w")).alias("pt_w"), A.paper_size(F.col("h")).alias("pt_h"),
                                  A.layout_points(F.col("w")).alias("layout_w"))


@query("quality_profile", """SELECT doc_id, CASE WHEN strict THEN 0.0::DOUBLE ELSE 0.015::DOUBLE END AS core, CASE WHEN strict THEN 0 ELSE 1 END AS soft,
  CASE WHEN s = 'strong' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sharp,
  '_고화질4배' || CASE WHEN doc_id % 2 = 0 THEN '_그림' ELSE '' END || CASE s WHEN 'original' THEN '_원본충실' WHEN 'strong' THEN '_강하게' ELSE '' END AS suffix
FROM (SELECT doc_id, ext IN ('png','bmp','tif','tiff','gif') OR doc_id % 3 = 0 AS strict, ['original','natural','strong'][doc_id % 3 + 1] AS s FROM f_ext)""")
def _(spark, d):
    f = A.file_ext_stem(V.files(spark, d)).withColumn(
        "strength", F.expr("element_at(array('original','natural','strong'), cast(doc_id % 3 as int) + 1)"))
    return A.quality_profile(f, "ext", "strength").select(
        "doc_id", "core", "soft", "sharp",
        A.upscale_suffix(F.lit(4), F.col("strength"), F.expr("if(doc_id % 2 = 0, 'art', 'photo')")).alias("suffix"))


@query("upscale_steps", f"""SELECT id, s AS step, round(CASE WHEN s = 1 AND k > 4 THEN k / 4 ELSE k END, 9) AS factor,
  round(CASE WHEN s = 2 THEN (k / 4) * (k / 4) ELSE 1 END, 9) AS cost, round(CASE WHEN k > 4 AND s = 1 THEN 1 / (1 + (k / 4) * (k / 4)) ELSE 1 END, 9) AS progress
FROM (SELECT id, {_IK} AS k, unnest(CASE WHEN {_IK} > 4 THEN [1, 2] ELSE [1] END) AS s FROM f_dims)""", _SIZES)
def _(spark, d):
    k = A.upscaled_image_factor(F.col("w"), F.col("h"), F.col("scale"))
    e = _dims(spark, d).select("id", F.explode(A.upscale_steps(k)).alias("s"))
    return e.select("id", "s.step", *[F.round(f"s.{c}", 9).alias(c) for c in ("factor", "cost", "progress")])


@query("conversion_path", """SELECT doc_id, t AS target, hop, src, dst, share FROM (
  SELECT doc_id, t, CASE WHEN engine = 'office' AND img THEN unnest([1, 2]) WHEN engine = 'hwp' AND (img OR t = 'docx') THEN unnest([1, 2]) ELSE unnest([1, NULL]) END AS hop, engine, img,
    CASE WHEN hop = 2 THEN 'pdf' ELSE engine END AS src, CASE WHEN two AND hop = 1 THEN 'pdf' ELSE t END AS dst,
    CASE WHEN NOT two THEN 1.0::DOUBLE WHEN engine = 'office' THEN [0.7::DOUBLE, 0.3::DOUBLE][hop] WHEN img THEN [0.6::DOUBLE, 0.4::DOUBLE][hop] ELSE [0.3::DOUBLE, 0.7::DOUBLE][hop] END AS share
  FROM (SELECT *, (engine = 'office' AND img) OR (engine = 'hwp' AND (img OR t = 'docx')) AS two FROM (
    SELECT doc_id, engine, t, t IN ('jpg', 'png') AS img FROM (SELECT doc_id, engine, unnest(targets) AS t FROM f_targets)))) WHERE hop IS NOT NULL""", CAT)
def _(spark, d):
    f = A.file_targets(A.file_category(V.files(spark, d))).select("doc_id", "engine", F.explode("targets").alias("target"))
    hops = f.select("doc_id", "target", F.posexplode(A.conversion_path(F.col("engine"), F.col("target"))).alias("i", "h"))
    return hops.select("doc_id", "target", (F.col("i") + 1).alias("hop"), "h.src", "h.dst", "h.share")
