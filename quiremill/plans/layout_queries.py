"""D: page structure."""

from pyspark.sql import functions as F

from ..operators import glyphs as C
from ..operators import layout as D
from ..sources import views as V
from ..sources.tables import table
from .registry import query

_START = ["• ", "- ", "1. ", "(2) ", "a. ", "가. ", "① ", "Ⅳ. ", "-5% ", "1.5 ", "", "(ab) "]
_LISTED = {"f_listed": "SELECT doc_id, line_no, " + "['" + "','".join(_START) + "'][line_no % 12 + 1] || text AS text FROM f_lines"}


@query("list_marker", r"""SELECT doc_id, line_no, regexp_matches(text, '^\s*([•●○◦▪▫■□◆◇❖➢➤►▶▷✓✔·∙‣⁃]|[-–—*]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|\(?[가-힣][.)]\s|[①-⑳㉠-㉭㈀-㈍]|[ⅰ-ⅻⅠ-Ⅻ][.)]?\s)') AS is_item FROM f_listed""", _LISTED)
def _(spark, d):
    pre = F.element_at(F.array(*[F.lit(x) for x in _START]), F.expr("line_no % 12 + 1"))
    return V.lines(spark, d).select("doc_id", "line_no", D.is_list_start(F.concat(pre, "text")).alias("is_item"))


@query("row_stats", """SELECT doc_id, page, line_no, coalesce(max(10 + item_no % 3) FILTER (WHERE trim(str) <> ''), 0) AS size,
  coalesce(bool_and(line_no % 2 = 0 OR item_no % 2 = 1) FILTER (WHERE trim(str) <> ''), false) AS bold, string_agg(str, ' ' ORDER BY item_no) AS text FROM f_items GROUP BY doc_id, page, line_no""")
def _(spark, d):
    s = V.items(spark, d).selectExpr("doc_id", "page", "line_no", "item_no", "str", "10 + item_no % 3 as size", "if(line_no % 2 = 0, 16, item_no % 2 * 16) as flags")
    return D.row_stats(s, ["doc_id", "page", "line_no"])


_PARA = {"f_prow": """SELECT doc_id, page, line_no, x1 - x0 AS w, 10 + line_no % 2 AS h, trim(CASE WHEN line_no % 8 = 3 THEN '- ' ELSE '' END || text) AS t, CASE WHEN line_no % 6 = 0 THEN 12 ELSE 10 END AS size, line_no % 7 = 0 AS bold FROM f_lines""",
         "f_plag": """SELECT *, line_no > min(line_no) OVER p AS later, nullif(max(CASE WHEN line_no % 12 > 0 THEN w END) OVER p, 0)::DOUBLE AS ww, avg(h) OVER p AS hh,
           lag(t) OVER o AS pt, lag(w) OVER o AS pw, lag(size) OVER o AS ps, lag(bold) OVER o AS pb FROM f_prow WINDOW p AS (PARTITION BY doc_id, page), o AS (PARTITION BY doc_id, page ORDER BY line_no)"""}


@query("split_paragraphs", """SELECT doc_id, page, line_no, (sum(s::INT) OVER (PARTITION BY doc_id, page ORDER BY line_no))::BIGINT AS para_no FROM (SELECT *, later AND coalesce(
  (regexp_matches(pt, '[.?!。？！]$') AND (pw / ww <= 0.9 OR (ww - w) / hh >= 0.85)) OR starts_with(t, '- ') OR greatest(size, ps)::DOUBLE / least(size, ps) > 1.15 OR (pb <> bold AND pw / ww <= 0.9), false) AS s FROM f_plag)""", _PARA)
def _(spark, d):
    r = V.lines(spark, d).selectExpr("doc_id", "page", "line_no as row_no", "x0", "x1", "0 as y0", "10 + line_no % 2 as y1",
                                     "concat(if(line_no % 8 = 3, '- ', ''), text) as text", "if(line_no % 6 = 0, 12, 10) as size", "line_no % 7 = 0 as bold")
    return D.split_paragraphs(r, D.PAGE).select("doc_id", "page", F.col("row_no").alias("line_no"), "para_no")


_Y = "14 * (line_no % 12 - CASE WHEN line_no % 6 = 1 THEN 1 ELSE 0 END) + CASE WHEN line_no % 5 = 0 THEN 6 ELSE 0 END"
_KIND = "CASE WHEN line_no % 11 = 10 THEN 'table' WHEN line_no % 13 = 12 THEN 'image' ELSE 'line' END"
_FLOW = {"f_flow": f"SELECT doc_id, page, line_no, {_Y} AS y0, {_Y} + 10 AS y1, {_KIND} AS kind FROM f_lines",
         "f_fgap": "SELECT *, y0 - lag(y1) OVER w AS g, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(kind) OVER w AS pk FROM f_flow WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)",
         "f_mode": "SELECT doc_id, page, g AS common FROM (SELECT doc_id, page, g, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(line_no)) AS k FROM f_fgap WHERE g IS NOT NULL GROUP BY doc_id, page, g) WHERE k = 1"}


@query("join_lines", """SELECT doc_id, page, line_no, (sum(s::INT) OVER (PARTITION BY doc_id, page ORDER BY line_no))::BIGINT AS block_no FROM (
  SELECT f.*, pk IS NULL OR kind = 'table' OR pk = 'table' OR (NOT (least(y1, py1) - greatest(y0, py0) > 5) AND (kind = 'image' OR pk = 'image' OR NOT ((g <= common + 1 AND common <= 15) OR (g BETWEEN -5 AND 5)))) AS s
  FROM f_fgap f LEFT JOIN f_mode m ON f.doc_id = m.doc_id AND f.page = m.page)""", _FLOW)
def _(spark, d):
    ln = V.lines(spark, d).selectExpr("doc_id", "page", "line_no as el_id", f"{_KIND} as kind", f"{_Y} as y0", f"{_Y} + 10 as y1", "10 as height")
    return D.join_lines(ln).select("doc_id", "page", F.col("el_id").alias("line_no"), "block_no")


_SPACE = {"f_srow": "SELECT doc_id, page, line_no, 14 * (line_no % 12) + line_no % 3 AS y0, 24 * (line_no % 12) + line_no % 3 + 10 AS y1, (doc_id % 5)::DOUBLE AS before FROM f_lines",
          "f_sblk": """SELECT doc_id, page, min_by(y1 - y0, line_no)::DOUBLE AS fh, (max(y1) - min(y0))::DOUBLE AS bh, count(*) AS n, min(before) AS before, list(d ORDER BY d) FILTER (WHERE d IS NOT NULL) AS ds
            FROM (SELECT *, (lead(y1) OVER (PARTITION BY doc_id, page ORDER BY y1) - y1)::DOUBLE AS d FROM f_srow) GROUP BY doc_id, page""",
          "f_sval": """SELECT doc_id, page, n, CASE WHEN n = 1 THEN bh WHEN len(q) > 0 THEN q[len(q) // 2 + 1] ELSE (bh - fh) / (n - 1) END AS s, before + fh AS b FROM (SELECT *, list_filter(ds, lambda x: x > 0.3 * fh) AS q FROM f_sblk)"""}


@query("line_spacing", "SELECT doc_id, page, round(CASE WHEN b - s < 0 THEN s + (b - s) / n ELSE s END, 9) AS line_space, round(greatest(b - s, 0), 9) AS before_space FROM f_sval", _SPACE)
def _(spark, d):
    r = V.lines(spark, d).selectExpr("doc_id", "page", "line_no as row_no", "14 * (line_no % 12) + line_no % 3 as y0", "24 * (line_no % 12) + line_no % 3 + 10 as y1", "cast(doc_id % 5 as double) as before_space")
    return D.line_spacing(r, D.PAGE).select("doc_id", "page", F.round("line_space", 9).alias("line_space"), F.round("before_space", 9).alias("before_space"))


_GUT = {"f_body": "SELECT doc_id, page, x0, x1, y1 - y0 AS h FROM f_columns WHERE length(trim(text)) >= 2",
        "f_cost": """SELECT doc_id, page, k, (72 + 0.3::DOUBLE * 478 + k) AS x, coalesce(sum(h) FILTER (WHERE x0 < 72 + 0.3::DOUBLE * 478 + k - 1 AND 72 + 0.3::DOUBLE * 478 + k + 1 < x1), 0) AS cost
           FROM f_body, (SELECT unnest(range(192)) AS k) GROUP BY doc_id, page, k""",
        "f_best": "SELECT doc_id, page, x AS gx, cost FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY cost, k) AS r FROM f_cost) WHERE r = 1",
        "f_gut": """SELECT doc_id, page, CASE WHEN n >= 12 AND cost <= 0.25 * total AND nl >= 6 AND nr >= 6 AND lh >= 0.2 * total AND rh >= 0.2 * total AND (gx - l0) / (r1 - gx) BETWEEN 0.5 AND 2
             AND lw[len(lw) // 2 + 1] >= 0.6 * (gx - l0) AND rw[len(rw) // 2 + 1] >= 0.6 * (r1 - gx) THEN gx END AS gutter FROM (
           SELECT b.doc_id, b.page, gx, cost, count(*) AS n, sum(h) AS total, count(*) FILTER (WHERE x1 <= gx + 1) AS nl, count(*) FILTER (WHERE x0 >= gx - 1) AS nr, sum(h) FILTER (WHERE x1 <= gx + 1) AS lh, sum(h) FILTER (WHERE x0 >= gx - 1) AS rh,
             list(x1 - x0 ORDER BY x1 - x0) FILTER (WHERE x1 <= gx + 1) AS lw, list(x1 - x0 ORDER BY x1 - x0) FILTER (WHERE x0 >= gx - 1) AS rw, min(x0) FILTER (WHERE x1 <= gx + 1) AS l0, max(x1) FILTER (WHERE x0 >= gx - 1) AS r1
           FROM f_body b JOIN f_best g ON b.doc_id = g.doc_id AND b.page = g.page GROUP BY ALL)"""}


def _gutters(spark, d):
    e = V.column_elements(spark, d).withColumn("horizontal", F.lit(True))
    return e, D.find_gutter(e, (72.0, 550.0))


@query("find_gutter", "SELECT doc_id, page, round(gutter, 6) AS gutter FROM f_gut", _GUT)
def _(spark, d):
    return _gutters(spark, d)[1].select("doc_id", "page", F.round("gutter", 6).alias("gutter"))


_BANDS = _GUT | {
    "f_side": "SELECT c.*, gutter, CASE WHEN x1 <= gutter + 2 THEN 'L' WHEN x0 >= gutter - 2 THEN 'R' ELSE 'F' END AS side FROM f_columns c JOIN f_gut g ON c.doc_id = g.doc_id AND c.page = g.page WHERE gutter IS NOT NULL",
    "f_full": """SELECT doc_id, page, i, min(y0) AS y0, max(y1) AS y1 FROM (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, y1, el_id) AS i FROM (
       SELECT *, coalesce(y0 > max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1, el_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS s FROM f_side WHERE side = 'F')) GROUP BY doc_id, page, i""",
    "f_band": """SELECT s.doc_id, s.page, el_id, side, s.y0, s.y1, CASE WHEN max(f.i) FILTER (WHERE (side = 'F' AND f.y0 <= s.y0 AND s.y1 <= f.y1) OR (side <> 'F' AND (s.y0 + s.y1) / 2.0 BETWEEN f.y0 AND f.y1)) IS NOT NULL THEN 'F' ELSE 'C' END AS band_kind,
       coalesce(max(f.i) FILTER (WHERE (side = 'F' AND f.y0 <= s.y0 AND s.y1 <= f.y1) OR (side <> 'F' AND (s.y0 + s.y1) / 2.0 BETWEEN f.y0 AND f.y1)) - 1, count(f.i) FILTER (WHERE f.y0 <= (s.y0 + s.y1) / 2.0)) AS band_no
     FROM f_side s LEFT JOIN f_full f ON s.doc_id = f.doc_id AND s.page = f.page GROUP BY s.doc_id, s.page, el_id, side, s.y0, s.y1"""}


@query("assign_bands", "SELECT doc_id, page, el_id, side, band_kind, band_no::BIGINT AS band_no FROM f_band", _BANDS)
def _(spark, d):
    return D.assign_bands(*_gutters(spark, d)).select("doc_id", "page", "el_id", "side", "band_kind", "band_no")


_SECT = _BANDS | {"f_bsum": """SELECT doc_id, page, band_kind, band_no, min(y0)::DOUBLE AS y0, max(y1)::DOUBLE AS y1, count(*) AS n, min(el_id) AS e, band_kind = 'F' OR count(*) FILTER (WHERE side = 'L') < 3 OR count(*) FILTER (WHERE side = 'R') < 3 AS one
     FROM f_band GROUP BY doc_id, page, band_kind, band_no""",
                  "f_bord": """SELECT *, NOT (one AND coalesce(lag(one) OVER w, false)) AS s, greatest(40, coalesce(max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 40)) AS ref
     FROM f_bsum WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, e)"""}


@query("sections", """SELECT doc_id, page, section_no::BIGINT AS section_no, CASE WHEN bool_or(one) THEN 1 ELSE 2 END AS n_cols, max(CASE WHEN s THEN greatest(0, y0 - ref) END)::DOUBLE AS before_space, min(y0) AS y0, max(y1) AS y1, sum(n)::BIGINT AS n_elements
FROM (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, e) AS section_no FROM f_bord) GROUP BY doc_id, page, section_no""", _SECT)
def _(spark, d):
    return D.sections(D.assign_bands(*_gutters(spark, d)), 40.0)


_HF = {"f_hf": """SELECT doc_id, page, line_no % 12 + 1 AS el_id, text, 72 AS x0, 72 + 400 * length(text) // extent AS x1, 120 + 50 * (line_no % 12) AS y0, 132 + 50 * (line_no % 12) AS y1 FROM f_sized WHERE trim(text) <> ''
   UNION ALL SELECT doc_id, page, 0, 'Report ' || source || ' ' || (page + 1), 72, 200, 30, 40 FROM (SELECT DISTINCT doc_id, page FROM f_lines) JOIN documents USING (doc_id)
   UNION ALL SELECT doc_id, page, 99, '- ' || (page + 1) || ' -', 290, 310, 800, 810 FROM (SELECT DISTINCT doc_id, page FROM f_lines)
   UNION ALL SELECT doc_id, page, 50, 'draft', 400, 500, 32, 42 FROM (SELECT DISTINCT doc_id, page FROM f_lines) WHERE page % 3 = 1""",
       "f_zone": r"""SELECT *, CASE WHEN y1 <= 0.12 * 842 THEN 'top' WHEN y0 >= 0.88 * 842 THEN 'bottom' END AS zone, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '#', 'g') AS nt, round_even(y0 / 6.0, 0)::BIGINT AS b FROM f_hf""",
       "f_seen": "SELECT doc_id, zone, nt, b, count(*) AS seen FROM f_zone WHERE zone IS NOT NULL GROUP BY doc_id, zone, nt, b",
       "f_found": """SELECT z.* FROM f_zone z JOIN f_seen s ON z.doc_id = s.doc_id AND z.zone = s.zone AND z.nt = s.nt AND z.b = s.b JOIN (SELECT doc_id, max(page) + 1 AS n FROM f_lines GROUP BY doc_id) c ON c.doc_id = z.doc_id
          WHERE ((n >= 2 AND seen >= greatest(2, 0.4 * n)) OR (z.el_id = 99)) AND NOT EXISTS (SELECT 1 FROM f_hf o WHERE o.doc_id = z.doc_id AND o.page = z.page AND o.el_id <> z.el_id AND least(o.y1, z.y1) - greatest(o.y0, z.y0) > 0.5 * least(o.y1 - o.y0, z.y1 - z.y0))""",
       "f_rest": "SELECT h.doc_id, h.page, min(y0) AS body_top, max(y1) AS body_bottom FROM f_hf h WHERE NOT EXISTS (SELECT 1 FROM f_found f WHERE f.doc_id = h.doc_id AND f.page = h.page AND f.el_id = h.el_id) GROUP BY h.doc_id, h.page"}


def _hf(spark, d):
    ln = V.lines(spark, d)
    pages = ln.select("doc_id", "page").distinct()
    src = table(spark, d, "documents").select("doc_id", "source")
    body = D.text_extent(ln, F.length("text")).selectExpr("doc_id", "page", "line_no % 12 + 1 as el_id", "text", "72 as x0", "72 + 400 * length(text) div extent as x1", "120 + 50 * (line_no % 12) as y0", "132 + 50 * (line_no % 12) as y1")
    head = pages.join(src, "doc_id").selectExpr("doc_id", "page", "0 as el_id", "concat('Report ', source, ' ', page + 1) as text", "72 as x0", "200 as x1", "30 as y0", "40 as y1")
    foot = pages.selectExpr("doc_id", "page", "99 as el_id", "concat('- ', page + 1, ' -') as text", "290 as x0", "310 as x1", "800 as y0", "810 as y1")
    draft = pages.filter("page % 3 = 1").selectExpr("doc_id", "page", "50 as el_id", "'draft' as text", "400 as x0", "500 as x1", "32 as y0", "42 as y1")
    return (body.unionByName(head).unionByName(foot).unionByName(draft).withColumn("horizontal", F.lit(True))
            .withColumn("page_w", F.lit(595)).withColumn("page_h", F.lit(842)))


def running_headers(spark, d):
    n = V.lines(spark, d).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    return D.running_headers(_hf(spark, d), n)


@query("running_headers", """SELECT f.doc_id, f.page, el_id, zone, text, CASE WHEN abs((x0 + x1) / 2.0 - 297.5) < 0.12 * 595 THEN 'center' WHEN (x0 + x1) / 2.0 > 297.5 THEN 'right' ELSE 'left' END AS align
FROM f_found f JOIN f_rest r ON f.doc_id = r.doc_id AND f.page = r.page WHERE CASE WHEN zone = 'top' THEN y1 <= body_top ELSE y0 >= body_bottom END""", _HF)
def _(spark, d):
    return running_headers(spark, d).select("doc_id", "page", "el_id", "zone", "text", "align")


_NUMS = ["page {}", "{} / 10", "- {} -", "({})", "p.{}", "{} of 9", "{}쪽", "x{}", "Page {} end", "—{}—", "{} 페이지"]
_PG = {"f_pg": "SELECT doc_id, line_no, replace([" + ",".join(f"'{x}'" for x in _NUMS) + "][(doc_id + line_no) % 11 + 1], '{}', CAST(line_no AS VARCHAR)) AS text FROM f_lines"}


@query("page_number", r"""SELECT doc_id, line_no, CASE WHEN m THEN regexp_extract(text, p, 1) END AS pre, CASE WHEN m THEN regexp_extract(text, p, 2) END AS num, CASE WHEN m THEN regexp_extract(text, p, 3) END AS post
FROM (SELECT *, '(?i)^([-–—(\[]?\s*(?:page|p\.)?\s*)(\d{1,4})(\s*(?:/\s*\d{1,4}|of\s+\d{1,4})?\s*(?:쪽|페이지|면)?\s*[-–—)\]]?)$' AS p, regexp_matches(text, p) AS m FROM f_pg)""", _PG)
def _(spark, d):
    t = F.replace(F.element_at(F.array(*[F.lit(x) for x in _NUMS]), F.expr("cast((doc_id + line_no) % 11 as int) + 1")), F.lit("{}"), F.col("line_no").cast("string"))
    return V.lines(spark, d).select("doc_id", "line_no", D.page_number(t).alias("p")).select("doc_id", "line_no", "p.pre", "p.num", "p.post")


@query("norm_text", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '#', 'g') AS norm FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", D.norm_text(F.col("text")).alias("norm"))


@query("line_align", "SELECT doc_id, el_id, CASE WHEN abs((x0 + x1) / 2.0::DOUBLE - 297.5) < 0.12::DOUBLE * 595 THEN 'center' WHEN (x0 + x1) / 2.0::DOUBLE > 297.5 THEN 'right' ELSE 'left' END AS align FROM f_elements")
def _(spark, d):
    return V.elements(spark, d).select("doc_id", "el_id", D.line_align(F.col("x0"), F.col("x1"), F.lit(595)).alias("align"))


_MARG = {"f_marg": """SELECT doc_id, page, (20 + doc_id % 30)::DOUBLE AS top, (10 + doc_id % 40)::DOUBLE AS bottom, count(*) * 7.0::DOUBLE AS v0, 842 - 9.0::DOUBLE * count(*) AS v1, CASE WHEN page % 3 <> 0 OR doc_id % 2 = 0 THEN (doc_id % 20)::DOUBLE END AS hy0,
   CASE WHEN page % 3 <> 0 OR doc_id % 2 = 0 THEN (doc_id % 20 + 9)::DOUBLE END AS hy1, CASE WHEN doc_id % 3 > 0 THEN (842 - doc_id % 25)::DOUBLE - 8 END AS fy0, CASE WHEN doc_id % 3 > 0 THEN (842 - doc_id % 25)::DOUBLE END AS fy1 FROM f_lines GROUP BY doc_id, page""",
         "f_marg2": "SELECT *, CASE WHEN hy0 IS NULL THEN top ELSE least(greatest(top, 13), greatest(v0 - 1, 1)) END AS nt, CASE WHEN fy0 IS NULL THEN bottom ELSE least(greatest(bottom, 12), greatest(842 - v1 - 1, 1)) END AS nb FROM f_marg"}


@query("page_margins", """SELECT doc_id, page, nt AS new_top, nb AS new_bottom, CASE WHEN hy0 IS NOT NULL THEN greatest(2, least(hy0, nt - 10)) END AS header_distance,
  CASE WHEN fy0 IS NOT NULL THEN greatest(2, least(842 - fy1, nb - 9)) END AS footer_distance FROM f_marg2""", _MARG)
def _(spark, d):
    has_head, has_foot = "page % 3 <> 0 or doc_id % 2 = 0", "doc_id % 3 > 0"
    p = V.lines(spark, d).groupBy("doc_id", "page").agg(F.count("*").alias("n")).selectExpr(
        "doc_id", "page", "cast(20 + doc_id % 30 as double) as top", "cast(10 + doc_id % 40 as double) as bottom", "842D as page_h", "n * 7D as v0", "842 - 9D * n as v1",
        f"case when {has_head} then cast(doc_id % 20 as double) end as head_y0", f"case when {has_head} then cast(doc_id % 20 + 9 as double) end as head_y1",
        f"case when {has_foot} then 842D - doc_id % 25 - 8 end as foot_y0", f"case when {has_foot} then 842D - doc_id % 25 end as foot_y1")
    return D.page_margins(p).select("doc_id", "page", "new_top", "new_bottom", "header_distance", "footer_distance")


@query("is_figure_region", """SELECT doc_id, page, n = 0 OR (c <= 300 AND l <= greatest(1, n // 6)) AS is_figure FROM (SELECT doc_id, page, count(*) FILTER (WHERE trim(text) <> '') AS n, sum(length(trim(text))) AS c,
  count(*) FILTER (WHERE length(trim(text)) > 25) AS l FROM f_lines GROUP BY doc_id, page)""")
def _(spark, d):
    return D.is_figure_region(V.lines(spark, d), D.PAGE)


def _regions(spark, d):
    return V.elements(spark, d).filter("el_id % 12 in (5, 9)").selectExpr("doc_id", "page", "el_id as region_no", "x0", "y0 - 20 as y0", "x1 + 10 as x1", "y1 + 20 as y1")


# The rule once more as a fold over the labels in SQL: each label in turn, three rounds, the box as four numbers.
_GROW = {"f_words": "SELECT doc_id, page, line_no * 4294967296 + item_no AS label_no, x AS x0, y AS y0, x + width AS x1, y + 10 AS y1, str, 10 - item_no % 3 AS size FROM f_items",
         "f_body10": "SELECT doc_id, page, list(size ORDER BY size) AS s FROM f_words WHERE trim(str) <> '' GROUP BY doc_id, page",
         "f_labels": """SELECT w.doc_id, w.page, list([x0, y0, x1, y1]::DOUBLE[] ORDER BY label_no) AS l FROM f_words w LEFT JOIN f_body10 b ON w.doc_id = b.doc_id AND w.page = b.page
            WHERE length(trim(str)) <= 20 AND size <= coalesce(s[len(s) // 2 + 1], 10) AND x1 > x0 AND y1 > y0 GROUP BY w.doc_id, w.page""",
         "f_start": "SELECT doc_id, page, el_id AS region_no, [x0, y0 - 20, x1 + 10, y1 + 20]::DOUBLE[] AS r FROM f_elements WHERE el_id % 12 IN (5, 9)",
         "f_grown": """SELECT f.doc_id, f.page, region_no, CASE WHEN r[3] - r[1] > 30 AND r[4] - r[2] > 30 THEN list_reduce(list_concat([r], coalesce(l, []), coalesce(l, []), coalesce(l, [])),
              lambda a, b: CASE WHEN NOT (b[1] >= a[1] AND b[2] >= a[2] AND b[3] <= a[3] AND b[4] <= a[4]) AND b[1] < a[3] + 10 AND b[3] > a[1] - 10 AND b[2] < a[4] + 10 AND b[4] > a[2] - 10
                THEN [least(a[1], b[1]), least(a[2], b[2]), greatest(a[3], b[3]), greatest(a[4], b[4])] ELSE a END) ELSE r END AS g
            FROM f_start f LEFT JOIN f_labels t ON f.doc_id = t.doc_id AND f.page = t.page"""}


@query("grow_regions", "SELECT doc_id, page, region_no, g[1] AS x0, g[2] AS y0, g[3] AS x1, g[4] AS y1 FROM f_grown", _GROW)
def _(spark, d):
    w = V.items(spark, d).selectExpr("doc_id", "page", "line_no * 4294967296L + item_no as label_no", "x as x0", "y as y0", "x + width as x1", "y + 10 as y1", "str as text", "10 - item_no % 3 as size")
    return D.grow_regions(_regions(spark, d), w, w.filter("trim(text) <> ''").select("doc_id", "page", "size"))


@query("text_outside_figures", """SELECT doc_id, page, el_id FROM f_elements l WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, page, x0, y0 - 20 AS y0, x1 + 10 AS x1, y1 + 20 AS y1 FROM f_elements WHERE el_id % 12 IN (5, 9)) r WHERE r.doc_id = l.doc_id AND r.page = l.page AND
  ((l.x0 >= r.x0 AND l.y0 >= r.y0 AND l.x1 <= r.x1 AND l.y1 <= r.y1) OR greatest(least(l.x1, r.x1) - greatest(l.x0, r.x0), 0) * greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0) > 0.8 * (l.x1 - l.x0) * (l.y1 - l.y0)))""")
def _(spark, d):
    return D.text_outside_figures(V.elements(spark, d), _regions(spark, d)).select("doc_id", "page", "el_id")



_CELL = {"f_ctext": "SELECT tbl, col, r, x0, x1, repeat(' ', (l_partkey % 3)::INT) || CASE WHEN col = 1 AND r % 2 = 0 THEN 'to tal' ELSE '' END || qty || CASE WHEN l_partkey % 2 = 1 THEN ' ' ELSE '' END AS text FROM f_cellboxes",
         "f_cink": "SELECT *, x0 + 6 * (length(text) - length(ltrim(text))) AS i0, x0 + 6 * length(rtrim(text)) AS i1, trim(text) AS t FROM f_ctext",
         "f_cell": """SELECT tbl, col, count(*) AS n, bool_and(t = text) AS tight, bool_and(NOT contains(t, ' ')) AS words, min(i0) AS a0, max(i0) AS a1, min(i1) AS b0, max(i1) AS b1, min((i0 + i1) / 2.0::DOUBLE) AS c0, max((i0 + i1) / 2.0::DOUBLE) AS c1,
            72 + 100 * col AS x0, 160 + 100 * col AS x1 FROM f_cink GROUP BY tbl, col""",
         "f_calc": "SELECT *, a0 - x0 AS dl, x1 - b1 AS dr, n = 1 AND NOT tight AS one, n > 1 AND words AND (a1 - a0 <= 1 OR b1 - b0 <= 1 OR c1 - c0 <= 2) AS many FROM f_cell",
         "f_align": """SELECT *, CASE WHEN one THEN CASE WHEN abs(dl - dr) / 2.0 < 2 THEN 'center' WHEN dl <= 0.25 * (x1 - x0) THEN 'left' ELSE 'right' END
            WHEN many THEN CASE WHEN a1 - a0 <= 1 AND b1 - b0 <= 1 THEN CASE WHEN abs(dl - dr) / 2.0 < 2 THEN 'center' WHEN dl < dr THEN 'left' ELSE 'right' END WHEN b1 - b0 <= 1 THEN 'right' WHEN c1 - c0 <= 2 THEN 'center' ELSE 'left' END
            ELSE 'justify' END AS align FROM f_calc"""}


def _cell_rows(spark, d):
    b = V.cellboxes(spark, d).selectExpr("tbl", "col", "r as row_no", "x0", "concat(repeat(' ', cast(l_partkey % 3 as int)), if(col = 1 and r % 2 = 0, 'to tal', ''), qty, if(l_partkey % 2 = 1, ' ', '')) as text")
    return b


def _aligned(spark, d):
    ch = _cell_rows(spark, d).select("tbl", "col", "row_no", "x0", F.posexplode(F.split("text", "")).alias("char_no", "c")).selectExpr(
        "tbl", "col", "row_no", "char_no", "c", "x0 + 6 * char_no as x0", "x0 + 6 * char_no + 6 as x1")
    rows = D.ink_rows(ch, ["tbl", "col", "row_no"])
    cells = rows.select("tbl", "col").distinct().selectExpr("tbl", "col", "72D + 100 * col as x0", "160D + 100 * col as x1", "'justify' as prior")
    return rows, D.cell_alignment(rows, cells, ["tbl", "col"])


@query("cell_alignment", """SELECT tbl, col, align, many AS hard_rows, CASE WHEN one OR (many AND align = 'left') THEN greatest(0, dl)::DOUBLE WHEN many THEN 0::DOUBLE END AS left_space,
  CASE WHEN one OR (many AND align = 'right') THEN greatest(0, dr)::DOUBLE WHEN many THEN 0::DOUBLE END AS right_space FROM f_align""", _CELL)
def _(spark, d):
    return _aligned(spark, d)[1]


@query("hard_breaks", "SELECT c.tbl, c.col, r AS row_no, many AND r < max(r) OVER (PARTITION BY c.tbl, c.col) AS line_break FROM f_ctext c JOIN f_align a ON c.tbl = a.tbl AND c.col = a.col", _CELL)
def _(spark, d):
    rows, al = _aligned(spark, d)
    return D.hard_breaks(rows.join(al, ["tbl", "col"]), ["tbl", "col"]).select("tbl", "col", "row_no", "line_break")


@query("trim_cell_edges", """SELECT tbl, col, row_no, CASE WHEN h AND e THEN trim(text) WHEN h THEN ltrim(text) WHEN e THEN rtrim(text) ELSE text END AS text FROM (
  SELECT tbl, col, r AS row_no, text, coalesce((lag(r) OVER w) % 3 = 0, true) AS h, r % 3 = 0 OR lead(r) OVER w IS NULL AS e FROM f_ctext WINDOW w AS (PARTITION BY tbl, col ORDER BY r))""", _CELL)
def _(spark, d):
    return D.trim_cell_edges(_cell_rows(spark, d).withColumn("line_break", F.expr("row_no % 3 = 0")), ["tbl", "col"]).select("tbl", "col", "row_no", "text")


_PATHS = {"f_path": "SELECT doc_id, page, el_id AS path_no, el_id % 12 NOT IN (3, 7) OR doc_id % 2 = 0 AS axis, x0, y0, CASE WHEN el_id % 12 = 3 THEN x0 + 4 ELSE x1 END AS x1, CASE WHEN el_id % 12 = 3 THEN y0 + 4 ELSE y1 END AS y1 FROM f_elements",
          "f_grp": "SELECT DISTINCT doc_id, page, unnest([0, 1]) AS g FROM f_elements",
          "f_own": """SELECT p.*, CASE WHEN x0 < 310 AND x1 > 60 THEN 0 ELSE 1 END AS g FROM f_path p""",
          "f_psum": """SELECT doc_id, page, g, count(*) FILTER (WHERE tiny) AS ns, count(*) FILTER (WHERE NOT tiny) AS nr, bool_and(axis) FILTER (WHERE NOT tiny) AS ax FROM (SELECT *, NOT axis AND greatest(x1 - x0, y1 - y0) <= 6 AS tiny FROM f_own
             WHERE NOT (g = 0 AND x0 >= 60 AND x1 <= 310 AND y0 >= 740 AND y1 <= 760)) GROUP BY doc_id, page, g"""}


@query("classify_path_groups", "SELECT doc_id, page, g AS group_no, CASE WHEN coalesce(nr, 0) > 0 AND coalesce(ax, false) THEN 'table' ELSE 'picture' END AS kind, coalesce(ns, 0) AS n_small FROM f_grp LEFT JOIN f_psum USING (doc_id, page, g)", _PATHS)
def _(spark, d):
    e = V.elements(spark, d)
    paths = e.selectExpr("doc_id", "page", "el_id as path_no", "el_id % 12 not in (3, 7) or doc_id % 2 = 0 as axis", "x0", "y0", "if(el_id % 12 = 3, x0 + 4, x1) as x1", "if(el_id % 12 = 3, y0 + 4, y1) as y1")
    pages = e.select("doc_id", "page").distinct()
    groups = pages.select("doc_id", "page", F.expr("inline(array(struct(0, 60, 0, 310, 900), struct(1, 310, 0, 560, 900)))")).toDF("doc_id", "page", "group_no", "x0", "y0", "x1", "y1")
    inner = pages.selectExpr("doc_id", "page", "0 as group_no", "60 as x0", "740 as y0", "310 as x1", "760 as y1")
    return D.classify_path_groups(paths, groups, inner)
