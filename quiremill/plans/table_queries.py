"""E: tables."""

from pyspark.sql import functions as F

from ..operators import tables as T
from ..rules import xlsx as X
from ..sources import views as V
from ..sources.tables import table
from .registry import query


def _join(c):
    """Cells as one string with nulls kept apart from empty text."""
    return F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("∅"))), "¦")


_J = "array_to_string(list_transform({0}, lambda x: coalesce(x, '∅')), '¦')"
_CLEAN = {"f_clean": r"SELECT doc_id, table_no, row_no, list_transform(cells, lambda c: trim(regexp_replace(c, '[ \t]+', ' ', 'g'))) AS cells FROM f_tables"}


def _rows(spark, d):
    return T.clean_cells(V.table_rows(spark, d))


@query("clean_cells", rf"SELECT doc_id, row_no, {_J.format('cells')} AS cells FROM (SELECT doc_id, row_no, list_transform(cells, lambda c: trim(regexp_replace(c, '[ \t]+', ' ', 'g'))) AS cells FROM f_cells)")
def _(spark, d):
    return T.clean_cells(V.cells(spark, d)).select("doc_id", "row_no", _join("cells").alias("cells"))


_SPANS = {"f_spans": "SELECT doc_id, page, line_no, item_no, str, x + 20 * (item_no // 4) AS x0, x + 20 * (item_no // 4) + width + CASE WHEN item_no % 3 = 0 THEN 5 ELSE 0 END AS x1 FROM f_items WHERE trim(str) <> ''",
          "f_textrows": r"""SELECT doc_id, page, line_no, list(t ORDER BY cell) AS cells FROM (
    SELECT doc_id, page, line_no, cell, trim(regexp_replace(string_agg(CASE WHEN gap > 15 OR gap IS NULL OR gap <= 1.5 THEN '' ELSE ' ' END || str, '' ORDER BY item_no), '[ \t]+', ' ', 'g')) AS t
    FROM (SELECT *, sum((coalesce(gap, 99) > 15)::INT) OVER (PARTITION BY doc_id, line_no ORDER BY item_no) AS cell FROM (
      SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY item_no) AS gap FROM f_spans)) GROUP BY doc_id, page, line_no, cell) GROUP BY doc_id, page, line_no"""}


def _text_rows(spark, d):
    s = V.items(spark, d).select("doc_id", "page", "line_no", "item_no", "str", F.expr("x + 20 * (item_no div 4)").alias("x0"), "size",
                                 F.expr("x + 20 * (item_no div 4) + width + case when item_no % 3 = 0 then 5 else 0 end").alias("x1"))
    return T.text_rows(s, ["doc_id", "page", "line_no"], "item_no")


@query("text_rows", f"SELECT doc_id, page, line_no, {_J.format('cells')} AS cells FROM f_textrows", _SPANS)
def _(spark, d):
    return _text_rows(spark, d).select("doc_id", "page", "line_no", _join("cells").alias("cells"))


_METHOD = "CASE WHEN doc_id % 3 = 0 THEN 'ruled' WHEN doc_id % 3 = 1 THEN 'aligned' ELSE 'text' END"
_EMPTIED = "CASE WHEN table_no % 7 = 0 THEN array(cast(null as string), '') ELSE cells END"
_METHODS = _CLEAN | {"f_methods": f"SELECT doc_id, table_no, {_METHOD} AS method, row_no, CASE WHEN table_no % 7 = 0 THEN [NULL, ''] ELSE cells END AS cells FROM f_clean"}


@query("nonempty_tables", f"""SELECT doc_id, table_no, row_no, {_J.format('cells')} AS cells FROM f_methods WHERE (doc_id, table_no) IN (
  SELECT (doc_id, table_no) FROM f_methods GROUP BY doc_id, table_no, method HAVING max(len(list_filter(cells, lambda c: c IS NOT NULL AND c <> ''))) > 0
  AND (method <> 'aligned' OR (count(*) >= 2 AND max(len(cells)) >= 2)))""", _METHODS)
def _(spark, d):
    r = _rows(spark, d).select("doc_id", "table_no", F.expr(_METHOD).alias("method"), "row_no", F.expr(_EMPTIED).alias("cells"))
    return T.nonempty_tables(r).select("doc_id", "table_no", "row_no", _join("cells").alias("cells"))


_CASCADE = {"f_cascade": """SELECT o_custkey AS doc_id, o_orderkey AS table_no, CASE WHEN o_orderkey % 5 = 0 THEN 'ruled' WHEN o_orderkey % 5 < 3 THEN 'aligned' ELSE 'text' END AS method FROM orders"""}


@query("table_cascade", """SELECT doc_id, table_no, method, method = 'text' AS is_text FROM f_cascade c WHERE
  CASE WHEN (SELECT bool_or(method = 'ruled') FROM f_cascade x WHERE x.doc_id = c.doc_id) THEN method = 'ruled'
       WHEN (SELECT bool_or(method = 'aligned') FROM f_cascade x WHERE x.doc_id = c.doc_id) THEN method = 'aligned' ELSE true END""", _CASCADE)
def _(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey as doc_id", "o_orderkey as table_no",
                                             "case when o_orderkey % 5 = 0 then 'ruled' when o_orderkey % 5 < 3 then 'aligned' else 'text' end as method")
    return T.table_cascade(o).select("doc_id", "table_no", "method", "is_text")


_STITCH = _CLEAN | {
    "f_meta": "SELECT doc_id, table_no, max(len(cells)) AS cols, min_by(cells, row_no) AS first_row FROM f_clean GROUP BY doc_id, table_no",
    "f_isl": """SELECT *, sum(g::INT) OVER (PARTITION BY doc_id ORDER BY table_no) AS sheet_no FROM (SELECT *, coalesce(lag(cols) OVER (PARTITION BY doc_id ORDER BY table_no) <> cols, true) AS g FROM f_meta)""",
    "f_head": "SELECT doc_id, sheet_no, min(table_no) AS opener, min_by(first_row, table_no) AS head FROM f_isl GROUP BY doc_id, sheet_no",
    "f_stitched": """SELECT i.doc_id, i.sheet_no, i.cols, row_number() OVER (PARTITION BY i.doc_id, i.sheet_no ORDER BY c.table_no, c.row_no) AS row_no, cells
      FROM f_clean c JOIN f_isl i USING (doc_id, table_no) JOIN f_head h ON h.doc_id = i.doc_id AND h.sheet_no = i.sheet_no
      WHERE NOT (i.table_no <> opener AND i.first_row IS NOT DISTINCT FROM head AND c.row_no = (SELECT min(row_no) FROM f_clean z WHERE z.doc_id = c.doc_id AND z.table_no = c.table_no))"""}


def stitched(spark, d):
    return T.stitch_tables(_rows(spark, d))


@query("stitch_tables", f"SELECT doc_id, sheet_no::BIGINT AS sheet_no, cols, row_no, {_J.format('cells')} AS cells FROM f_stitched", _STITCH)
def stitch_tables(spark, d):
    return stitched(spark, d).select("doc_id", "sheet_no", "cols", "row_no", _join("cells").alias("cells"))


_NUM = r"'^[-+]?(?:0|[1-9]\d{0,2}(?:,\d{3})+|[1-9]\d*)(?:\.\d+)?$'"
_ONE = {"f_one": """SELECT doc_id, row_no, i, CASE WHEN row_no % 4 = 0 AND i = 1 THEN '0' || cells[2] WHEN row_no % 4 = 1 AND i = 1 THEN '-' || cells[2]
      WHEN row_no % 4 = 2 AND i = 1 THEN CAST(doc_id AS VARCHAR) WHEN row_no % 4 = 3 AND i = 1 THEN cells[2] || '0123456789012345678' ELSE cells[i + 1] END AS c FROM (SELECT *, unnest([0, 1, 2]) AS i FROM f_cells)"""}


def _one(spark, d):
    e = V.cells(spark, d).select("doc_id", "row_no", "cells", F.posexplode("cells").alias("i", "c0"))
    return e.select("doc_id", "row_no", "i", F.expr(
        "case when row_no % 4 = 0 and i = 1 then concat('0', cells[1]) when row_no % 4 = 1 and i = 1 then concat('-', cells[1]) "
        "when row_no % 4 = 2 and i = 1 then cast(doc_id as string) when row_no % 4 = 3 and i = 1 then concat(cells[1], '0123456789012345678') else c0 end").alias("c"))


@query("typed_cells", f"SELECT doc_id, row_no, i, coalesce(regexp_matches(c, {_NUM}), false) AS is_number, CASE WHEN regexp_matches(c, {_NUM}) THEN CAST(replace(c, ',', '') AS DOUBLE) END AS value FROM f_one", _ONE)
def _(spark, d):
    return _one(spark, d).select("doc_id", "row_no", "i", F.coalesce(T.is_number(F.col("c")), F.lit(False)).alias("is_number"),
                                 T.number_value(F.col("c")).cast("double").alias("value"))


@query("cell_style", f"SELECT doc_id, row_no, i, CASE WHEN regexp_matches(c, {_NUM}) AND contains(c, ',') THEN CASE WHEN contains(c, '.') THEN 3 ELSE 2 END ELSE 1 END AS style FROM f_one", _ONE)
def _(spark, d):
    return _one(spark, d).select("doc_id", "row_no", "i", T.cell_style(F.col("c")).alias("style"))


@query("column_widths", r"""SELECT doc_id, sheet_no::BIGINT AS sheet_no, col, greatest(6, max(CASE WHEN coalesce(c, '') = '' THEN 6 ELSE (SELECT max(least(60, length(l) + length(regexp_replace(l, '[\x{0}-\x{2e80}]', '', 'g')) + 2)) FROM (SELECT unnest(string_split(c, chr(10))) AS l)) END)) AS width
FROM (SELECT doc_id, sheet_no, unnest(cells) AS c, unnest(range(len(cells))) AS col FROM f_stitched) GROUP BY doc_id, sheet_no, col""", _STITCH)
def _(spark, d):
    return T.column_widths(stitched(spark, d)).select("doc_id", "sheet_no", "col", "width")


@query("cell_refs", """SELECT l_orderkey AS o, l_linenumber AS n, i, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + i // 26 - 1) || chr(65 + i % 26)
  WHEN i < 18278 THEN chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + (i - 702) % 26)
  ELSE chr(65 + (i - 18278) // 17576) || chr(65 + (i - 18278) // 676 % 26) || chr(65 + (i - 18278) // 26 % 26) || chr(65 + (i - 18278) % 26) END || (l_linenumber + 1) AS ref
FROM (SELECT l_orderkey, l_linenumber, ((l_orderkey * 31 + l_partkey) % 475254)::INT AS i FROM lineitem)""")
def _(spark, d):
    c = table(spark, d, "lineitem").selectExpr("l_orderkey as o", "l_linenumber as n", "cast((l_orderkey * 31 + l_partkey) % 475254 as int) as i")
    return c.select("o", "n", "i", F.concat(T.col_name(F.col("i")), (F.col("n") + 1).cast("string")).alias("ref"))


@query("xml_escape", r"""SELECT page_id, replace(replace(replace(replace(regexp_replace(html || chr(1) || chr(9), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.xml_escape(F.concat("html", F.lit("\x01\t"))).alias("escaped"))


_MARK = _STITCH | {"f_cellx": rf"""SELECT doc_id, sheet_no, row_no, i, CASE WHEN coalesce(c, '') = '' THEN '' WHEN regexp_matches(c, {_NUM}) THEN '<c r="' || chr(65 + i::INT) || row_no || '" s="' ||
     CASE WHEN contains(c, ',') THEN CASE WHEN contains(c, '.') THEN 3 ELSE 2 END ELSE 1 END || '"><v>' || regexp_replace(regexp_replace(replace(c, ',', ''), '(\.\d*?)0+$', '\1'), '\.$', '') || '</v></c>'
     ELSE '<c r="' || chr(65 + i::INT) || row_no || '" s="1" t="inlineStr"><is><t xml:space="preserve">' || c || '</t></is></c>' END AS x
   FROM (SELECT doc_id, sheet_no, row_no, unnest(cells) AS c, unnest(range(len(cells))) AS i FROM f_stitched)""",
                    "f_colx": """SELECT doc_id, sheet_no, string_agg('<col min="' || (i + 1) || '" max="' || (i + 1) || '" width="' || w || '" customWidth="1"/>', '' ORDER BY i) AS cols
   FROM (SELECT doc_id, sheet_no, i, greatest(6, max(CASE WHEN coalesce(c, '') = '' THEN 6 ELSE least(60, length(c) + 2) END)) AS w
     FROM (SELECT doc_id, sheet_no, unnest(cells) AS c, unnest(range(len(cells))) AS i FROM f_stitched) GROUP BY doc_id, sheet_no, i) GROUP BY doc_id, sheet_no"""}


@query("sheet_markup", f"""SELECT b.doc_id, b.sheet_no::BIGINT AS sheet_no, '표' || b.sheet_no AS sheet_name, '{X.HEADER}<worksheet xmlns="{X.MAIN_NS}"><cols>' || cols || '</cols><sheetData>' || body || '</sheetData></worksheet>' AS xml
FROM (SELECT doc_id, sheet_no, string_agg('<row r="' || row_no || '">' || x || '</row>', '' ORDER BY row_no) AS body
      FROM (SELECT doc_id, sheet_no, row_no, string_agg(x, '' ORDER BY i) AS x FROM f_cellx GROUP BY doc_id, sheet_no, row_no) GROUP BY doc_id, sheet_no) b
JOIN f_colx c ON b.doc_id = c.doc_id AND b.sheet_no = c.sheet_no""", _MARK)
def _(spark, d):
    return T.sheet_markup(stitched(spark, d)).select("doc_id", "sheet_no", "sheet_name", "xml")


@query("sheet_pieces", f"""SELECT doc_id, sheet_no::BIGINT AS sheet_no, piece_no::BIGINT AS piece_no, (coalesce(sum(length(x)) OVER (PARTITION BY doc_id, sheet_no ORDER BY piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin, x AS text
FROM (SELECT doc_id, sheet_no, row_no AS piece_no, '<row r="' || row_no || '">' || string_agg(x, '' ORDER BY i) || '</row>' AS x FROM f_cellx GROUP BY doc_id, sheet_no, row_no
  UNION ALL SELECT doc_id, sheet_no, 0, '{X.HEADER}<worksheet xmlns="{X.MAIN_NS}"><cols>' || cols || '</cols><sheetData>' FROM f_colx
  UNION ALL SELECT doc_id, sheet_no, max(row_no) + 1, '</sheetData></worksheet>' FROM f_stitched GROUP BY doc_id, sheet_no)""", _MARK)
def _(spark, d):
    return T.sheet_pieces(stitched(spark, d)).select("doc_id", F.col("sheet_no").cast("long").alias("sheet_no"), "piece_no", "begin", "text")


@query("workbook_export", "SELECT doc_id, 5 + count(DISTINCT sheet_no) AS n_parts FROM f_stitched GROUP BY doc_id", _STITCH)
def _(spark, d):
    # the archive's closing record tells how many parts it holds
    n = F.conv(F.hex(F.concat(*[F.expr(f"substring(workbook, length(workbook) - {k}, 1)") for k in (10, 11)])), 16, 10)
    return T.workbook_export(T.sheet_markup(stitched(spark, d))).select("doc_id", n.cast("long").alias("n_parts"))


@query("csv_export", """SELECT doc_id, sheet_no::BIGINT AS sheet_no, row_no, CASE WHEN sheet_no = 1 AND row_no = 1 THEN chr(65279) ELSE '' END ||
  array_to_string(list_transform(cells, lambda c: CASE WHEN contains(coalesce(c, ''), ',') THEN '"' || c || '"' ELSE coalesce(c, '') END), ',') AS line FROM f_stitched""", _STITCH)
def _(spark, d):
    return T.csv_lines(stitched(spark, d)).select("doc_id", "sheet_no", "row_no", "line")


_CAND = {"f_cand": "SELECT * FROM f_cellboxes WHERE NOT (tbl % 3 = 0 AND col = 2) AND NOT (tbl % 5 = 0 AND col > 0)",
         "f_candlines": """SELECT tbl, r AS line_id, 75 AS x0, CASE WHEN tbl % 4 = 0 THEN 75 + 2 * qty ELSE 90 END AS x1, y0, y0 + 10 AS y1,
           CASE WHEN tbl % 2 = 0 THEN repeat('A', 3 + (l_partkey % 4)::INT) ELSE CAST(qty AS VARCHAR) END AS text FROM f_cellboxes WHERE col = 0""",
         "f_candmeta": "SELECT tbl, max(r) AS n_rows, count(DISTINCT col) AS n_cols, tbl % 2 = 1 AS in_cell FROM f_cand GROUP BY tbl",
         "f_straddle": """SELECT DISTINCT tbl FROM (SELECT l.tbl, l.line_id, c.r FROM f_candlines l JOIN f_cand c ON l.tbl = c.tbl
           AND least(l.y1, c.y1) - greatest(l.y0, c.y0) > 0.5 * (l.y1 - l.y0) AND least(l.x1, c.x1) - greatest(l.x0, c.x0) > 1 GROUP BY ALL HAVING count(*) > 1)"""}


def _cand(spark, d):
    boxes = V.cellboxes(spark, d)
    cand = boxes.filter("not (tbl % 3 = 0 and col = 2) and not (tbl % 5 = 0 and col > 0)")
    lines = boxes.filter("col = 0").selectExpr("tbl", "r as line_id", "75 as x0", "case when tbl % 4 = 0 then 75 + 2 * qty else 90 end as x1", "y0", "y0 + 10 as y1",
                                              "case when tbl % 2 = 0 then repeat('A', cast(3 + l_partkey % 4 as int)) else cast(qty as string) end as text")
    meta = cand.groupBy("tbl").agg(F.max("r").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols")).withColumn("in_cell", F.expr("tbl % 2 = 1"))
    return meta, lines, cand


@query("straddling_tables", "SELECT tbl FROM f_straddle", _CAND)
def _(spark, d):
    _, lines, cand = _cand(spark, d)
    return T.straddling_tables(lines, cand)


@query("filter_candidate_tables", """SELECT tbl, n_rows, n_cols FROM f_candmeta m WHERE NOT (in_cell AND n_rows * n_cols = 1) AND tbl NOT IN (SELECT tbl FROM f_straddle)
  AND NOT (n_cols = 2 AND coalesce((SELECT max(length(text)) <= 4 FROM f_candlines l WHERE l.tbl = m.tbl AND l.x1 <= 1 + (SELECT x1 FROM f_cand c WHERE c.tbl = m.tbl AND r = 1 AND col = 0)), false))""", _CAND)
def _(spark, d):
    return T.filter_candidate_tables(*_cand(spark, d)).select("tbl", "n_rows", "n_cols")


_BOUNDS = {"f_edges": """SELECT DISTINCT tbl, base, off FROM (SELECT tbl, 72 + 100 * col AS base, l_partkey % 4 AS off FROM f_cellboxes
   UNION ALL SELECT tbl, 160 + 100 * col, l_partkey % 4 FROM f_cellboxes)""",
           "f_kept": """SELECT tbl, base + off * 0.25::DOUBLE AS x FROM f_edges e WHERE off = (SELECT min(off) FROM f_edges z WHERE z.tbl = e.tbl AND z.base = e.base)
     OR (off = 3 AND EXISTS (SELECT 1 FROM f_edges z WHERE z.tbl = e.tbl AND z.base = e.base AND z.off = 0))""",
           "f_widths": """SELECT tbl, list(x ORDER BY x) AS b, list(w ORDER BY x) FILTER (WHERE w IS NOT NULL) AS w FROM (SELECT tbl, x, lead(x) OVER (PARTITION BY tbl ORDER BY x) - x AS w FROM f_kept) GROUP BY tbl"""}
_NUMS = "array_to_string(list_transform({0}, lambda v: CAST((v * 100)::BIGINT AS VARCHAR)), ',')"


def _bounds(spark, d):
    b = V.cellboxes(spark, d).selectExpr("tbl", "72 + 100 * col + 0.25D * (l_partkey % 4) as x0", "160 + 100 * col + 0.25D * (l_partkey % 4) as x1", "y0", "y1")
    return T.column_bounds(b)


def _hundredths(c):
    return F.array_join(F.transform(c, lambda v: (v * 100).cast("long").cast("string")), ",")


@query("column_bounds", f"SELECT tbl, {_NUMS.format('b')} AS bounds, {_NUMS.format('w')} AS widths FROM f_widths", _BOUNDS)
def _(spark, d):
    return _bounds(spark, d).select("tbl", _hundredths("bounds").alias("bounds"), _hundredths("widths").alias("widths"))


@query("fixed_grid", f"SELECT m.tbl, n_cols, CASE WHEN len(w) = n_cols THEN {_NUMS.format('w')} END AS widths FROM (SELECT tbl, CASE WHEN tbl % 2 = 0 THEN 5 ELSE 8 END AS n_cols FROM f_cellboxes GROUP BY tbl) m JOIN f_widths USING (tbl)", _BOUNDS)
def _(spark, d):
    meta = V.cellboxes(spark, d).select("tbl").distinct().selectExpr("tbl", "if(tbl % 2 = 0, 5, 8) as n_cols")
    return T.fixed_grid(_bounds(spark, d), meta).select("tbl", "n_cols", _hundredths("widths").alias("widths"))


@query("integer_attributes", """SELECT o, n, ord, attr, number, CASE attr WHEN 'val' THEN floor(number)::BIGINT WHEN 'sz' THEN greatest(2, round_even(number, 0)::BIGINT) ELSE round_even(number, 0)::BIGINT END AS whole
FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, 0 AS ord, 'val' AS attr, CAST('-' || (l_partkey % 90) || '.4' AS DOUBLE) AS number FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, 'sz', CAST((l_suppkey % 7) || '.5' AS DOUBLE) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 2, 'w', CAST((l_partkey % 1000) || '.5' AS DOUBLE) FROM lineitem)""")
def _(spark, d):
    m = table(spark, d, "lineitem").selectExpr("l_orderkey as o", "l_linenumber as n", "concat('<w:spacing w:val=\"-', l_partkey % 90, '.4\"/><w:top w:sz=\"', l_suppkey % 7, "
                                              "'.5\" w:space=\"0\"/><w:tblInd w:w=\"', l_partkey % 1000, '.5\"/>') as markup")
    return T.integer_attributes(m, ["o", "n"]).select("o", "n", "ord", "attr", "number", "whole")
