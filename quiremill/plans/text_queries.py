"""B: positioned text to document text."""

from pyspark.sql import functions as F

from ..operators import text as B
from ..sources import views as V
from .registry import query

_RAW = {"f_raw": """SELECT doc_id, page, line_no, line_no * 4294967296 + item_no AS item_no, str, x, y + CASE WHEN item_no % 5 = 2 THEN 2 ELSE 0 END AS y,
          width FROM f_items WHERE str <> ''"""}


def raw(spark, d):
    lift = F.expr("array(transform[0], transform[1], transform[2], transform[3], transform[4], "
                  "transform[5] + case when item_no % 4294967296 % 5 = 2 then 2 else 0 end)")
    return V.raw_items(spark, d).withColumn("transform", lift)


@query("text_items", "SELECT doc_id, page, item_no, str, x::DOUBLE AS x, y::DOUBLE AS y, 10.0::DOUBLE AS size FROM f_raw", _RAW)
def _(spark, d):
    return B.text_items(raw(spark, d)).select("doc_id", "page", "item_no", "str", "x", "y", "size")


@query("reading_order", "SELECT doc_id, page, item_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS read_no FROM f_raw", _RAW)
def _(spark, d):
    return B.reading_order(B.text_items(raw(spark, d))).select("doc_id", "page", "item_no", "read_no")


@query("assemble_lines", "SELECT doc_id, page, max(y)::DOUBLE AS y, count(*) AS n_items FROM f_raw GROUP BY doc_id, page, line_no", _RAW)
def _(spark, d):
    return (B.assemble_lines(B.text_items(raw(spark, d))).groupBy("doc_id", "page", "cluster", "sub")
            .agg(F.max("y").alias("y"), F.count("*").alias("n_items")).drop("cluster", "sub"))


_LINES = _RAW | {"f_text": """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS line_no, y, text FROM (
    SELECT doc_id, page, line_no, max(y)::DOUBLE AS y, trim(string_agg(str, ' ' ORDER BY x)) AS text FROM f_raw GROUP BY doc_id, page, line_no)""",
                 "f_para": r"""SELECT doc_id, page, para_no, count(*) AS n_lines, string_agg(CASE WHEN g THEN '' WHEN regexp_matches(pt, '[-\x{2010}]$') THEN '' ELSE ' ' END || text, '' ORDER BY line_no) AS text
    FROM (SELECT *, sum(g::INT) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS para_no FROM (
      SELECT *, lag(text) OVER w AS pt, coalesce(lag(y) OVER w - y >= 17, true) AS g FROM f_text WHERE text <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)))
    GROUP BY doc_id, page, para_no"""}


@query("line_text", "SELECT doc_id, page, line_no, y, text FROM f_text", _LINES)
def _(spark, d):
    return B.lines(B.text_items(raw(spark, d))).select("doc_id", "page", "line_no", "y", "text")


@query("paragraphs", "SELECT doc_id, page, para_no::BIGINT AS para_no, n_lines, text FROM f_para", _LINES)
def _(spark, d):
    return B.paragraphs(B.lines(B.text_items(raw(spark, d)))).select("doc_id", "page", "para_no", "n_lines", "text")


@query("page_text", """SELECT doc_id, page, coalesce(t, '') AS text FROM (SELECT DISTINCT doc_id, page FROM f_lines)
LEFT JOIN (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY para_no) AS t FROM f_para GROUP BY doc_id, page) USING (doc_id, page)""", _LINES)
def _(spark, d):
    pages = V.lines(spark, d).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    return B.page_text(B.paragraphs(B.lines(B.text_items(raw(spark, d)))), pages)


@query("document_text", """SELECT doc_id, string_agg(coalesce(t, ''), chr(10) || chr(10) ORDER BY page) AS text
FROM (SELECT DISTINCT doc_id, page FROM f_lines) LEFT JOIN (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY para_no) AS t FROM f_para GROUP BY doc_id, page) USING (doc_id, page)
GROUP BY doc_id""", _LINES)
def document_text(spark, d):
    paras = B.paragraphs(B.lines(B.text_items(raw(spark, d))))
    pages = V.lines(spark, d).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    return B.document_text(paras, pages)


@query("document_pieces", """SELECT doc_id, page::BIGINT AS piece_no, (coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin, t AS text
FROM (SELECT doc_id, page, CASE WHEN page = 0 THEN '' ELSE chr(10) || chr(10) END || coalesce(t, '') AS t FROM (SELECT DISTINCT doc_id, page FROM f_lines)
  LEFT JOIN (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY para_no) AS t FROM f_para GROUP BY doc_id, page) USING (doc_id, page))""", _LINES)
def document_pieces(spark, d):
    paras = B.paragraphs(B.lines(B.text_items(raw(spark, d))))
    pages = V.lines(spark, d).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    return B.document_pieces(paras, pages)
