"""C: characters and runs."""

from pyspark.sql import functions as F

from ..functions.passes import also, choose, only, several
from ..operators import glyphs as C
from ..sources import views as V
from ..sources.tables import spread, table
from .registry import query


@query("normalize_bullets", "SELECT doc_id, replace(replace(text, 'e', '•'), 'a', '▪') AS text FROM documents")
def _(spark, d):
    marked = F.replace(F.replace("text", F.lit("e"), F.lit("")), F.lit("a"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", C.normalize_bullets(marked).alias("text"))


@query("synthetic_flags", """SELECT doc_id, page, line, count(*) FILTER (WHERE ((doc_id + span * 3 + char_no) % 1024)::INT & 516 <> 0 OR char_no % 11 = 10) AS n_synthetic
FROM f_chars GROUP BY doc_id, page, line""")
def _(spark, d):
    syn = C.synthetic_flag(F.expr("cast((doc_id + span * 3 + char_no) % 1024 as int)"), F.expr("char_no % 11 = 10"))
    return V.chars(spark, d).groupBy(*C.LINE).agg(F.count_if(syn).alias("n_synthetic"))


_SPANS = {"f_runs": """SELECT doc_id, page, line_no AS line, item_no AS span, str || ' ' AS text, (item_no // 3) % 2 AS font, (item_no // 5) % 2 AS flags, CASE WHEN item_no % 7 = 3 THEN 0.5 ELSE 0 END AS sp,
  x AS x0, x + width AS x1 FROM f_items""",
          "f_runno": """SELECT *, sum(CASE WHEN blank AND span > 0 THEN 0 WHEN pf IS NULL OR pf <> font OR pg <> flags OR pp <> sp THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY span) - 1 AS run
  FROM (SELECT *, trim(text) = '' AS blank, lag(font) OVER w AS pf, lag(flags) OVER w AS pg, lag(sp) OVER w AS pp FROM f_runs WINDOW w AS (PARTITION BY doc_id, line ORDER BY span))"""}


def _spans(spark, d):
    return V.items(spark, d).selectExpr(
        "doc_id", "page", "line_no as line", "item_no as span", "concat(str, ' ') as text", "if((item_no div 3) % 2 = 0, 'Arial', 'Batang') as font",
        "10.0D as size", "if((item_no div 5) % 2 = 0, 0, 16) as flags", "0 as color", "255 as alpha", "if(item_no % 7 = 3, 0.5D, 0D) as spacing",
        "x as x0", "y as y0", "x + width as x1", "y + 10 as y1")


@query("merge_runs", "SELECT doc_id, page, line, run::INT AS run, string_agg(text, '' ORDER BY span) AS text, count(*) AS n_spans, min(x0) AS x0, max(x1) AS x1 FROM f_runno GROUP BY doc_id, page, line, run", _SPANS)
def _(spark, d):
    return C.merge_runs(_spans(spark, d)).select(*C.LINE, "run", "text", "n_spans", "x0", "x1")


@query("bbox_union", "SELECT doc_id, page, line_no AS line, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + 10) AS y1 FROM f_items GROUP BY doc_id, page, line_no")
def _(spark, d):
    return C.bbox_union(_spans(spark, d), C.LINE)


def _pieces(spark, d):
    return V.items(spark, d).selectExpr(
        "doc_id", "page", "line_no * 4294967296L + item_no as piece_no", "x as x0", "x + width + if(item_no % 4 = 3, 0, 6) as x1",
        "y + item_no % 3 as y0", "y + 10 + item_no % 3 as y1", "10.0D as size")


@query("group_rows", "SELECT doc_id, page, min(line_no * 4294967296 + item_no) AS first_piece, count(*) AS n, min(y + item_no % 3) AS y0 FROM f_items GROUP BY doc_id, page, line_no")
def _(spark, d):
    r = C.group_rows(_pieces(spark, d))
    return r.groupBy("doc_id", "page", "row_key").agg(F.min("piece_no").alias("first_piece"), F.count("*").alias("n"), F.min("y0").alias("y0")).drop("row_key")


@query("group_pieces", "SELECT doc_id, page, min(line_no * 4294967296 + item_no) AS first_piece, count(*) AS n, max(x + width + CASE WHEN item_no % 4 = 3 THEN 0 ELSE 6 END) AS x1 FROM f_items GROUP BY doc_id, page, line_no, item_no // 4")
def _(spark, d):
    g = C.group_pieces(C.group_rows(_pieces(spark, d)))
    return (g.groupBy("doc_id", "page", "row_key", "group_key").agg(F.min("piece_no").alias("first_piece"), F.count("*").alias("n"), F.max("x1").alias("x1"))
            .drop("row_key", "group_key"))


@query("overprint_dedupe", """SELECT doc_id, page, line, o AS overprinted, CASE WHEN NOT o THEN CASE WHEN (doc_id + line) % 5 = 0 THEN replace(t, ' ', '  ') ELSE t END END AS text
FROM (SELECT doc_id, page, line_no AS line, (doc_id + line_no) % 17 = 0 AND trim(text) <> '' AS o, text || ' ' AS t FROM f_lines)""")
def _(spark, d):
    def blank(r):
        return r("c") == " "
    c = also(V.chars(spark, d), ("y0", "y1", "size", "font", "flags", "color", "syn"))
    dup = several(c, "s", [(lambda r: ~blank(r) & ((r("doc_id") + r("line")) % 17 == 0), [0, 1]), (lambda r: blank(r) & ((r("doc_id") + r("line")) % 5 == 0), [0, 2, 5])], [0])
    dup = also(dup, x0=lambda r: r("x0") + r("s"), x1=lambda r: r("x1") + r("s"))
    out = only(C.overprint_dedupe(dup, C.LINE, ["span", "char_no", "s"]), lambda r: r("keep"))
    whole = C.line_text(also(out, _c=lambda r: r("x0") + r("x1")), [*C.LINE, "overprinted"], ["_c", "span", "char_no", "s"])
    return whole.select(*C.LINE, "overprinted", F.when(~F.col("overprinted"), F.col("text")).alias("text"))


def _piece_chars(spark, d):
    kept = only(V.chars(spark, d), lambda r: ~((r("c") == " ") & (r("char_no") > 0) & (r("span") % 4 == 3)))
    return also(kept, ("line",), piece_no=lambda r: r("line") * (1 << 32) + r("span"), ord=lambda r: r("char_no"), horizontal=lambda r: (r("doc_id") + r("line")) % 7 != 3)


@query("merge_row_pieces", """SELECT doc_id, page, min(line * 4294967296 + span) AS line, string_agg(c, '' ORDER BY span, char_no) AS text FROM f_chars WHERE NOT (c = ' ' AND char_no > 0 AND span % 4 = 3)
GROUP BY doc_id, page, line, CASE WHEN (doc_id + line) % 7 = 3 THEN span ELSE span // 4 END""")
def _(spark, d):
    return C.line_text(C.merge_row_pieces(_piece_chars(spark, d)))


_LETTER = r"\p{L}"
_GAPS = {"f_tight": r"""SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY span, char_no) AS ord, c, x0 + 0.25::DOUBLE * ((char_no * 7 + span * 3) % 3) AS x0,
      x0 + 6 + 0.25::DOUBLE * ((char_no * 7 + span * 3) % 3) AS x1 FROM f_chars WHERE c <> ' '""",
         "f_gap": r"""SELECT *, CASE WHEN regexp_matches(c, '\p{L}') OR regexp_matches(lead(c) OVER w, '\p{L}') THEN (lead(x0) OVER w - x1) / 10 END AS gap FROM f_tight WINDOW w AS (PARTITION BY doc_id, line ORDER BY ord)""",
         "f_vals": r"""SELECT doc_id, line, list(gap ORDER BY gap) FILTER (WHERE gap IS NOT NULL) AS v, count(*) AS n, bool_or(regexp_matches(c, '\p{L}')) AS l FROM f_gap GROUP BY doc_id, line""",
         "f_cent": """SELECT doc_id, line, CASE WHEN n >= 3 AND l AND len(v) >= 2 AND v[len(v)] - v[1] >= 0.15 THEN list_reduce(list_concat([[v[1], v[len(v)]]], list_transform(range(20), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])),
            lambda a, b: [list_avg(list_filter(v, lambda q: q <= (a[1] + a[2]) / 2)), list_avg(list_filter(v, lambda q: q > (a[1] + a[2]) / 2))]) END AS k FROM f_vals"""}


@query("infer_word_spaces", """SELECT g.doc_id, g.page, g.line, string_agg(c || CASE WHEN k[2] - k[1] >= 0.15 AND gap > greatest((k[1] + k[2]) / 2, k[1] + 0.1) THEN ' ' ELSE '' END, '' ORDER BY ord) AS text
FROM f_gap g JOIN f_cent t ON g.doc_id = t.doc_id AND g.line = t.line GROUP BY g.doc_id, g.page, g.line""", _GAPS)
def infer_word_spaces(spark, d):
    def shift(r):
        return (r("char_no") * 7 + r("span") * 3) % 3 * 0.25
    c = also(only(V.chars(spark, d), lambda r: r("c") != " "), x0=lambda r: r("x0") + shift(r), x1=lambda r: r("x1") + shift(r))
    c = also(c, ("span", "char_no", "font", "flags", "color"), ord=_ord)
    return C.line_text(C.infer_word_spaces(c, _LETTER))


def _ord(r):
    return r("span") * (1 << 32) + r("char_no")


def _ordered(spark, d):
    return also(V.chars(spark, d), ord=_ord, size=lambda r: choose(r("span") % 2 == 0, 12, 10))


_SIDES = {"f_sides": """SELECT doc_id, page, line, span, char_no, c, syn, CASE WHEN span % 2 = 0 THEN 12 ELSE 10 END AS size, bool_or(c = ' ' AND NOT syn) OVER (PARTITION BY doc_id, line) AS really,
   lag(c) OVER w AS a, lead(c) OVER w AS b, lag(c, 2) OVER w AS aa, lead(c, 2) OVER w AS bb, lead(x0) OVER w - lag(x1) OVER w AS gap FROM f_chars WINDOW w AS (PARTITION BY doc_id, line ORDER BY span, char_no)"""}


@query("drop_autospace", """SELECT doc_id, page, line, string_agg(c, '' ORDER BY span, char_no) AS text FROM f_sides WHERE NOT coalesce(really AND syn AND a <> ' ' AND b <> ' ' AND gap / size < 0.6
  AND ((regexp_matches(a, '[a-mA-M]') AND regexp_matches(b, '[n-zN-Z]')) OR (NOT regexp_matches(a, '[a-mA-M]') AND regexp_matches(b, '[a-mA-M]') AND regexp_matches(a, '[n-zN-Z]'))), false)
GROUP BY doc_id, page, line""", _SIDES)
def _(spark, d):
    return C.line_text(C.drop_autospace(_ordered(spark, d), "[a-mA-M]", "[n-zN-Z]"))


@query("drop_dot_spaces", """SELECT doc_id, page, line, string_agg(c, '' ORDER BY span, char_no) AS text FROM f_sides WHERE NOT coalesce(syn AND a <> ' ' AND b <> ' ' AND gap / size < 1.0
  AND CASE WHEN a IN ('.', ',') THEN aa <> ' ' WHEN b IN ('.', ',') THEN bb <> ' ' ELSE false END, false) GROUP BY doc_id, page, line""", _SIDES)
def _(spark, d):
    return C.line_text(C.drop_dot_spaces(_ordered(spark, d), ".,"))


@query("char_spacing", """SELECT doc_id, page, line, span, CASE WHEN abs(coalesce(m, 0)) < 0.15 THEN 0 WHEN abs(s) >= 0.1 THEN round(s, 2) ELSE 0 END AS spacing FROM (
  SELECT *, CASE WHEN m > 0 THEN greatest(0, m * n / (n + 1) - 0.02::DOUBLE * 6.1::DOUBLE) ELSE m * n / (n + 1) - 0.02::DOUBLE * 6.1::DOUBLE END AS s FROM (
    SELECT doc_id, page, line, span, CASE WHEN count(*) > 2 THEN 0.26::DOUBLE * (span % 5 - 1) - 0.1::DOUBLE END AS m, count(*) - 2 AS n FROM f_chars GROUP BY doc_id, page, line, span))""")
def _(spark, d):
    c = _ordered(spark, d).withColumn("origin_x", F.expr("x0 + 0.26D * char_no * (span % 5 - 1)")).withColumn("x1", F.expr("x0 + 6.1D"))
    return C.char_spacing(c)


@query("drop_margin_stamps", """SELECT doc_id, page, el_id FROM (SELECT *, min(x0) FILTER (WHERE h) OVER w AS lo, max(x1) FILTER (WHERE h) OVER w AS hi FROM (
   SELECT doc_id, page, el_id, el_id % 5 <> 3 AS h, CASE WHEN el_id % 5 <> 3 THEN x0 WHEN el_id % 2 = 0 THEN 20 ELSE 200 END AS x0,
     CASE WHEN el_id % 5 <> 3 THEN x1 WHEN el_id % 2 = 0 THEN 30 ELSE 210 END AS x1, CASE WHEN el_id % 4 = 0 THEN 10 ELSE 100 END AS tall FROM f_elements) WINDOW w AS (PARTITION BY doc_id, page))
WHERE NOT coalesce(NOT h AND (x1 <= lo + 1 OR x0 >= hi - 1) AND tall > 3 * (x1 - x0), false)""")
def _(spark, d):
    e = V.elements(spark, d).selectExpr(
        "doc_id", "page", "el_id", "el_id % 5 <> 3 as horizontal", "case when el_id % 5 <> 3 then x0 when el_id % 2 = 0 then 20 else 200 end as x0",
        "case when el_id % 5 <> 3 then x1 when el_id % 2 = 0 then 30 else 210 end as x1", "y0", "y0 + if(el_id % 4 = 0, 10, 100) as y1")
    return C.drop_margin_stamps(e).select("doc_id", "page", "el_id")


@query("restore_spaces", """SELECT doc_id, page, line_no AS line, string_agg(str || CASE WHEN nxt IS NOT NULL AND (nxt % 3 = 0 OR (doc_id + length(str) - 1) % 3 <> 2) THEN ' ' ELSE '' END, '' ORDER BY item_no) AS text
FROM (SELECT *, lead(item_no) OVER (PARTITION BY doc_id, line_no ORDER BY item_no) AS nxt FROM f_items WHERE str <> '') GROUP BY doc_id, page, line_no""")
def _(spark, d):
    ch = only(V.chars(spark, d), lambda r: r("c") != " ")
    glyphs = also(ch, ("span", "char_no", "x0", "x1", "y0", "y1", "size", "font", "flags", "color", "syn"), ord=_ord, glyph_no=lambda r: r("line") * (1 << 32) + r("x0"),
                  x=lambda r: r("x0") + (r("doc_id") + r("char_no")) % 3 * 0.5, y=lambda r: r("y0") + 2)
    words = V.items(spark, d).filter("str <> ''").withColumn("run_no", F.expr("item_no div 3"))
    runs = words.groupBy("doc_id", "page", "line_no", "run_no").agg(F.min("x").alias("x"), F.first("y").alias("y"), F.expr("listagg(str, ' ') within group (order by item_no)").alias("text"))
    lead = F.col("run_no") > 0
    runs = runs.select("doc_id", "page", "run_no", "y", F.lit(6).alias("h"), F.when(lead, F.col("x") - 6).otherwise(F.col("x")).cast("double").alias("x"),
                       F.when(lead, F.concat(F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))
    runs = runs.withColumn("char_x", F.expr("transform(sequence(0, length(text) - 1), k -> 6D * k)"))
    return C.line_text(C.restore_spaces(glyphs, runs))


@query("match_marks_to_boxes", "SELECT doc_id, page, line_no * 2 AS mark_no, line_no AS circle_no FROM f_lines WHERE line_no % 4 <> 0 AND line_no % 5 <> 0")
def _(spark, d):
    ln = V.lines(spark, d)
    circles = ln.selectExpr("doc_id", "page", "line_no as circle_no", "72D + 4 * (line_no % 3) as cx", "y - 3D as cy", "if(line_no % 4 = 0, 3, 2) as r")
    marks = ln.selectExpr("doc_id", "page", "line_no", "y", "if(line_no % 5 = 0, 'x', '·') as text", "10D as size", "explode(array(0, 1)) as j").selectExpr(
        "doc_id", "page", "line_no * 2 + j as mark_no", "72D + 2 * j as x", "cast(y as double) as y", "size", "text")
    return C.match_marks_to_boxes(circles, marks)


_NAMES = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '맑은 고딕 ' || p_size WHEN 2 THEN 'Fönt ' || p_name WHEN 3 THEN '  ' ELSE NULL END"


@query("good_font_name", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 2 THEN {_NAMES} ELSE p_brand END AS font FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.chosen_font_name(F.col("p_brand"), F.expr(_NAMES)).alias("font"))


_DIRTY = "html || '&#' || (8364 + page_id % 50) || ';&#x1F600; &AMP;lt; &nbsp;x' || chr(8195) || 'y  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(10) || 'end ' || chr(10)"


@query("normalize_text", rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(replace(replace(replace(replace(replace(replace(replace({_DIRTY}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&#' || (8364 + page_id % 50) || ';', chr((8364 + page_id % 50)::INT)), '&#x1F600;', chr(128512)), '(?i)&amp;', '&', 'g'),
  '\p{{Zs}}', ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def _(spark, d):
    tail = F.expr("concat('&#', 8364 + page_id % 50, ';&#x1F600; &AMP;lt; &nbsp;x\\u2003y  \\r\\n\\r\\n\\n\\nend \\n')")
    return spread(table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", C.normalize_text(F.concat("html", tail)).alias("text"))


_TIDY = {"f_tchars": """SELECT *, lag(c) OVER w AS a, lead(c) OVER w AS b, lag(c, 2) OVER w AS aa, lead(c, 2) OVER w AS bb FROM (
   SELECT *, line * 4294967296 + CASE WHEN (doc_id + line) % 7 = 3 THEN span ELSE span // 4 * 4 END AS ml FROM f_chars WHERE NOT (c = ' ' AND char_no > 0 AND span % 4 = 3)) WINDOW w AS (PARTITION BY doc_id, ml ORDER BY span, char_no)""",
         "f_tspans": """SELECT doc_id, page, ml, span, font, flags, string_agg(c, '' ORDER BY char_no) AS text FROM f_tchars WHERE NOT coalesce(syn AND a <> ' ' AND b <> ' '
   AND CASE WHEN a IN ('.', ',') THEN aa <> ' ' WHEN b IN ('.', ',') THEN bb <> ' ' ELSE false END, false) GROUP BY doc_id, page, ml, span, font, flags""",
         "f_truns": """SELECT *, sum(g::INT) OVER (PARTITION BY doc_id, ml ORDER BY span) AS run FROM (SELECT *, coalesce(lag(font) OVER w <> font OR lag(flags) OVER w <> flags, false) AS g FROM f_tspans WINDOW w AS (PARTITION BY doc_id, ml ORDER BY span))"""}


@query("tidy_text", "SELECT doc_id, page, ml AS line, run::INT AS run, string_agg(text, '' ORDER BY span) AS text, font, flags FROM f_truns GROUP BY doc_id, page, ml, run, font, flags", _TIDY)
def _(spark, d):
    c = also(_piece_chars(spark, d), ("syn",), char_flags=lambda r: choose(r("syn", False), 4, 0), mark=lambda r: False,
             origin_x=lambda r: r("x0") * 1.0, x0=lambda r: r("x0") * 1.0, x1=lambda r: r("x1") * 1.0)
    return C.tidy_text(c, _LETTER, "[a-mA-M]", ".,").select("doc_id", "page", "line", "run", "text", "font", "flags")
