import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quiremill.operators import layout as D
from quiremill.operators import tables as T
from quiremill.sources import sinks
from quiremill.sources import views as V


def test_list_markers(spark):
    yes = ["• x", "•x", "- item", "1. a", "(12) b", "a) c", "가. d", "①e", "Ⅳ f", "  ❖ g", "ⅱ. h"]
    no = ["-5% down", "1.5 x", "(ab) c", "word", "1234. x", ""]
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", D.is_list_start(F.col("t")).alias("got")).collect())


def test_paragraph_rules(spark):
    rows = [("First line of text", 100, 10, False), ("ends here.", 50, 10, False), ("Next begins", 100, 10, False), ("and - goes on.", 95, 10, False), ("- item", 99, 10, False),
            ("Big", 99, 13, False), ("Bold head", 40, 13, True), ("after", 90, 13, False)]
    df = spark.createDataFrame([(1, 0, i, 0, w, 0, 10, t, s, b) for i, (t, w, s, b) in enumerate(rows)],
                               "doc_id long, page int, row_no int, x0 int, x1 int, y0 int, y1 int, text string, size int, bold boolean")
    got = [r.para_no for r in D.split_paragraphs(df, D.PAGE).orderBy("row_no").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 3, 4]
    one = spark.createDataFrame([(1, 0, 0, 0, 5, 0, 10, "• only", 10, False)], df.schema)
    assert D.split_paragraphs(one, D.PAGE).first().para_no == 0


def test_usual_gap_prefers_the_first_seen(spark):
    # gaps 2, 2, 20, 20: equally frequent, the first seen (2) is usual
    ys = [(0, 10), (12, 22), (24, 34), (54, 64), (84, 94)]
    df = spark.createDataFrame([(1, 0, i, "line", a, b, 10) for i, (a, b) in enumerate(ys)], "doc_id long, page int, el_id int, kind string, y0 int, y1 int, height int")
    assert [r.block_no for r in D.join_lines(df).orderBy("el_id").collect()] == [1, 1, 1, 2, 3]


def brute_gutter(body, X0, X1):
    W = X1 - X0
    best, x = None, X0 + 0.3 * W
    while x <= X0 + 0.7 * W:
        cost = sum(h for a, b, h in body if a < x - 1 and x + 1 < b)
        if best is None or cost < best[0]:
            best = (cost, x)
        x += 1.0
    return best[1]


@pytest.mark.parametrize("seed", range(3))
def test_gutter_equals_testing_every_position(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for page in range(5):
        g = rnd.randint(280, 320)
        for i in range(40):
            left = rnd.random() < 0.5
            x0 = rnd.randint(60, 70) if left else g + rnd.randint(5, 12)
            x1 = g - rnd.randint(5, 40) if left else rnd.randint(500, 540)
            if i % 15 == 0:
                x0, x1 = 60, 540
            rows.append((1, page, i, True, "text", x0, i * 12, x1, i * 12 + rnd.choice([8, 10])))
        body = [(r[5], r[7], r[8] - r[6]) for r in rows if r[1] == page]
        want[page] = brute_gutter(body, 60.0, 540.0)
    df = spark.createDataFrame(rows, "doc_id long, page int, el_id int, horizontal boolean, text string, x0 int, y0 int, x1 int, y1 int")
    got = {r.page: r.gutter for r in D.find_gutter(df, (60.0, 540.0)).collect()}
    assert all(got[p] is not None and abs(got[p] - want[p]) < 1e-9 for p in want)


def test_sections_of_a_two_column_page(spark):
    rows = [(1, 0, 0, "line", 60, 0, 540, 10)] + [(1, 0, 1 + i, "line", 60 if i % 2 == 0 else 310, 20 + 12 * (i // 2), 290 if i % 2 == 0 else 540, 30 + 12 * (i // 2)) for i in range(24)]
    rows += [(1, 0, 90, "line", 60, 170, 540, 180), (1, 0, 91, "line", 60, 200, 200, 210)]
    df = spark.createDataFrame(rows, "doc_id long, page int, el_id int, kind string, x0 int, y0 int, x1 int, y1 int").withColumn("text", F.lit("words")).withColumn("horizontal", F.lit(True))
    s = D.sections(D.assign_bands(df, D.find_gutter(df, (60.0, 540.0))), -5.0).orderBy("section_no").collect()
    assert [(r.n_cols, r.n_elements, r.before_space) for r in s] == [(1, 1, 5.0), (2, 24, 10.0), (1, 2, 8.0)]


def hf_lines(spark, pages):
    rows = []
    for p, items in enumerate(pages):
        for i, (t, x0, y0, x1, y1) in enumerate(items):
            rows.append((1, p, i, t, float(x0), float(y0), float(x1), float(y1), True, 600.0, 800.0))
    return spark.createDataFrame(rows, "doc_id long, page int, el_id int, text string, x0 double, y0 double, x1 double, y1 double, horizontal boolean, page_w double, page_h double")


def test_running_headers_keep_the_body(spark):
    body = [("Some body text", 50, 200, 500, 212), ("More of it", 50, 220, 500, 232)]
    pages = [[("Chapter 1", 50, 30, 150, 40), *body, (f"- {n} -", 290, 770, 310, 780)] for n in range(1, 4)]
    pages.append([("Chapter 2", 50, 30, 150, 40), ("beside", 300, 31, 350, 41), *body])      # shares its row: stays body
    pages.append([("Chapter 3", 50, 30, 150, 40)])                                            # one line: skipped
    n = spark.createDataFrame([(1, 5)], "doc_id long, n_pages int")
    got = sorted((r.page, r.zone, r.text, r.align) for r in D.running_headers(hf_lines(spark, pages), n).collect())
    want = [(p, "bottom", f"- {p + 1} -", "center") for p in range(3)] + [(p, "top", "Chapter 1", "left") for p in range(3)]
    assert got == sorted(want)


def test_page_numbers(spark):
    df = spark.createDataFrame([("page 3",), ("3 / 10",), ("- 12 -",), ("7쪽",), ("12345",), ("p.4",), ("3 of 9",), ("chapter 3",)], "t string")
    got = [r.p.num if r.p else None for r in df.select(D.page_number(F.col("t")).alias("p")).collect()]
    assert got == ["3", "3", "12", "7", None, "4", "3", None]


def grown(box, labels, near=10, rounds=3):
    x0, y0, x1, y1 = box
    if x1 - x0 <= 30 or y1 - y0 <= 30:
        return box
    for _ in range(rounds):
        changed = False
        for a0, b0, a1, b1 in labels:
            if a0 >= x0 and b0 >= y0 and a1 <= x1 and b1 <= y1:
                continue
            if a0 < x1 + near and a1 > x0 - near and b0 < y1 + near and b1 > y0 - near:
                x0, y0, x1, y1 = min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1)
                changed = True
        if not changed:
            break
    return x0, y0, x1, y1


@pytest.mark.parametrize("seed", range(3))
def test_regions_grow_like_the_stated_rule(spark, seed):
    rnd = random.Random(seed)
    labels, regions = [], []
    for page in range(6):
        for i in range(30):
            x, y = rnd.randint(0, 300), rnd.randint(0, 300)
            labels.append((1, page, i, float(x), float(y), float(x + rnd.randint(3, 25)), float(y + 8), "ab" if rnd.random() < 0.8 else "a long line of body text", rnd.choice([8.0, 10.0, 14.0])))
        regions += [(1, page, 0, 100.0, 100.0, 160.0, 150.0), (1, page, 1, 10.0, 10.0, 30.0, 90.0)]
    ldf = spark.createDataFrame(labels, "doc_id long, page int, label_no int, x0 double, y0 double, x1 double, y1 double, text string, size double")
    rdf = spark.createDataFrame(regions, "doc_id long, page int, region_no int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.region_no): (r.x0, r.y0, r.x1, r.y1) for r in D.grow_regions(rdf, ldf, ldf.select("doc_id", "page", "size")).collect()}
    for page in range(6):
        mine = [lb for lb in labels if lb[1] == page]
        body = sorted(lb[8] for lb in mine)[len(mine) // 2]
        small = [lb[3:7] for lb in mine if len(lb[7]) <= 20 and lb[8] <= body]
        for r in (r for r in regions if r[1] == page):
            assert got[(page, r[2])] == grown(r[3:7], small)


def test_two_line_numbers_align_right(spark):
    rows = spark.createDataFrame([(1, 0, 40.0, 70.0, "182.6"), (1, 1, 30.0, 70.2, " (△35.4)")], "cell int, row_no int, ink0 double, ink1 double, text string")
    cells = spark.createDataFrame([(1, 0.0, 75.0, "left")], "cell int, x0 double, x1 double, prior string")
    r = D.cell_alignment(rows, cells, ["cell"]).first()
    assert (r.align, r.hard_rows, r.left_space) == ("right", True, 0.0) and r.right_space == pytest.approx(4.8)


# --- tables ------------------------------------------------------------------------------------------

def test_stitching(spark):
    head = ["a", "b"]
    t = {1: [head, ["1", "2"]], 2: [head, ["3", "4"]], 3: [["x", "y", "z"]], 4: [["q", None]], 5: [["r", ""], ["s", "t"]], 6: [["q", None], ["u", "v"]]}
    rows = [(7, no, i, cells) for no, rs in t.items() for i, cells in enumerate(rs)]
    got = T.stitch_tables(spark.createDataFrame(rows, "doc_id long, table_no int, row_no int, cells array<string>")).orderBy("sheet_no", "row_no").collect()
    assert [(r.sheet_name, r.row_no, r.cells) for r in got] == [
        ("표1", 1, head), ("표1", 2, ["1", "2"]), ("표1", 3, ["3", "4"]), ("표2", 1, ["x", "y", "z"]),
        ("표3", 1, ["q", None]), ("표3", 2, ["r", ""]), ("표3", 3, ["s", "t"]), ("표3", 4, ["u", "v"])]


def test_stitching_of_short_and_long_documents(spark):
    """Documents with more tables than one task should hold are stitched by the two-level helpers, others in a window."""
    rnd = random.Random(5)
    rows = [(doc, no * 40000 if doc else no, i, [rnd.choice("ab")] * (1 + (no * (doc or 1) // 3) % 2)) for doc in (None, 0, 1, 2, 3) for no in range(12 if doc == 1 else 5) for i in range(rnd.randint(1, 3))]
    tables = spark.createDataFrame(rows + rows[-2:], "doc_id long, table_no int, row_no int, cells array<string>")
    want = sorted(map(str, T.stitch_tables(tables).collect()))
    assert want and want == sorted(map(str, T.stitch_tables(tables, 5).collect())) == sorted(map(str, T.stitch_tables(tables, 0).collect()))


def test_table_rows_stay_where_they_stand(spark, tmp_path):
    """Line items and orders are read and exchanged once, by table; their summary needs no other exchange."""
    spark.createDataFrame([(o, 7 + o % 2) for o in (1, 2, 2, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o, n, o, 1, 10.0, 5.0, "A", "F") for o in (1, 2, 6, 9) for n in (0, 1)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = V.table_rows(spark, str(tmp_path))
    assert sorted((r.doc_id, r.table_no, r.row_no, len(r.cells)) for r in rows.collect()) == sorted(
        [(8, 1, 1, 3), (8, 1, 2, 3)] + [(7, 2, n, 3) for n in (0, 1, 2)] * 2 + [(7, 6, n, 2) for n in (0, 1, 2)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = T.stitch_tables(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # line items, orders, the summary by document, and both sides of the last join
    assert plan.count("FileScan") == 2 and plan.count("Exchange ") == 5
    summed = rows.groupBy("doc_id", "table_no").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" not in summed and summed.count("Exchange ") <= 2


@pytest.mark.parametrize("text, number", [("1,240", "1240"), ("-12.50", "-12.5"), ("+3", "3"), ("0.75", "0.75"), ("23.00", "23"), ("-0", "0"), ("100", "100"), ("12345678901234567890", "12345678901234567000")])
def test_numbers(spark, text, number):
    r = spark.createDataFrame([(text,)], "t string").select(T.is_number(F.col("t")).alias("is"), T.number_text(F.col("t")).alias("n")).first()
    assert r["is"] and (r.n == number or float(r.n) == float(number))


@pytest.mark.parametrize("text", ["007", "02-123-4567", "1,24", "1.", ".5", "", "1e5", "12 3"])
def test_not_numbers(spark, text):
    assert not spark.createDataFrame([(text,)], "t string").select(T.is_number(F.col("t")).alias("is")).first()["is"]


def test_column_names(spark):
    names = {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 16383: "XFD"}
    got = {r.i: r.n for r in spark.createDataFrame([(i,) for i in names], "i int").select("i", T.col_name(F.col("i")).alias("n")).collect()}
    assert got == names


def sheets(spark):
    rows = [(1, 1, "표1", 1, ["이름", "1,240", None]), (1, 1, "표1", 2, ["a & <b>", "007", 'say "x",\ny']), (1, 2, "표2", 1, ["only"])]
    return spark.createDataFrame(rows, "doc_id long, sheet_no long, sheet_name string, row_no long, cells array<string>").withColumn("cols", F.size("cells"))


def test_workbook_opens_and_types_cells(spark):
    blob = T.workbook_export(T.sheet_markup(sheets(spark))).first().workbook
    z = zipfile.ZipFile(io.BytesIO(bytes(blob)))
    assert z.testzip() is None and {"xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml", "xl/styles.xml"} <= set(z.namelist())
    xml = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="B1" s="2"><v>1240</v></c>' in xml and "a &amp; &lt;b&gt;" in xml and '<c r="C1"' not in xml
    assert '<c r="B2" s="1" t="inlineStr">' in xml and '<col min="1" max="1" width="9"' in xml
    import xml.dom.minidom as md
    for n in z.namelist():
        md.parseString(z.read(n))


def test_csv_lines_and_sink(spark, tmp_path):
    lines = T.csv_lines(sheets(spark))
    got = [r.line for r in lines.orderBy("sheet_no", "row_no").collect()]
    assert got == ['﻿이름,"1,240",', 'a & <b>,007,"say ""x"",\ny"', "only"]
    sinks.write_csv_lines(lines, str(tmp_path / "csv"))
    back = spark.read.parquet(str(tmp_path / "csv")).orderBy("sheet_no", "row_no")
    assert [r.line for r in back.collect()] == got and len({r.bucket for r in back.collect()}) == 1


def test_bounds_compare_with_the_last_kept_edge(spark):
    rows = [(1, 0.0, 10.0), (1, 0.4, 10.0), (1, 0.8, 10.3), (1, 20.0, 20.0)]
    df = spark.createDataFrame([(*r, 0.0, 5.0) for r in rows], "tbl int, x0 double, x1 double, y0 double, y1 double")
    r = T.column_bounds(df).first()
    assert r.bounds == [0.0, 0.8, 10.0] and r.widths == pytest.approx([0.8, 9.2])


def test_straddling_over_band_borders(spark):
    cells = spark.createDataFrame([(t, 1, c, 0.0 + 50 * c, 60.0, 45.0 + 50 * c, 70.0) for t in (1, 2) for c in (0, 1)], "tbl int, r int, col int, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([(1, 0, 5.0, 59.0, 90.0, 69.0, "wide"), (2, 0, 5.0, 59.0, 45.5, 69.0, "fits")], "tbl int, line_id int, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r.tbl for r in T.straddling_tables(lines, cells).collect()] == [1]


def test_text_rows_and_cascade(spark):
    spans = spark.createDataFrame([(1, "Date ", 0.0, 20.0, 10.0), (1, "and", 22.0, 30.0, 10.0), (1, "sum", 46.0, 60.0, 10.0), (1, "x", 61.0, 65.0, 10.0), (1, "  ", 66.0, 99.0, 10.0)],
                                  "line int, str string, x0 double, x1 double, size double")
    assert T.text_rows(spans, ["line"]).first().cells == ["Date and", "sumx"]
    t = spark.createDataFrame([(1, 1, "ruled"), (1, 2, "aligned"), (2, 1, "aligned"), (2, 2, "text"), (3, 1, "text")], "doc_id int, table_no int, method string")
    assert sorted((r.doc_id, r.method) for r in T.table_cascade(t).collect()) == [(1, "ruled"), (2, "aligned"), (3, "text")]


def test_tables_of_as_function(spark):
    from quiremill.operators import convert as U
    docs = json.dumps([{"page": 2, "rows": [["a", None], ["b", "c"]]}])
    spark.udtf.register("tables_of", U.tables_of_udtf())
    got = spark.sql(f"SELECT * FROM tables_of('{docs}')").collect()
    assert [(r.page, r.table_no, r.row_no, r.cells) for r in got] == [(2, 0, 0, ["a", None]), (2, 0, 1, ["b", "c"])]
    df = U.tables_of(spark.createDataFrame([(9, docs)], "doc_id int, tables string")).collect()
    assert [(r.page, r.row_no, r.cells) for r in df] == [(2, 0, ["a", None]), (2, 1, ["b", "c"])]
