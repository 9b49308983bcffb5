"""Findings of the third round: what keeps large tables from being sorted in few tasks, exchanged or derived twice."""

from pyspark.sql import functions as F

from quiremill.operators import glyphs as C
from quiremill.operators import tables as T
from quiremill.operators import text as B
from quiremill.plans.queries import QUERIES
from quiremill.sources import views as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _documents(spark, tmp_path, texts):
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder


def test_words_are_spread_by_the_length_of_the_texts(spark, tmp_path, monkeypatch):
    d = _documents(spark, tmp_path, ["one two three " * 20, None, "four"])
    few = V.items(spark, d).rdd.getNumPartitions()
    monkeypatch.setattr(V, "TASK_CHARS", 10)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and V.items(spark, d).rdd.getNumPartitions() == 29


def test_lines_are_joined_in_the_pass_that_made_them(spark, tmp_path):
    d = _documents(spark, tmp_path, ["one two\nthree four five", "six"])
    for name in ("infer_word_spaces", "merge_row_pieces"):
        plan = _plan(QUERIES[name](spark, d))
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan, name


def test_joined_lines_equal_those_of_exchanged_rows(spark):
    rows = [(1, 0, n, i, c, 6.0 * i + (5 if i > 2 else 0), 6.0 * i + 5 + (5 if i > 2 else 0)) for n in (None, 0, 1) for i, c in enumerate("abcdef")]
    chars = spark.createDataFrame(rows, "doc_id long, page int, line long, ord long, c string, x0 double, x1 double").selectExpr(
        "*", "0D as y0", "10D as y1", "10D as size", "false as syn")
    spaced = C.infer_word_spaces(chars, "[a-z]")
    assert sorted(map(tuple, C.line_text(spaced).collect()), key=str) == sorted(map(tuple, C.line_text(spaced.select("*")).collect()), key=str)
    assert {r.text for r in C.line_text(spaced).collect()} == {"abc def"}


def test_characters_that_share_a_place_stay_before_their_blanks(spark):
    rows = [(1, 0, 0, i, c, 12.0 * i) for i, c in enumerate("abcd") for _ in (0, 1)]
    chars = spark.createDataFrame(rows, "doc_id long, page int, line long, ord long, c string, x0 double").selectExpr(
        "*", "x0 + 6 as x1", "0D as y0", "10D as y1", "10D as size", "false as syn")
    spaced = C.infer_word_spaces(chars, "[a-z]")
    assert C.line_text(spaced).first().text == C.line_text(spaced.select("*")).first().text == "aa bb cc dd"


def test_pieces_carry_their_characters(spark):
    rows = [(1, 0, p, i, c, 6.0 * (2 * (p or 0) + i), up) for p, up in ((0, True), (1, True), (2, False)) for i, c in enumerate("xy")]
    chars = spark.createDataFrame(rows, "doc_id long, page int, piece_no long, ord long, c string, x0 double, horizontal boolean").selectExpr(
        "*", "x0 + 6 as x1", "0D as y0", "10D as y1", "10D as size")
    merged = C.merge_row_pieces(chars)
    assert {(r.line, r.text) for r in C.line_text(merged).collect()} == {(0, "xyxy"), (2, "xy")}
    every = C.merge_row_pieces(chars)
    whole = C.merge_row_pieces(chars.withColumn("block", F.lit(0)))
    columns = every.columns
    assert sorted(map(str, every.collect())) == sorted(map(str, whole.select(columns).collect()))


def test_overprints_are_found_in_one_pass(spark):
    rows = [(1, 0, "a"), (1, 6, " "), (1, 7, " "), (1, 12, "b"), (2, 0, "a"), (2, 1, "a")]
    chars = spark.createDataFrame(rows, "k int, x0 int, c string").selectExpr("*", "x0 + 6 as x1", "monotonically_increasing_id() as n")
    out = C.overprint_dedupe(chars, ["k"], ["n"])
    assert "MapInArrow" in _plan(out) and "collect_list" not in _plan(out)
    assert sorted((r.k, r.x0, r.keep, r.overprinted) for r in out.collect()) == [
        (1, 0, True, False), (1, 6, True, False), (1, 7, False, False), (1, 12, True, False), (2, 0, True, True), (2, 1, True, True)]


def test_tidied_text_writes_no_characters(spark, tmp_path):
    assert "ExistingRDD" not in _plan(QUERIES["tidy_text"](spark, _documents(spark, tmp_path, ["one two"])))


def test_sheet_rows_are_derived_once(spark):
    rows = spark.createDataFrame([(1, 1, "s", 1, ["a", "2"])], "doc_id long, sheet_no long, sheet_name string, row_no long, cells array<string>").filter(F.rand(1) >= 0)
    for made in (T.sheet_markup(rows), T.sheet_pieces(rows)):
        assert "rand(" not in _plan(made)


def test_column_names_with_and_without_the_loop(spark):
    got = spark.range(-1, 800).select("id", T.col_name(F.col("id")).alias("n")).collect()

    def name(i):
        return "" if i < 0 else name(i // 26 - 1) + chr(65 + i % 26)
    assert all(r.n == name(r.id) for r in got)
    assert "aggregate" in _plan(spark.range(1).select(T.col_name(F.col("id")))) and "CASE WHEN" in _plan(spark.range(1).select(T.col_name(F.col("id"))))


def test_restored_spaces_exchange_lines_only(spark, tmp_path):
    """Glyphs and runs stand by page as their words do: only the lines they come from are exchanged."""
    d = _documents(spark, tmp_path, ["one two\nthree four five", "six"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(QUERIES["restore_spaces"](spark, d))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 3 and plan.count("MapInArrow") == 1


def test_boxes_are_spread_by_the_number_of_rows(spark, tmp_path, monkeypatch):
    rows = [(o, n, o, 1, 10.0, 5.0) for o in range(10) for n in range(3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = sorted(map(tuple, V.cellboxes(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(V, "TASK_ROWS", 2)
    boxes = V.cellboxes(spark, str(tmp_path))
    assert _plan(boxes).count("Exchange") == 1  # the window over a table's rows needs no other
    assert boxes.rdd.getNumPartitions() == 15
    assert sorted(map(tuple, boxes.collect())) == before


ITEM = "doc_id long, page int, item_no int, str string, x double, y double, size double, width double"


def test_items_become_paragraphs_in_one_pass(spark, tmp_path):
    d = _documents(spark, tmp_path, ["one two\nthree four five", "six"])
    for name in ("assemble_lines", "line_text", "paragraphs"):
        plan = _plan(QUERIES[name](spark, d))
        assert plan.count("MapInArrow") == 1 and "collect_list" not in plan and "listagg" not in plan, name
    assert _plan(QUERIES["paragraphs"](spark, d)).count("Exchange") == 1


def test_lines_of_odd_items(spark):
    rows = [(None, 0, 0, "　a", 0.0, 10.0, 10.0, 5.0), (None, 0, 1, "b ", 20.0, 10.0, 10.0, 5.0), (None, 0, 2, "c", 40.0, 10.0, 10.0, 5.0),
            (1, 0, 0, "late", 50.0, 14.0, 10.0, 5.0), (1, 0, 1, "early", 10.0, 10.0, 10.0, 5.0), (1, 0, 2, None, 90.0, 10.0, 10.0, 5.0), (1, 0, 3, "end", 95.0, 10.0, 10.0, 5.0),
            (1, 0, 4, "é-", 0.0, -5.0, None, 5.0), (1, 1, 0, None, 0.0, 5.0, 10.0, 5.0), (1, 1, 1, " \t", 0.0, -50.0, 10.0, 5.0)]
    got = B.lines(spark.createDataFrame(rows, ITEM).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, 0, 0, 14.0, 10.0, 4, "early lateend"), (1, 0, 1, -5.0, None, 1, "é-"), (1, 1, 0, 5.0, 10.0, 1, None), (1, 1, 1, -50.0, 10.0, 1, ""),
        (None, 0, 0, 10.0, 10.0, 3, "a b c")], key=str)


def test_paragraphs_of_passed_and_of_given_lines(spark):
    rows = [(d, p, n, t, 0.0, 100.0 - 12 * n, 10.0, 5.0) for d in (None, 1) for p in (0, 1) for n, t in enumerate(["a-", "b", " ", "c‐", "d"])]
    made = B.lines(spark.createDataFrame(rows, ITEM))
    want = sorted(((d, p, k, 10.0, 2, t) for d in (None, 1) for p in (0, 1) for k, t in ((1, "a-b"), (2, "c‐d"))), key=str)
    for given in (made, made.select("*")):
        assert sorted(map(tuple, B.paragraphs(given).collect()), key=str) == want
    odd = spark.createDataFrame([(1, 0, 0, 50.0, 10.0, "a-\r\n"), (1, 0, 1, 40.0, 10.0, "b"), (1, 0, 2, 30.0, 10.0, None), (1, 0, 3, None, 10.0, "c"), (2, 0, 0, 1.0, 1.0, "")],
                                "doc_id long, page int, line_no int, y double, size double, text string")
    assert [tuple(r) for r in B.paragraphs(odd).orderBy("para_no").collect()] == [(1, 0, 1, 10.0, 2, "a-\r\nb"), (1, 0, 2, 10.0, 1, "c")]


def test_cells_without_blanks_meet_no_cleaning_pattern(spark):
    cells = ["1,234.50", "", None, " a \t b ", "　x ", "é", "a\nb", "\x00", "x" * 70, "가나\na"]
    rows = spark.createDataFrame([(1, 1, "s", 1, cells)], "doc_id long, sheet_no long, sheet_name string, row_no long, cells array<string>")
    cleaned = T.clean_cells(rows)
    assert cleaned.first().cells == ["1,234.50", "", None, "a b", "x", "é", "a\nb", "\x00", "x" * 70, "가나\na"]
    assert "RLIKE(" in _plan(cleaned).upper()
    widths = T.column_widths(cleaned)
    assert [r.width for r in widths.orderBy("col").collect()] == [10, 6, 6, 6, 6, 6, 6, 6, 60, 6]
    assert "Contains(" in _plan(widths)
