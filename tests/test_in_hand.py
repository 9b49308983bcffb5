"""Findings of the fourth round: steps on characters that a pass has in hand give the rows that they give on any table."""

import random

import pytest
from pyspark.sql import functions as F

from quiremill.functions import passes
from quiremill.operators import glyphs as C
from quiremill.operators import tables as T
from quiremill.operators import text as B
from quiremill.plans import glyph_queries as Q
from quiremill.plans.queries import QUERIES
from quiremill.sources import views as V

TEXTS = ["ab cd, ef  gh\n\tx. y 한 글 é𝄞 z\n\n a,b .c d　e", "", None, "one two, three " * 9, "n m\x85n , . m n", "same line\nsame line"]


def _documents(spark, tmp_path, ids=(1, 2, 3, None, None, 7, 7)):
    folder = str(tmp_path)
    texts = [*TEXTS, "other words of the same number, with. n m n m n m n m"]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _held(df, keys, order):
    """`df` as a pass has it in hand."""
    return passes.per_key(df, keys, order, lambda batch: batch.columns[:-1], df.schema, stands=keys)


def _one_pass(spark, d, name):
    """From lines to the result there is one exchange, one window over lines, one pass, and no row of a character."""
    plan = QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") == plan.count("Exchange") == plan.count("Window [") == plan.count("Generate") == 1 and "Join" not in plan


@pytest.mark.parametrize("part", [1 << 18, 1])
def test_characters_for_passes_are_those_of_the_view(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(V, "PART_CHARS", part)
    ch = V.chars(spark, _documents(spark, tmp_path))
    made = passes.behind(ch, C.PAGE, lambda rows: rows, ch.schema)
    assert _rows(made) == _rows(ch) and len(_rows(ch)) > 200


def test_characters_are_matched_as_by_columns(spark):
    for pattern in (r"\p{L}", C.HANGUL, f"^{C.WS}$", "^[a-mA-M]"):
        found = passes.matching(spark, pattern)
        some = [*range(1, 0x250), 0x2003, 0xAC00, 0xFEFF, 0x1D11E, 0x10FFFF]
        want = {r.i for r in spark.createDataFrame([(i, chr(i)) for i in some], "i int, c string").filter(F.col("c").rlike(pattern)).collect()}
        assert {i for i in some if found[i]} == want


def _pieces(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for page in range(6):
        for piece in range(40):
            x, y, size, flat = rnd.choice([0, 20, 40, 41, 60]), rnd.choice([0, 3, 4, 7, 8, 30]), rnd.choice([1, 8, 10, 12]), rnd.random() > 0.2
            for k in range(rnd.choice([1, 3, 4])):
                rows.append((1, page, piece, k, rnd.choice("ab  c"), x + 6.0 * k, x + 6.0 * k + rnd.choice([0, 5, 6]), 1.0 * y, 1.0 * y + rnd.choice([0, 6, 10]), 1.0 * size, flat))
    return spark.createDataFrame(rows, "doc_id long, page int, piece_no long, ord long, c string, x0 double, x1 double, y0 double, y1 double, size double, horizontal boolean")


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_in_hand_are_merged_as_by_windows(spark, seed):
    chars = _pieces(spark, seed)
    held = C.merge_row_pieces(_held(chars, C.PAGE, ["piece_no", "ord"]))
    assert _rows(held) == _rows(C.merge_row_pieces(chars))


def test_merge_row_pieces_is_one_pass_from_the_lines(spark, tmp_path):
    d = _documents(spark, tmp_path)
    assert _one_pass(spark, d, "merge_row_pieces")
    assert _rows(QUERIES["merge_row_pieces"](spark, d)) == _rows(C.line_text(C.merge_row_pieces(Q._piece_chars(spark, d).select("*"))))


def test_tidy_text_is_one_pass_from_the_lines(spark, tmp_path):
    d = _documents(spark, tmp_path)
    assert _one_pass(spark, d, "tidy_text")


@pytest.mark.parametrize("seed", [3, 4])
def test_text_in_hand_is_tidied_as_by_windows(spark, seed):
    rnd = random.Random(seed)
    chars = _pieces(spark, seed).withColumns({
        "c": F.expr("case when ord = 3 then '.' when ord = 1 and piece_no % 5 = 0 then '' when c = 'a' and piece_no % 3 = 0 then '한' else c end"),
        "char_flags": F.expr("cast((piece_no + ord) % 7 as int)"), "mark": F.expr("case when ord < 2 then piece_no % 4 = 0 end"), "span": F.expr("cast(piece_no % 5 as int)"),
        "origin_x": F.expr(f"x0 + (ord + piece_no) % 4 * {rnd.choice([0.31, 1.27])}"), "font": F.expr("if(piece_no % 6 < 3, 'A', 'B')"),
        "flags": F.expr("cast(piece_no % 2 as int)"), "color": F.lit(0)})
    held, plain = (C.tidy_text(c, "[a-b]", "[한]", ".") for c in (_held(chars, C.PAGE, ["piece_no", "ord"]), chars))
    assert held.columns == plain.columns and _rows(held) == _rows(plain)


@pytest.mark.parametrize("name, step", [("drop_autospace", lambda c: C.drop_autospace(c, "[a-mA-M]", "[n-zN-Z]")), ("drop_dot_spaces", lambda c: C.drop_dot_spaces(c, ".,"))])
def test_blanks_are_dropped_in_one_pass_from_the_lines(spark, tmp_path, name, step):
    d = _documents(spark, tmp_path)
    assert _one_pass(spark, d, name)
    chars = Q._ordered(spark, d).withColumn("size", F.expr("nullif(span % 3, 1) * 6"))
    every = _rows(step(chars))
    assert len(every) < chars.count() and _rows(step(_held(chars, C.LINE, ["ord"]))) == every


def test_word_spaces_are_inferred_in_one_pass_from_the_lines(spark, tmp_path):
    d = _documents(spark, tmp_path)
    assert _one_pass(spark, d, "infer_word_spaces")
    chars = Q._ordered(spark, d).withColumns({"size": F.expr("nullif(span % 3, 1) * 6"), "x0": F.expr("x0 + if(span % 2 = 0, 2, 0)")}).filter("c <> ' '")
    every = _rows(C.infer_word_spaces(chars, r"\p{L}"))
    assert len(every) > chars.count() and _rows(C.infer_word_spaces(_held(chars, C.LINE, ["ord"]), r"\p{L}")) == every


def test_overprints_go_from_the_lines_to_the_text_in_one_pass(spark, tmp_path):
    d = _documents(spark, tmp_path, ids=(17, 20, 3, 34, None, 7, 7))
    assert _one_pass(spark, d, "overprint_dedupe")
    assert {(r.overprinted, r.text is None) for r in QUERIES["overprint_dedupe"](spark, d).collect()} == {(True, True), (False, False)}
    chars = _pieces(spark, 5).withColumn("k", F.col("piece_no") % 9).drop("horizontal")
    key, order = ["doc_id", "page", "k"], ["piece_no", "ord"]
    held, plain = (C.overprint_dedupe(c, key, order) for c in (_held(chars, key, order), chars))
    assert _rows(held) == _rows(plain.select(held.columns)) and {r.keep for r in plain.collect()} == {r.overprinted for r in plain.collect()} == {True, False}
    texts = [C.line_text(passes.only(c, lambda r: r("keep")), key, order) for c in (held, plain)]
    assert _rows(texts[0]) == _rows(texts[1])


def test_pieces_are_placed_in_one_exchange_of_their_texts(spark):
    rows = [(1, n, "é" * (n % 5)) for n in range(40)] + [(2, 3, "ab"), (2, 3, "ab"), (2, 4, None), (None, 0, "x"), (3, None, "y")]
    parts = spark.createDataFrame(rows, "doc_id long, piece_no long, text string").repartition(3)
    placed = B.pieces(parts, ["doc_id"], width=7)
    assert "Join" not in placed._jdf.queryExecution().executedPlan().toString()
    want = [(1, n, sum(k % 5 for k in range(n)), "é" * (n % 5)) for n in range(40)] + [(2, 3, b, "ab") for b in (0, 2) for _ in (0, 1)] + [(2, 4, None, None)]
    assert _rows(placed) == sorted(want, key=repr)


def test_sheet_rows_are_written_as_compressed_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "s", n, ["a", "2"]) for n in range(1, 10)], "doc_id long, sheet_no long, sheet_name string, row_no long, cells array<string>")
    made = T.sheet_pieces(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Scan ExistingRDD" not in plan and made.count() == 11, plan


def test_glyphs_in_hand_meet_the_spots_in_one_pass(spark, tmp_path, monkeypatch):
    d = _documents(spark, tmp_path)
    got = QUERIES["restore_spaces"](spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform(split" not in plan
    alone = C.restore_spaces
    monkeypatch.setattr(C, "restore_spaces", lambda glyphs, runs: alone(glyphs.select("*"), runs))
    assert _rows(got) == _rows(QUERIES["restore_spaces"](spark, d)) and any(" " in r.text for r in got.collect())
    monkeypatch.setattr(C, "restore_spaces", alone)
    monkeypatch.setattr(passes, "MEETING_BYTES", 1)
    monkeypatch.setattr(V, "PART_CHARS", 1)
    assert _rows(QUERIES["restore_spaces"](spark, d)) == _rows(got)
