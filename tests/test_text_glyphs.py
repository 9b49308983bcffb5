import random

import pytest
from pyspark.sql import functions as F

from quiremill.operators import glyphs as C
from quiremill.operators import text as B

ITEM = "doc_id long, page int, item_no int, str string, x double, y double, size double, width double"


def lines_of(parts):
    """The line rule, part after part in reading order."""
    out = []
    for p in sorted(parts, key=lambda p: (-p["y"], p["x"], p["item_no"])):
        if out and abs(out[-1]["y"] - p["y"]) < 0.5 * min(out[-1]["size"], p["size"]):
            out[-1]["items"].append(p["item_no"])
            out[-1]["size"] = max(out[-1]["size"], p["size"])
        else:
            out.append({"y": p["y"], "size": p["size"], "items": [p["item_no"]]})
    return sorted(tuple(sorted(ln["items"])) for ln in out)


@pytest.mark.parametrize("seed", range(3))
def test_lines_with_mixed_sizes(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for page in range(8):
        for i in range(60):
            rows.append((1, page, i, "w", float(rnd.randint(0, 40)), rnd.randint(0, 160) / 4, float(rnd.choice([2, 4, 6, 10, 20])), 5.0))
    got = B.assemble_lines(spark.createDataFrame(rows, ITEM)).groupBy("page", "cluster", "sub").agg(F.sort_array(F.collect_list("item_no")).alias("i")).collect()
    for page in range(8):
        parts = [dict(zip(("item_no", "x", "y", "size"), (r[2], r[4], r[5], r[6]))) for r in rows if r[1] == page]
        assert sorted(tuple(r.i) for r in got if r.page == page) == lines_of(parts)


def test_text_of_lines_and_paragraphs(spark):
    rows = [(1, 0, 0, "Hello", 10.0, 100.0, 10.0, 30.0), (1, 0, 1, "wor", 45.0, 100.0, 10.0, 15.0), (1, 0, 2, "ld", 61.0, 101.0, 10.0, 10.0),
            (1, 0, 3, "hyphen-", 10.0, 88.0, 10.0, 40.0), (1, 0, 4, "ated", 10.0, 76.0, 10.0, 20.0), (1, 0, 5, "far", 10.0, 50.0, 10.0, 20.0), (1, 0, 6, "big", 10.0, 40.0, 14.0, 20.0),
            (1, 2, 0, "  ", 0.0, 10.0, 10.0, 5.0)]
    paras = B.paragraphs(B.lines(spark.createDataFrame(rows, ITEM)))
    assert [r.text for r in paras.orderBy("para_no").collect()] == ["Hello world hyphen-ated", "far", "big"]
    doc = B.document_text(paras, spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, n_pages int"))
    assert {r.doc_id: r.text for r in doc.collect()} == {1: "Hello world hyphen-ated\nfar\nbig\n\n\n\n", 2: ""}


def test_item_sizes(spark):
    t = [([10.0, 0, 0.0, 12.0, 1.0, 2.0], 5.0, 12.0), ([10.0, 0, 0.0, 0.0, 1.0, 2.0], 7.0, 7.0), ([1.0, 0, 0.0, 0.0, 1.0, 2.0], 0.0, 10.0), ([1.0, 0, 0.3, 0.4, 1.0, 2.0], 0.0, 1.0)]
    rows = [(1, 0, i, "x", [float(v) for v in m], 3.0, h) for i, (m, h, _) in enumerate(t)] + [(1, 0, 9, "", [0.0] * 6, 0.0, 0.0), (1, 0, 10, None, [0.0] * 6, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, item_no int, str string, transform array<double>, width double, height double")
    assert [r.size for r in B.text_items(df).orderBy("item_no").collect()] == [s for _, _, s in t]


def chars(spark, text, gaps=None, syn=(), size=10.0, width=10.0, line=0):
    """Characters laid out with the given extra gap after each index; `syn` marks inferred blanks."""
    rows, x = [], 0.0
    for i, c in enumerate(text):
        w = 3.0 if c == " " else width
        rows.append((1, 0, line, 0, i, i, c, x, 0.0, x + w, size, x, size, i in syn))
        x += w + (gaps or {}).get(i, 0.0)
    return spark.createDataFrame(rows, "doc_id long, page int, line int, span int, char_no int, ord int, c string, x0 double, y0 double, x1 double, y1 double, origin_x double, size double, syn boolean")


def text(df):
    return C.line_text(df).first().text


def test_word_spaces_of_hangul(spark):
    s = "나는학교에갑니다"
    assert text(C.infer_word_spaces(chars(spark, s, {1: 4.0, 4: 3.5}))) == "나는 학교에 갑니다"
    assert text(C.infer_word_spaces(chars(spark, s, {i: 4.0 for i in range(8)}))) == s  # evenly spread title
    assert text(C.infer_word_spaces(chars(spark, "나는 학교에갑니다", {5: 4.0}))) == "나는 학교에갑니다"  # has a real blank
    assert text(C.infer_word_spaces(chars(spark, "plain words", {3: 9.0}, syn=(5,)))) == "plain words"


def test_autospace_and_dots(spark):
    s = "올해 2026 년 kg"
    assert text(C.drop_autospace(chars(spark, s, syn=(7,)))) == "올해 2026년 kg"
    assert text(C.drop_autospace(chars(spark, "2026 년", syn=(4,)))) == "2026 년"  # no real blank in the line
    assert text(C.drop_autospace(chars(spark, "가 나 2", {2: 5.0}, syn=(3,)))) == "가 나 2"  # wide gap may be a tab
    assert text(C.drop_dot_spaces(chars(spark, "도· 소매 업", syn=(2,)))) == "도·소매 업"
    assert text(C.drop_dot_spaces(chars(spark, "· 항목", syn=(1,)))) == "· 항목"
    assert text(C.drop_dot_spaces(chars(spark, "도 ·소매", syn=(1,)))) == "도·소매"


def test_letter_spacing(spark):
    tight = C.char_spacing(chars(spark, "abcdef", {i: -1.0 for i in range(6)})).first().spacing
    assert tight == pytest.approx(-1.03, abs=0.011)
    assert C.char_spacing(chars(spark, "abcdef")).first().spacing == 0.0


PIECE = "doc_id long, page int, piece_no long, x0 double, y0 double, x1 double, y1 double, size double"


def rows_and_groups(pieces):
    """The row and group rules stated one piece after the other."""
    rows = []
    for p in sorted(pieces, key=lambda p: ((p[4] + p[6]) / 2, p[2])):
        if rows:
            b = rows[-1]["box"]
            h = min(b[1] - b[0], p[6] - p[4])
            if h > 0 and min(b[1], p[6]) - max(b[0], p[4]) > 0.5 * h:
                rows[-1]["p"].append(p)
                rows[-1]["box"] = (min(b[0], p[4]), max(b[1], p[6]))
                continue
        rows.append({"box": (p[4], p[6]), "p": [p]})
    groups = []
    for r in rows:
        cur, right = [], None
        for p in sorted(r["p"], key=lambda p: (p[3], p[2])):
            if cur and p[3] - right < 0.6 * max(1, p[7], max(q[7] for q in cur)):
                cur.append(p)
                right = max(right, p[5])
            else:
                if cur:
                    groups.append(cur)
                cur, right = [p], p[5]
        groups.append(cur)
    return sorted(tuple(sorted(q[2] for q in r["p"])) for r in rows), sorted(tuple(sorted(q[2] for q in g)) for g in groups)


@pytest.mark.parametrize("seed", range(3))
def test_rows_and_groups_of_pieces(spark, seed):
    rnd = random.Random(seed)
    data = []
    for page in range(6):
        for i in range(40):
            x, y, h = rnd.randint(0, 400) / 2, rnd.randint(0, 120) / 2, rnd.choice([4, 8, 12])
            data.append((1, page, i, x, y, x + rnd.randint(2, 30), y + h, float(h)))
    r = C.group_rows(spark.createDataFrame(data, PIECE)).cache()
    rows = r.groupBy("page", "row_key").agg(F.sort_array(F.collect_list("piece_no")).alias("i")).collect()
    groups = C.group_pieces(r).groupBy("page", "row_key", "group_key").agg(F.sort_array(F.collect_list("piece_no")).alias("i")).collect()
    for page in range(6):
        want_rows, want_groups = rows_and_groups([d for d in data if d[1] == page])
        assert sorted(tuple(x.i) for x in rows if x.page == page) == want_rows
        assert sorted(tuple(x.i) for x in groups if x.page == page) == want_groups


def test_columns_side_by_side_stay_apart(spark):
    """A tall piece in one block doesn't tie the lines of its neighbour together."""
    words = [("BIG", 0, 100, 126, 0, 0), ("aaaa", 300, 101, 111, 1, 1), ("bbbb", 300, 114, 124, 1, 2)]
    rows = [(1, 0, b, n, n, i, c, x + 6.0 * i, x + 6.0 * i + 6, float(y0), float(y1), float(y1 - y0), True)
            for w, x, y0, y1, b, n in words for i, c in enumerate(w)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block int, line int, piece_no int, ord int, c string, x0 double, x1 double, y0 double, y1 double, "
                               "size double, horizontal boolean")
    got = C.line_text(C.merge_row_pieces(df)).collect()
    assert sorted(r.text for r in got) == ["BIG", "aaaa", "bbbb"]


def test_pieces_without_size_join_when_near(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 5.0, 10.0, 0.0), (1, 0, 1, 5.3, 0.0, 9.0, 10.0, 0.0), (1, 0, 2, 9.7, 0.0, 12.0, 10.0, 0.0)]
    got = C.group_pieces(C.group_rows(spark.createDataFrame(rows, PIECE))).groupBy("group_key").agg(F.sort_array(F.collect_list("piece_no")).alias("i")).collect()
    assert sorted(tuple(r.i) for r in got) == [(0, 1), (2,)]


def test_blanks_drawn_several_times(spark):
    # blanks at 10, 11 (over the first), 13.5 (beside the first, over the second) and 13.6 (over the third)
    rows = [("a", 0.0, 10.0), (" ", 10.0, 14.0), (" ", 11.0, 15.0), (" ", 13.5, 17.5), (" ", 13.6, 17.6), ("b", 18.0, 28.0)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k int, i int, c string, x0 double, x1 double")
    got = C.overprint_dedupe(df, ["k"], ["i"]).orderBy("x0").collect()
    assert [r.keep for r in got] == [True, True, False, True, False, True] and not got[0].overprinted
    twice = spark.createDataFrame([(1, 0, "a", 0.0, 10.0), (1, 1, "a", 1.0, 11.0)], "k int, i int, c string, x0 double, x1 double")
    assert C.overprint_dedupe(twice, ["k"], ["i"]).first().overprinted


def test_runs_compare_with_their_first_span(spark):
    size = [10.0, 10.008, 10.016, 10.016, 12.0]
    words = ["a", "b", "c", " ", "d"]
    df = spark.createDataFrame([(1, 0, 0, i, w, "F", s, 0, 0, 255, 0.0, i, 0, i + 1, 1) for i, (w, s) in enumerate(zip(words, size))],
                               "doc_id long, page int, line int, span int, text string, font string, size double, flags int, color int, alpha int, spacing double, x0 int, y0 int, x1 int, y1 int")
    assert [r.text for r in C.merge_runs(df).orderBy("run").collect()] == ["ab", "c ", "d"]


def test_marks_take_the_first_free_circle(spark):
    circles = spark.createDataFrame([(1, 0, 0, 5.0, 5.0, 2.0), (1, 0, 1, 6.0, 5.0, 2.0), (1, 0, 2, 6.0, 5.0, 3.0)], "doc_id long, page int, circle_no int, cx double, cy double, r double")
    marks = spark.createDataFrame([(1, 0, i, "·", 1.0, 8.0, 10.0) for i in range(3)] + [(1, 0, 3, "x", 1.0, 8.0, 10.0)], "doc_id long, page int, mark_no int, text string, x double, y double, size double")
    assert sorted((r.mark_no, r.circle_no) for r in C.match_marks_to_boxes(circles, marks).collect()) == [(0, 0), (1, 1)]


def test_normalised_text(spark):
    s = "a&lt;b&#44032;&#x1F600;&amp;lt;&NBSP;c&#160;d  \r\n\r\n\r\n　e&bogus; &#99999999; "
    got = spark.createDataFrame([(s,)], "s string").select(C.normalize_text(F.col("s")).alias("t")).first().t
    assert got == "a<b가😀&lt; c d\n\n e&bogus; &#99999999;"


def test_font_names_and_bullets(spark):
    df = spark.createDataFrame([("Arial",), ("맑은 고딕",), ("Fön",), ("  ",), ("",), (None,), ("a\n",)], "n string")
    assert [r.g for r in df.select(C.good_font_name(F.col("n")).alias("g")).collect()] == [True, True, False, False, False, False, False]
    b = spark.createDataFrame([("x",)], "n string").select(C.normalize_bullets(F.col("n")).alias("t")).first().t
    assert b == "•x✓"


def test_whole_cleanup(spark):
    rows = []
    for piece, (word, x) in enumerate([("도·", 0.0), ("소매", 24.0), ("업", 44.0), ("vertical", 300.0)]):
        for k, c in enumerate(word):
            rows.append((1, 0, piece, 0, k, c, x + 10 * k, 0.0, x + 10 * k + 10, 10.0, 10.0, "F", 0, 0, 0, False, x + 10 * k, word != "vertical"))
    df = spark.createDataFrame(rows, "doc_id long, page int, piece_no long, span int, ord int, c string, x0 double, y0 double, x1 double, y1 double, size double, font string, flags int, color int, "
                                     "char_flags int, mark boolean, origin_x double, horizontal boolean")
    got = C.tidy_text(df).orderBy("line", "run").collect()
    assert "".join(r.text for r in got if r.line == 0) == "도·소매업" and [r.text for r in got if r.line == 3] == ["vertical"]


def test_runs_of_many_lines_equal_a_fold():
    """Style changes, blanks, sizes that drift within what is allowed, missing values."""
    import numpy as np
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 40)
        first = np.array([True] + [rng.random() < 0.15 for _ in range(n - 1)])
        blank = np.array([rng.random() < 0.2 for _ in range(n)])
        code = np.array([rng.choice([0, 0, 0, 0, 1, -1]) for _ in range(n)])
        size = np.array([rng.choice([10.0, 10.0, 10.006, 10.012, 10.018, 12.0, float("nan")]) for _ in range(n)])
        spacing = np.array([rng.choice([0.0, 0.0, 0.06, 0.12, 0.5]) for _ in range(n)])
        want, head = [], 0
        for i in range(n):
            same = code[head] == code[i] >= 0 and abs(size[head] - size[i]) < 0.01 and abs(spacing[head] - spacing[i]) < 0.1
            want.append(bool(first[i] or not (blank[i] or same)))
            head = i if want[-1] else head
        assert C._run_starts(first, blank, [code], size, spacing).tolist() == want


def test_runs_take_one_window_and_one_pass(spark):
    kinds = "doc_id long, page int, line int, span int, text string, font string, size double, flags int, color int, alpha int, spacing double, x0 int, y0 int, x1 int, y1 int"
    rows = [(None, 0, 0, 1, "b", "F", 9.0, 0, 0, 255, 0.0, 5, 0, None, 1), (None, 0, 0, 0, None, "F", 9.0, 0, 0, 255, 0.0, 3, 0, 4, 1), (1, 0, 0, 0, None, None, 9.0, 0, 0, 255, 0.0, 3, 0, None, 1)]
    got = C.merge_runs(spark.createDataFrame(rows, kinds))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [
        (None, 0, 0, 0, "b", "F", 9.0, 0, 0, 255, 0.0, 2, 3, 0, 4, 1), (1, 0, 0, 0, None, None, 9.0, 0, 0, 255, 0.0, 1, 3, 0, None, 1)]
