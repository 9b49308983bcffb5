import random

import pytest
from pyspark.sql import functions as F

from quiremill.operators import fonts as P
from quiremill.operators import frames as G


@pytest.mark.parametrize("name, text, want", [
    ("ABCDEF+MalgunGothicBold", "", "맑은 고딕"), ("HCR Batang", "", "바탕"), ("BatangChe", "", "바탕체"), ("Arial-Narrow", "", "Arial Narrow"), ("ArialMT", "", "Arial"),
    ("CMR10", "", "Times New Roman"), ("CMMI10", "", "Cambria Math"), ("Foo-BoldItalicMT", "", "Foo"), ("Unknown", "한글", "맑은 고딕"), ("UnknownSong", "한글", "바탕"),
    ("XYZPSMT", "", "XYZ"), ("", "", ""), (None, "한글", "맑은 고딕")])
def test_font_rules(spark, name, text, want):
    df = spark.createDataFrame([(name, text)], "n string, t string")
    assert df.select(P.map_font_name(F.col("n"), F.col("t")).alias("f")).first().f == want


@pytest.mark.parametrize("family, cls, office", [
    ("바탕", "koSerif", "Batang"), ("HY헤드라인M", "koSans", "MalgunGothic"), ("Times New Roman", "latinSerif", "TimesNewRoman"), ("Courier", "mono", "CourierNew"),
    ("Lucida Console", "mono", "CourierNew"), ("Noto Serif KR", "koSerif", "Batang"), ("Gill Sans", "latinSans", "Arial"), ("Odd", "koSans", "MalgunGothic"), ("새굴림", "koSans", "Gulim")])
def test_classes(spark, family, cls, office):
    r = spark.createDataFrame([(family,)], "f string").select(P.font_class(F.col("f")).alias("c")).first()
    assert r.c == cls
    assert spark.createDataFrame([(family, cls)], "f string, c string").select(P.office_name(F.col("f"), F.col("c")).alias("o")).first().o == office


def test_glyphs(spark):
    cov = spark.createDataFrame([("Symbols", 0x2190, 0x23FF), ("HanjaSans", 0x4E00, 0x9FFF), ("NanumGothic", 0x2200, 0x2200)], "font string, cp_start int, cp_end int")
    rows = [("latinSans", "a", "LiberationSans"), ("latinSans", "가", "NanumGothic"), ("koSerif", "가", "NanumMyeongjo"), ("koSans", "漢", "HanjaSans"), ("koSans", "→", "Symbols"),
            ("koSans", "∀", "NanumGothic"), ("mono", "😀", "LiberationMono")]
    got = P.glyph_fallback(spark.createDataFrame(rows, "cls string, c string, want string"), cov).collect()
    assert len(got) == len(rows) and all(r.font == r.want for r in got)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_glyphs_are_chosen_where_the_rows_stand(spark):
    """Rows are read once, and no task gets all rows of a frequent character."""
    cov = spark.createDataFrame([("Symbols", 0x2190, 0x23FF), ("Symbols", 0x2190, 0x23FF), ("NanumGothic", 0x20F0, 0x2200), ("Unheard", 0, 0xFFFF)], "font string, cp_start int, cp_end int")
    rows = [("koSans", "→", "NanumGothic"), ("koSans", "⏎", "Symbols"), ("koSans", "⏎", "Symbols"), ("koSans", "\u2200", "NanumGothic"), ("latinSans", "\u2100", "NanumGothic"), ("mono", "€", "LiberationMono"),
            (None, "a", None), ("mono", None, None), ("odd", "a", None), ("mono", "", "LiberationMono")]
    texts = spark.createDataFrame(rows, "cls string, c string, want string")
    assert _plan(P.glyph_fallback(texts, cov)).count("Scan ExistingRDD[cls") == 1
    got = P.glyph_fallback(texts, cov).collect()
    assert sorted(map(str, ((r.cls, r.c, r.font) for r in got))) == sorted(map(str, rows))


def test_fonts_of_pages_are_named_once(spark):
    rows = [(1, "Arial", "latinSans", "LiberationSans", w, "#0", "#0", None, 1.0) for w in (None, "700", "bold", "normal")] * 3
    texts = spark.createDataFrame(rows, "page int, family string, cls string, font string, weight string, stroke string, fill string, stroke_width double, size double")
    thick = P.fonts_used(texts.withColumn("stroke_width", F.lit(5.0)), ["page"], True)
    assert sorted(map(tuple, thick.collect())) == [(1, "Arial-LS", False), (1, "Arial-LS-Bold", True)]
    assert [tuple(r) for r in P.fonts_used(texts, ["page"]).collect()] == [(1, "LiberationSans-Bold", True)]


@pytest.mark.parametrize("text, first", [("ab", "a"), ("  \u00a0\u3000x", "x"), ("", " "), (" \n\u0085", " "), (None, None), ("\u4e00b", "\u4e00"), ("\t!", "!"), ("~", "~"), ("\x7f", "\x7f")])
def test_first_ink(spark, text, first):
    assert spark.createDataFrame([(text,)], "t string").select(P.first_ink(F.col("t")).alias("c")).first().c == first


def test_needed_fonts(spark):
    exact = spark.createDataFrame([(1, "맑은 고딕"), (1, "Calibri"), (2, "none")], "doc int, font string")
    runs = spark.createDataFrame([(2, "uses Batang here"), (3, "바탕체"), (3, "Ba")], "doc int, run string")
    inst = spark.createDataFrame([("Malgun Gothic",), ("Calibri",), ("Batang",), ("BatangChe",), ("Ab",)], "family string")
    got = sorted((r.doc, r.family_key) for r in P.fonts_needed(exact, runs, inst, "doc").collect())
    assert got == [(1, "malgungothic"), (2, "batang"), (3, "batangche")]


def test_document_fonts(spark):
    m = '<w:rFonts w:ascii="Arial" w:eastAsia="맑은 고딕"/><x:name val="Cambria"/><a latin="\'Quoted\'" other="No"/><w:name w:val="no"/>'
    got = sorted(r.font for r in P.markup_fonts(spark.createDataFrame([(1, m)], "d int, m string"), "d", "m").collect())
    assert got == ["Arial", "Cambria", "Quoted", "맑은 고딕"]
    blob = b"\x01\x02" + "Malgun 굴림".encode("utf-16-le") + b"\x00\x01ASCII run\x00ab"
    runs = [r.run for r in P.binary_runs(spark.createDataFrame([(1, blob)], "d int, b binary"), "d", "b").collect()]
    assert "Malgun 굴림" in runs and "ASCII run" in runs and "ab" not in runs


def test_substitution(spark):
    req = spark.createDataFrame([("Calibri",), ("굴림체",), ("Verdana",), ("Nothing",)], "family string")
    inst = spark.createDataFrame([("Carlito",), ("NanumGothic",), ("Verdana",)], "family string")
    assert {r.family: r.drawn_with for r in P.font_substitution(req, inst).collect()} == {"Calibri": "Carlito", "굴림체": "NanumGothic", "Verdana": "Verdana", "Nothing": None}


def test_tiles_cover_the_scaled_image(spark):
    img = spark.createDataFrame([(1, 301, 207, 64, 913, 640), (2, 10, 10, 64, 35, 35)], "id int, w int, h int, t int, ow int, oh int")
    t = G.stitch_tiles(G.tile_grid(img, "w", "h", "t"), "w", "h", "ow", "oh")
    for r in t.groupBy("id", "ow", "oh").agg(F.sum(F.col("dw") * F.col("dh")).alias("a"), F.max(F.col("px0") + F.col("pw") - F.col("w")).alias("over")).collect():
        assert r.a == r.ow * r.oh and r.over <= 0


def test_colours_and_alpha(spark):
    df = spark.createDataFrame([([1, 2, 3, 255, 1, 2, 3, 254, 9, 9, 9, 255],)], "px array<int>")
    r = df.select(G.color_count(F.col("px"), 4).alias("n"), G.has_alpha(F.col("px")).alias("a"), G.color_count(F.expr("cast(array() as array<int>)"), 4).alias("z")).first()
    assert (r.n, r.a, r.z) == (2, True, 0)


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_frame_reuse_in_stretches(spark, width):
    rnd = random.Random(3)
    rows, want = [], []
    for stream in (1, 2):
        prev, kept, skipped = None, None, 0
        for n in range(40):
            px = [rnd.randint(0, 4), 0] if rnd.random() < 0.8 else [100, 0, 0]
            same = prev is not None and len(px) == len(prev) and all(abs(a - b) <= 2 for a, b in zip(px, prev))
            kept, skipped, prev = (kept if same else n), skipped + same, px
            rows.append((stream, n, px))
            want.append((stream, n, kept, skipped))
    f = G.same_frame(spark.createDataFrame(rows, "stream int, frame_no long, px array<int>"), width=width)
    got = sorted((r.stream, r.frame_no, r.result_of, r.skipped) for r in G.reuse_results(f, width=width).collect())
    assert got == sorted(want)


def test_psnr(spark):
    same = spark.createDataFrame([([5] * 27, [5] * 27, [6] * 27)], "a array<int>, b array<int>, c array<int>")
    r = same.select(G.psnr(G.luma(F.col("a"), 3), G.luma(F.col("b"), 3), F.lit(3), F.lit(3), 1).alias("inf"),
                    G.psnr(G.luma(F.col("a"), 3), G.luma(F.col("c"), 3), F.lit(3), F.lit(3), 1).alias("p")).first()
    assert r.inf == float("inf") and r.p == pytest.approx(49.45, abs=0.01)


def test_eta(spark):
    df = spark.createDataFrame([(0.2,), (59.4,), (61.0,), (5400.0,), (None,)], "s double")
    assert [r.t for r in df.select(G.eta_label(F.col("s")).alias("t")).collect()] == [" · 약 1초 남음", " · 약 59초 남음", " · 약 1분 남음", " · 약 1.5시간 남음", ""]


def test_structural_similarity_window_by_window(spark):
    import math
    import random
    rng = random.Random(5)
    w, h, border, size = 14, 11, 1, 5
    rows = [(0, [float(i % 50) for i in range(w * h)], [float(i % 50) for i in range(w * h)]), (1, None, [1.0] * (w * h)), (2, [1.0], [1.0])]
    rows += [(k, [rng.random() * 255 for _ in range(w * h)], [rng.random() * 255 for _ in range(w * h)]) for k in range(3, 6)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r.id: r.ssim for r in G.structural_similarity(df, "a", "b", w, h, border, size).collect()}

    def plain(a, b):
        out = []
        for y in range(border, h - border - size + 1):
            for x in range(border, w - border - size + 1):
                p, q = ([v[(y + j) * w + x + i] for j in range(size) for i in range(size)] for v in (a, b))
                n = len(p)
                mp, mq = sum(p) / n, sum(q) / n
                vp, vq = sum((v - mp) ** 2 for v in p) / (n - 1), sum((v - mq) ** 2 for v in q) / (n - 1)
                both = sum((s - mp) * (t - mq) for s, t in zip(p, q)) / (n - 1)
                c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
                out.append((2 * mp * mq + c1) * (2 * both + c2) / ((mp ** 2 + mq ** 2 + c1) * (vp + vq + c2)))
        return sum(out) / len(out)

    assert got[1] is None and got[2] is None and math.isclose(got[0], 1.0)
    assert all(math.isclose(got[k], plain(a, b), abs_tol=1e-9) for k, a, b in rows if k >= 3)
    assert G.structural_similarity(df, "a", "b", 3, 3).filter("ssim is not null").isEmpty()
