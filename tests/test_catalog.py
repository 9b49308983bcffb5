import random

import pytest
from pyspark.sql import functions as F

from quiremill.operators import catalog as A


def col1(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name, ext, stem", [("a.TXT", "txt", "a"), ("a.b.Jpg", "jpg", "a.b"), ("plain", "", "plain"), ("end.", "", "end"), (".hidden", "hidden", "")])
def test_ext_and_stem(spark, name, ext, stem):
    r = A.file_ext_stem(spark.createDataFrame([(name,)], "name string")).first()
    assert (r.ext, r.stem) == (ext, stem)


@pytest.mark.parametrize("name, want", [
    ("x.gif", "jpg png webp pdf bmp tiff ico up2 up4 up8 mp4".split()), ("x.svg", "jpg png webp pdf gif bmp tiff ico".split()),
    ("x.jpeg", "png webp pdf gif bmp tiff ico up2 up4 up8 compress rotr rotl".split()), ("x.oga", "mp3 wav m4a aac flac opus m4r compress".split()),
    ("x.pdf", "docx xlsx jpg png txt compress rotr rotl split unlock protect".split()), ("x.nope", []), ("noext", [])])
def test_targets(spark, name, want):
    assert A.file_targets(spark.createDataFrame([(name,)], "name string")).first().targets == want


def test_common_targets_and_merge(spark):
    rows = [("p", 1, "a.pdf"), ("p", 2, "b.PDF"), ("one", 1, "x.pdf"), ("mix", 1, "x.png"), ("mix", 2, "y.jpg"), ("mix", 3, "junk.zzz"), ("none", 1, "q.zzz")]
    got = {r.batch: r for r in A.batch_common_targets(spark.createDataFrame(rows, "batch string, pos int, name string")).collect()}
    assert got["p"].targets[-1] == "merge" and "merge" not in got["one"].targets
    assert got["mix"].targets == "webp pdf gif bmp tiff ico up2 up4 up8 compress rotr rotl".split() and got["mix"].n_files == 2
    assert "none" not in got


def sequential_names(names):
    """The rule, one name after the other."""
    used, out = set(), []
    for n in names:
        stem, dot, ext = n.rpartition(".")
        if not dot or not ext:
            stem, ext = n, None
        new, k = n, 2
        while new in used:
            new = f"{stem} ({k})" + (f".{ext}" if ext is not None else "")
            k += 1
        used.add(new)
        out.append(new)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_equals_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    pool = ["a.txt", "a.txt", "a.txt", "a (2).txt", "a (3).txt", "a (5).txt", "a (2) (2).txt", "a (02).txt", "a (1).txt", "b.txt", "b (3).txt", "noext", "noext (2)", "c.d.e", "c.d (2).e"]
    rows = []
    for batch in "xyz":
        rows += [(batch, i, rnd.choice(pool)) for i in range(60)]
    got = A.unique_names(spark.createDataFrame(rows, "batch string, pos long, name string")).collect()
    for batch in "xyz":
        mine = [r.unique_name for r in sorted((r for r in got if r.batch == batch), key=lambda r: r.pos)]
        assert mine == sequential_names([n for b, _, n in rows if b == batch])


def test_names_sizes_labels(spark):
    assert col1(spark, A.pretty_size(F.col("n")), n=1023) == "1023 B"
    assert col1(spark, A.pretty_size(F.col("n")), n=1536) == "1.5 KB"
    assert col1(spark, A.pretty_mb(F.col("n")), n=300) == "1KB"
    assert col1(spark, A.pretty_mb(F.col("n")), n=12_340_000) == "12.3MB"
    assert col1(spark, A.target_label(F.col("t")), t="webp") == "WEBP"
    assert col1(spark, A.page_output_name(F.col("s"), F.col("p"), F.col("n"), "png", False), s="d", p=3, n=12) == "d-03.png"
    assert col1(spark, A.page_output_name(F.col("s"), F.col("p"), F.col("n"), "png", False), s="d", p=1, n=1) == "d.png"
    assert col1(spark, A.page_output_name(F.col("s"), F.col("p"), F.col("n"), "pdf", True), s="d", p=1, n=1) == "d-1.pdf"


def test_zero_sized_images_do_not_fail(spark):
    df = spark.createDataFrame([(0.0, 0.0), (4000.0, 1000.0)], "w double, h double")
    w, h = A.shrink_video_size(F.col("w"), F.col("h"))
    assert [tuple(r) for r in df.select(w, h).collect()] == [(2, 2), (1280, 320)]


def test_signatures(spark):
    rows = [("a.docx", b"PK\x03\x04...."), ("b.docx", bytes.fromhex("d0cf11e0a1b11ae1")), ("c.docx", b"%PDF"), ("d.odt", bytes.fromhex("d0cf11e0")), ("e.doc", b"<html>"), ("f.ppt", b"")]
    got = {r.name: (r.ole, r.damaged) for r in A.signature_check(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got == {"a.docx": (False, False), "b.docx": (True, False), "c.docx": (False, True), "d.odt": (True, True), "e.doc": (False, False), "f.ppt": (False, True)}


def test_sniffed_formats(spark):
    rows = [(b"ID3\x04", "mp3"), (b"\xff\xfb\x90", "mp3"), (b"\xff\xf1\x50", "aac,mp3"), (b"OggS" + b"x" * 8 + b"OpusHead", "ogg,opus"), (b"RIFF1234AVI ", "avi,wav"),
            (b"\0\0\0\x18ftypqt  ", "m4a,m4r,mov,mp4"), (b"II*\0", "tiff"), ("이것은 한글".encode(), "txt")]
    got = spark.createDataFrame([(b, w) for b, w in rows], "content binary, want string").select(A.sniffed_formats(F.col("content")).alias("f"), "want").collect()
    assert [",".join(r.f) for r in got] == [r.want for r in got]


def test_merged_pages_count_up_through_the_batch(spark):
    pages = spark.createDataFrame([("b", d, p, 10 - d) for d in range(4) for p in range(d + 1)], "batch string, doc int, page int, pos int")
    got = sorted((r.pos, r.page, r.merged_page) for r in A.merge_pages(pages, "doc", "page", "batch", "pos").collect())
    assert [m for _, _, m in got] == list(range(1, 11))


def test_fingerprint_and_dedupe_keep_the_first(spark):
    base = b"x" * 300
    rows = [(1, base), (2, base), (3, base[:100] + b"y" + base[101:]), (4, b""), (5, b"")]
    kept = A.fingerprint_dedupe(spark.createDataFrame(rows, "id int, content binary"), "content", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]
