import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiremill.functions import passes
from quiremill.operators import glyphs as G
from quiremill.operators import layout as D
from quiremill.operators import tables as T
from quiremill.operators import text as B
from quiremill.sources import sinks


def plain_two_means(values, rounds=20):
    """The rule round by round over one list."""
    c1, c2 = values[0], values[-1]
    for _ in range(rounds):
        t = (c1 + c2) / 2
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        if not low or not high:
            break
        n1, n2 = sum(low) / len(low), sum(high) / len(high)
        if (n1, n2) == (c1, c2):
            break
        c1, c2 = n1, n2
    return c1, c2


def test_two_means_of_many_stretches():
    rng = random.Random(4)
    lists = [sorted(rng.choice([rng.random(), rng.random() + 3, 0.5]) for _ in range(rng.randint(2, 60))) for _ in range(200)] + [[1.0, 1.0], [2.0]]
    begin = np.cumsum([0, *map(len, lists)])[:-1]
    got = passes.two_means(np.array([v for x in lists for v in x]), begin)
    want = np.array([plain_two_means(x) for x in lists]).T
    assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[1], want[1], atol=1e-12)
    assert [len(x) for x in passes.two_means(np.zeros(0), np.zeros(0, int))] == [0, 0]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_batches_hold_whole_keys(size):
    rng = random.Random(size)
    keys = [k for k in range(40) for _ in range(rng.choice([1, 1, 2, 30]))]
    first = [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(first)], ["k", passes.FIRST])
    cut = [whole.slice(i, size) for i in range(0, len(keys), size)]
    got = [b.column(0).to_pylist() for b in passes.whole_keys(iter([whole.slice(0, 0), *cut]))]
    assert sum(got, []) == keys
    seen = [set(x) for x in got]
    assert sum(map(len, seen)) == len(set(keys))  # no key in two batches


def test_per_key_on_spark(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.random(), i) for i in range(3000)] + [(99, rng.random(), 10_000 + i) for i in range(25_000)]  # a key longer than a batch
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(5)

    def ranks(batch):
        first = passes.column(batch, passes.FIRST)
        start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        return [batch.column(0), batch.column(2), pa.array(np.arange(len(first)) - start)]

    schema = spark.createDataFrame([], "k int, i int, n long").schema
    got = {(r.k, r.i): r.n for r in passes.per_key(df, ["k"], ["v"], ranks, schema).collect()}
    by = defaultdict(list)
    for k, v, i in rows:
        by[k].append((v, i))
    assert got == {(k, i): n for k, x in by.items() for n, (_, i) in enumerate(sorted(x))}
    assert passes.per_key(df.filter("false"), ["k"], ["v"], ranks, schema).count() == 0


def plain_spaces(glyphs, runs):
    """The rule of restore_spaces over all glyphs of a page for every blank of its runs."""
    hit = set()
    for doc, page, _, text, x, y, h, cx in runs:
        if len(cx) < len(text):
            continue
        for i, c in enumerate(text):
            if c != " " or (i and text[i - 1] == " "):
                continue
            near = [g for g in glyphs if g[:2] == (doc, page) and y - 1 <= g[5] <= y + h * 1.6 + 1]
            sx = x + cx[max(i - 1, 0)]
            if i == 0:
                found = [g for g in near if sx - 2 * (h or 10.0) < g[4] < sx - 0.5]
                pick = max(found, key=lambda g: (g[4], g[2]), default=None)
            else:
                found = [g for g in near if abs(g[4] - sx) < 0.8]
                pick = min(found, key=lambda g: (g[4], g[2]), default=None)
            if pick:
                hit.add((doc, page, pick[2]))
    return {(g[0], g[1], g[2]): g[3] + " " if (g[0], g[1], g[2]) in hit and not g[3].endswith(" ") else g[3] for g in glyphs}


@pytest.mark.parametrize("seed", range(4))
def test_restored_spaces_on_crowded_pages(spark, seed):
    """Rows closer than a run reaches, glyphs on one spot, equal places of glyphs and spots."""
    rng = random.Random(seed)
    glyphs, runs = [], []
    for doc in (1, 2):
        for page in range(3):
            for n in range(120):
                glyphs.append((doc, page, n, rng.choice(["a", "b", "c "]), rng.choice([rng.randrange(60) * 0.5, rng.randrange(30) + 0.2]), rng.choice([10.0, 14.0, 21.0, 60.0])))
            for r in range(25):
                text = "".join(rng.choice("ab  ") for _ in range(rng.randint(1, 6)))
                cx = [6.0 * k for k in range(len(text) - (rng.random() < 0.1))]
                runs.append((doc, page, r, text, rng.randrange(60) * 0.5, rng.choice([10.0, 12.0, 20.0, 59.0]), rng.choice([0.0, 3.0, 6.0]), cx))
    g = spark.createDataFrame(glyphs, "doc_id long, page int, glyph_no long, c string, x double, y double").repartition(4)
    r = spark.createDataFrame(runs, "doc_id long, page int, run_no int, text string, x double, y double, h double, char_x array<double>")
    got = {(x.doc_id, x.page, x.glyph_no): x.c for x in G.restore_spaces(g, r).collect()}
    want = plain_spaces(glyphs, runs)
    assert got == want and sum(v.endswith(" ") for v in want.values()) > 30


def test_blanks_drawn_twice_are_dropped_like_one_by_one():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 40)
        first = np.array([True] + [rng.random() < 0.1 for _ in range(n - 1)])
        blank = np.array([rng.random() < 0.7 for _ in range(n)])
        x0 = np.sort(np.array([rng.random() * 30 for _ in range(n)]))
        x1 = x0 + np.array([rng.random() * 4 for _ in range(n)])
        want, kept = [], None
        for i in range(n):
            if first[i] or not blank[i] or kept is None:
                kept, stay = (x0[i], x1[i]) if blank[i] else None, True
            else:
                wide = max(kept[1] - kept[0], x1[i] - x0[i], 0.1)
                stay = not min(kept[1], x1[i]) - max(kept[0], x0[i]) > 0.3 * wide
                kept = (x0[i], x1[i]) if stay else kept
            want.append(stay)
        assert G._kept_blanks(blank, first, x0, x1).tolist() == want


def test_merged_lines_equal_the_windows(spark):
    """One pass gives what grouping, overprint_dedupe and numbering give one after the other."""
    rng = random.Random(8)
    rows = []
    for line in range(20):
        x = 0.0
        for piece in range(3):
            for k in range(rng.randint(1, 6)):
                for copy in range(rng.choice([1, 1, 1, 2])):
                    c = rng.choice("ab ")
                    rows.append((1, line // 10, line * 10 + piece, k * 5 + copy, c, x + copy * rng.choice([0, 1, 3]), x + 6 + copy, 20.0 * line, 20.0 * line + 10, 10, line % 5 != 0))
                x += 6
    df = spark.createDataFrame(rows, "doc_id long, page int, piece_no long, ord long, c string, x0 double, x1 double, y0 double, y1 double, size int, horizontal boolean").repartition(3)
    got = sorted((r.page, r.line, r.ord, r.c, r.x0) for r in G.merge_row_pieces(df).collect())
    pieces = df.filter("horizontal").groupBy("doc_id", "page", "piece_no").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.max, "size"))])
    place = {}
    members = defaultdict(list)
    for r in G.group_pieces(G.group_rows(pieces)).collect():
        members[r.page, r.row_key, r.group_key].append(r.piece_no)
    for m in members.values():
        for p in m:
            place[p] = (min(m), len(m))
    joined = df.rdd.map(lambda r: r.asDict()).collect()
    for r in joined:
        r["_group"], r["_n"] = place.get(r["piece_no"], (r["piece_no"], 1))
    checked = G.overprint_dedupe(spark.createDataFrame(joined), ["doc_id", "page", "_group"], ["piece_no", "ord"]).collect()
    lines = defaultdict(list)
    for r in checked:
        apart = r["overprinted"] or r["_n"] == 1
        if apart or r["keep"]:
            lines[r["page"], r["piece_no"] if apart else r["_group"]].append(((0, r["piece_no"], r["ord"]) if apart else ((r["x0"] + r["x1"]) / 2, r["piece_no"], r["ord"]), r["c"], r["x0"]))
    want = sorted((page, line, n + 1, c, x0) for (page, line), v in lines.items() for n, (_, c, x0) in enumerate(sorted(v)))
    assert got == want


def test_line_text(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), 0, rng.randrange(40), i, rng.choice(["a", "\u00e9", "\u6f22", "", None, "xy"])) for i in range(4000)]
    rows += [(9, 0, 0, i, "z\u0304") for i in range(25_000)] + [(9, 0, 1, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line int, ord long, c string").repartition(5)
    want = defaultdict(list)
    for doc, page, line, i, c in rows:
        want[doc, page, line].append((i, c or ""))
    got = {(r.doc_id, r.page, r.line): r.text for r in G.line_text(df).collect()}
    assert got == {k: "".join(c for _, c in sorted(v)) for k, v in want.items()}


def test_pieces_of_a_long_document(spark):
    """A document of many pages is spread, and its pieces joined are its text."""
    paras = spark.range(0, 3000, 1, 4).selectExpr("1L as doc_id", "cast(id as int) as page", "0 as para_no", "concat('page ', id, ' é漢') as text").filter("page % 7 <> 3")
    pages = spark.createDataFrame([(1, 3000), (2, 2)], "doc_id long, n_pages long")
    got = B.document_pieces(paras, pages, width=100)
    rows = got.orderBy("doc_id", "piece_no").collect()
    whole = {r.doc_id: r.text for r in B.document_text(paras, pages).collect()}
    for doc in (1, 2):
        mine = [r for r in rows if r.doc_id == doc]
        assert "".join(r.text for r in mine) == whole[doc]
        assert [r.begin for r in mine] == [len("".join(x.text for x in mine[:i])) for i in range(len(mine))][:len(mine)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so few rows into one task
    try:
        assert len(B.document_pieces(paras, pages, width=100).filter("doc_id = 1").groupBy(F.spark_partition_id()).count().collect()) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_pieces_are_written_and_joined(spark, tmp_path):
    import io
    rows = spark.createDataFrame([(1, 1, 2, ["a", "1"]), (1, 1, 1, ["h", None]), (1, 2, 1, ["x"])], "doc_id long, sheet_no int, row_no int, cells array<string>").withColumn("sheet_name", F.lit("t"))
    sinks.write_pieces(T.sheet_pieces(rows), str(tmp_path / "p"), ["doc_id", "sheet_no"])
    pieces = spark.read.parquet(str(tmp_path / "p"))
    for r in T.sheet_markup(rows).collect():
        out = io.StringIO()
        assert sinks.join_pieces(pieces, out, doc_id=r.doc_id, sheet_no=r.sheet_no) == len(r.xml) and out.getvalue() == r.xml
    with pytest.raises(ValueError):
        sinks.join_pieces(pieces.filter("piece_no <> 1"), io.StringIO(), doc_id=1, sheet_no=1)


def test_text_extent(spark):
    rows = [(1, 0, n) for n in (10, 20, 30, 40, 9000)] + [(1, 1, 0), (1, 1, 0), (2, 0, 7)]
    got = {(r.doc_id, r.page): r.extent for r in D.text_extent(spark.createDataFrame(rows, "doc_id long, page int, n int"), F.col("n")).collect()}
    assert got == {(1, 0): 40, (1, 1): 1, (2, 0): 7}


def test_restored_pages_are_joined_by_line_in_the_same_pass(spark):
    """Lines that stand mixed on a page, null lines and null pages among them."""
    rng = random.Random(7)
    glyphs = [(doc, page, rng.choice([None, 0, 1, 2]), n, n, rng.choice("abc"), rng.randrange(60) * 0.5, rng.choice([10.0, 14.0, 21.0]))
              for doc in (1, None) for page in (0, None, 2) for n in range(80)]
    runs = [(doc, page, r, "a b cc d", rng.randrange(60) * 0.5, rng.choice([10.0, 12.0, 20.0]), 3.0, [6.0 * k for k in range(8)])
            for doc in (1, None) for page in (0, 2) for r in range(20)]
    g = spark.createDataFrame(glyphs, "doc_id long, page int, line int, glyph_no long, ord long, c string, x double, y double").repartition(4)
    r = spark.createDataFrame(runs, "doc_id long, page int, run_no int, text string, x double, y double, h double, char_x array<double>")
    out = G.restore_spaces(g, r)
    want = out.select("*").groupBy(*G.LINE).agg(F.expr("listagg(c, '') within group (order by ord)").alias("text")).collect()
    joined = G.line_text(out)
    assert joined._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, want), key=str) and any(" " in w.text for w in want)
