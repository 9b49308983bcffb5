"""Page structure: paragraphs, columns, running headers, figures, alignment.

Keys are (doc_id, page) or smaller, except running headers, whose per-document counts are partial
aggregates joined back. y grows downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WS, half_even, ordered_concat, overlap, trim_ws
from ..functions.ordered import islands
from ..rules import glyphs as R

PAGE = ["doc_id", "page"]
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def is_list_start(text: Column) -> Column:
    body = "|".join(R.LIST_STARTS).replace("{S}", WS)
    return text.rlike(f"^{WS}*({body})")


def same_row(a0, a1, b0, b1) -> Column:
    """Two boxes stand on one row: vertical overlap above half the smaller height."""
    h = F.least(a1 - a0, b1 - b0)
    return (h > 0) & (overlap(a0, a1, b0, b1) > 0.5 * h)


def row_stats(spans: DataFrame, row_key: list[str]) -> DataFrame:
    """Largest size, all-bold flag and text of each row; blank spans count for the text only."""
    ink = trim_ws("str") != ""
    return spans.groupBy(*row_key).agg(
        F.coalesce(F.max(F.when(ink, F.col("size"))), F.lit(0)).alias("size"),
        F.coalesce(F.bool_and(F.when(ink, F.col("flags").bitwiseAND(16) != 0)), F.lit(False)).alias("bold"),
        ordered_concat("str", "item_no", " ").alias("text"))


def split_paragraphs(rows: DataFrame, block: list[str], short_ratio: float = 0.1, indent_ratio: float = 0.85) -> DataFrame:
    """Number the paragraphs of each text block; rows carry row_no, x0, x1, y0, y1, text, size, bold."""
    w = Window.partitionBy(*block).orderBy("row_no")
    whole = w.rowsBetween(*ALL)
    width = F.col("x1") - F.col("x0")
    r = rows.select("*", F.row_number().over(w).alias("_k"), trim_ws("text").alias("_t"))
    wide = F.nullif(F.max(F.when(F.col("_k") > 1, width)).over(whole).cast("double"), F.lit(0.0))
    high = F.nullif(F.avg(F.col("y1") - F.col("y0")).over(whole), F.lit(0.0))
    r = r.select("*", wide.alias("_W"), high.alias("_H"), F.lag("_t").over(w).alias("_pt"), F.lag(width).over(w).alias("_pw"),
                 F.lag("size").over(w).alias("_ps"), F.lag("bold").over(w).alias("_pb"))
    ended = F.col("_pt").rlike(f"[{R.SENTENCE_ENDS}]\\z")
    short = F.col("_pw") / F.col("_W") <= 1.0 - short_ratio
    jump = (F.col("size") > 0) & (F.col("_ps") > 0) & (F.try_divide(F.greatest("size", "_ps"), F.least("size", "_ps")) > 1.15)
    start = ((ended & short) | (ended & ((F.col("_W") - width) / F.col("_H") >= indent_ratio)) | is_list_start(F.col("_t"))
             | jump | ((F.col("_pb") != F.col("bold")) & short))
    start = (F.col("_k") > 1) & F.coalesce(start, F.lit(False))
    return islands(r.withColumn("_start", start), block, ["row_no"], F.col("_start"), "para_no").select(*rows.columns, "para_no")


def join_lines(lines: DataFrame, max_spacing_ratio: float = 1.5) -> DataFrame:
    """Number the text blocks of a page; tables stand alone, image lines always break.

    Lines carry el_id (reading order), kind (line / image / table), y0, y1 and height. The usual gap is
    the most frequent one; of equally frequent gaps the first seen wins.
    """
    w = Window.partitionBy(*PAGE).orderBy("el_id")
    gap = half_even((F.col("y0") - F.lag("y1").over(w)).cast("double"), 2)
    r = lines.select("*", gap.alias("_g"))
    per_gap = Window.partitionBy(*PAGE, "_g")
    r = r.select("*", F.when(F.col("_g").isNotNull(), F.struct(F.count("*").over(per_gap).alias("n"), (-F.min("el_id").over(per_gap)).alias("o"))).alias("_rank"))
    r = r.select("*", F.coalesce(F.max_by("_g", "_rank").over(Window.partitionBy(*PAGE)), F.lit(0.0)).alias("_common"),
                 *[F.lag(c).over(w).alias(f"_p_{c}") for c in ("kind", "y0", "y1", "height")])
    h = half_even(F.col("_p_height").cast("double"), 2)
    usual = (F.col("_g") <= F.col("_common") + 1.0) & (F.col("_common") <= max_spacing_ratio * h)
    close = (F.col("_g") >= -0.5 * h) & (F.col("_g") <= 0.5 * h)
    row = same_row(F.col("_p_y0"), F.col("_p_y1"), F.col("y0"), F.col("y1"))
    image = (F.col("kind") == "image") | (F.col("_p_kind") == "image")
    start = (F.col("_p_kind").isNull() | (F.col("kind") == "table") | (F.col("_p_kind") == "table")
             | (~row & (image | ~(usual | close))))
    return islands(r.withColumn("_start", start), PAGE, ["el_id"], F.col("_start"), "block_no").select(*lines.columns, "block_no")


def line_spacing(rows: DataFrame, block: list[str]) -> DataFrame:
    """Exact line spacing of each block from the upper median of its row distances."""
    w = Window.partitionBy(*block).orderBy("y1")
    r = rows.select(*block, "row_no", "y0", "y1", "before_space", (F.lead("y1").over(w) - F.col("y1")).cast("double").alias("_d"))
    first = F.min_by(F.col("y1") - F.col("y0"), F.col("row_no")).cast("double")
    b = r.groupBy(*block).agg(first.alias("first_h"), (F.max("y1") - F.min("y0")).cast("double").alias("block_h"), F.count("*").alias("n"),
                              F.min_by("before_space", "row_no").cast("double").alias("before"), F.array_sort(F.collect_list("_d")).alias("_all"))
    ds = F.filter("_all", lambda d: d > 0.3 * F.col("first_h"))
    space = F.when(F.col("n") == 1, F.col("block_h")).when(F.size(ds) > 0, F.get(ds, F.floor(F.size(ds) / 2).cast("int"))).otherwise(
        (F.col("block_h") - F.col("first_h")) / (F.col("n") - 1))
    b = b.withColumn("_s", space).withColumn("_b", F.col("before") + F.col("first_h") - F.col("_s"))
    return b.select(*block, F.when(F.col("_b") < 0, F.col("_s") + F.col("_b") / F.col("n")).otherwise(F.col("_s")).alias("line_space"),
                    F.greatest("_b", F.lit(0.0)).alias("before_space"))


def text_extent(lines: DataFrame, width: Column, share: float = 0.75, page: list[str] | None = None) -> DataFrame:
    """`lines` with `extent`: the width that `share` of the lines of their page do not exceed, 1 at least. It stands for the
    width of the text column where the page does not say it; a few overlong lines do not move it."""
    every = F.sort_array(F.collect_list(width).over(Window.partitionBy(*(page or PAGE))))
    at = F.greatest(F.ceil(F.size(every) * share), F.lit(1)).cast("int")
    return lines.withColumn("extent", F.greatest(F.element_at(every, at), F.lit(1)))


def find_gutter(lines: DataFrame, work: tuple[float, float]) -> DataFrame:
    """The gap between two columns of each page, null where the page is not clearly two-column.

    The cost of a cut position is the height of the lines it crosses. Each line crosses one interval of
    positions, so the costs come from a running sum over interval ends instead of testing every
    position against every line.
    """
    x0, x1 = work
    start, last = x0 + 0.3 * (x1 - x0), int((x0 + 0.7 * (x1 - x0)) - (x0 + 0.3 * (x1 - x0)))
    body = lines.filter("horizontal").filter(F.length(trim_ws("text")) >= 2).select(
        *PAGE, *[F.col(c).cast("double").alias(c) for c in ("x0", "x1")], (F.col("y1") - F.col("y0")).cast("double").alias("h"))
    lo = F.greatest(F.floor(F.col("x0") + 1 - start) + 1, F.lit(0))
    hi = F.least(F.ceil(F.col("x1") - 1 - start) - 1, F.lit(last))
    def end(k, height):
        return F.struct(F.when(lo <= hi, k).otherwise(0).cast("long").alias("k"), F.when(lo <= hi, height).otherwise(F.lit(0.0)).alias("d"))
    ends = F.array(end(F.lit(0), F.lit(0.0)), end(lo, F.col("h")), end(hi + 1, -F.col("h")))
    events = body.select(*PAGE, F.inline(ends))
    cost = F.sum("d").over(Window.partitionBy(*PAGE).orderBy("k"))  # range frame: all ends at k count
    best = (events.select(*PAGE, "k", cost.alias("cost")).filter(F.col("k") <= last)
            .groupBy(*PAGE).agg(F.min(F.struct("cost", "k")).alias("_b")))
    g = body.join(best, PAGE).select(*PAGE, "x0", "x1", "h", F.col("_b.cost").alias("cost"), (F.lit(start) + F.col("_b.k")).alias("gx"))
    left, right, width = F.col("x1") <= F.col("gx") + 1, F.col("x0") >= F.col("gx") - 1, F.col("x1") - F.col("x0")

    def median(side):
        a = F.array_sort(F.collect_list(F.when(side, width)))
        return F.get(a, F.floor(F.size(a) / 2).cast("int"))
    s = g.groupBy(*PAGE).agg(
        F.first("cost").alias("cost"), F.first("gx").alias("gx"), F.count("*").alias("n"), F.sum("h").alias("total"),
        F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.sum(F.when(left, F.col("h"))).alias("lh"), F.sum(F.when(right, F.col("h"))).alias("rh"),
        median(left).alias("lw"), median(right).alias("rw"), F.min(F.when(left, F.col("x0"))).alias("l0"), F.max(F.when(right, F.col("x1"))).alias("r1"))
    lcol, rcol = F.col("gx") - F.col("l0"), F.col("r1") - F.col("gx")
    good = ((F.col("n") >= 12) & (F.col("cost") <= 0.25 * F.col("total")) & (F.col("nl") >= 6) & (F.col("nr") >= 6)
            & (F.col("lh") >= 0.2 * F.col("total")) & (F.col("rh") >= 0.2 * F.col("total")) & F.try_divide(lcol, rcol).between(0.5, 2)
            & (F.col("lw") >= 0.6 * lcol) & (F.col("rw") >= 0.6 * rcol))
    return s.select(*PAGE, F.when(F.coalesce(good, F.lit(False)), F.col("gx")).alias("gutter"))


def assign_bands(elements: DataFrame, gutters: DataFrame) -> DataFrame:
    """Side (L / R / F) and band of every element of a two-column page.

    Full-width elements merge into bands; the others fall into the band around their centre or into the
    stretch between bands. Bands and elements are swept together in y order, without a range join.
    """
    e = elements.join(gutters.filter("gutter is not null"), PAGE)
    side = F.when(F.col("x1") <= F.col("gutter") + 2, "L").when(F.col("x0") >= F.col("gutter") - 2, "R").otherwise("F")
    e = e.withColumn("side", side)
    w = Window.partitionBy(*PAGE).orderBy("y0", "y1")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    full = e.filter("side = 'F'").select(*PAGE, "y0", "y1", reach.alias("_reach"))
    full = islands(full, PAGE, ["y0", "y1"], F.col("_reach").isNull() | (F.col("y0") > F.col("_reach") + 1), "_i")
    ranges = full.groupBy(*PAGE, "_i").agg(F.min("y0").cast("double").alias("_at"), F.max("y1").cast("double").alias("_end"))
    at = F.when(F.col("side") == "F", F.col("y0").cast("double")).otherwise((F.col("y0") + F.col("y1")) / 2)
    names = [c for c in e.columns if c not in PAGE]
    both = (e.select(*PAGE, at.alias("_at"), F.lit(None).cast("double").alias("_end"), F.struct(*names).alias("e"))
            .unionByName(ranges.select(*PAGE, "_at", "_end"), allowMissingColumns=True))
    sweep = Window.partitionBy(*PAGE).orderBy("_at")
    swept = both.select("*", F.count("_end").over(sweep).alias("_n"), F.max("_end").over(sweep).alias("_cover")).filter("e is not null")
    inside = (F.col("_n") > 0) & ((F.col("e.side") == "F") | (F.col("_at") <= F.col("_cover")))
    return swept.select(*PAGE, "e.*", F.when(inside, "F").otherwise("C").alias("band_kind"), F.when(inside, F.col("_n") - 1).otherwise(F.col("_n")).alias("band_no"))


def sections(banded: DataFrame, top: float) -> DataFrame:
    """Sections of a two-column page: bands in order of their top, neighbouring one-column bands merged."""
    def n_lines(s):
        return F.count_if((F.col("side") == s) & (F.col("kind") == "line"))
    b = banded.groupBy(*PAGE, "band_kind", "band_no").agg(
        F.min("y0").cast("double").alias("y0"), F.max("y1").cast("double").alias("y1"), n_lines("L").alias("nl"), n_lines("R").alias("nr"),
        F.count("*").alias("n"), F.min("el_id").alias("first_el"))
    w = Window.partitionBy(*PAGE).orderBy("y0", "first_el")
    one = (F.col("band_kind") == "F") | (F.col("nl") < 3) | (F.col("nr") < 3)
    b = b.withColumn("one", one).select("*", F.coalesce(F.lag("one").over(w), F.lit(False)).alias("_p1"),
                                        F.coalesce(F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(top)).alias("_ref"))
    b = b.withColumn("_ref", F.greatest("_ref", F.lit(float(top))))
    b = islands(b, PAGE, ["y0", "first_el"], ~(F.col("one") & F.col("_p1")), "section_no")
    order = F.struct("y0", "first_el")
    return b.groupBy(*PAGE, "section_no").agg(
        F.when(F.min_by("one", order), 1).otherwise(2).alias("n_cols"),
        half_even(F.greatest(F.min_by(F.col("y0") - F.col("_ref"), order), F.lit(0.0)), 1).alias("before_space"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n_elements"))


def norm_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{WS}+", ""), r"\p{Nd}+", "#")


_PAGE_NUM = "(?i)" + R.PAGE_NUMBER.replace("{S}", WS)


def page_number(text: Column) -> Column:
    """Struct (pre, num, post), null for text that is no page number."""
    parts = [F.regexp_extract(text, _PAGE_NUM, i) for i in (1, 2, 3)]
    return F.when(text.rlike(_PAGE_NUM), F.struct(*[p.alias(n) for p, n in zip(parts, ("pre", "num", "post"))]))


def line_align(x0: Column, x1: Column, width: Column) -> Column:
    c = (x0 + x1) / 2
    return F.when(F.abs(c - width / 2) < 0.12 * width, "center").when(c > width / 2, "right").otherwise("left")


def running_headers(lines: DataFrame, n_pages: DataFrame) -> DataFrame:
    """Header and footer lines of every page.

    `n_pages` (doc_id, n_pages) counts a document's pages. Repetition is counted by a partial aggregate
    per (document, zone, text, height) and joined back to the few lines in the margins, so a long
    document is never one task's work.
    """
    ln = lines.filter(F.col("horizontal") & (trim_ws("text") != ""))
    zone = F.when(F.col("y1") <= 0.12 * F.col("page_h"), "top").when(F.col("y0") >= 0.88 * F.col("page_h"), "bottom")
    edge = ln.withColumn("zone", zone).filter("zone is not null").select(
        "*", norm_text(F.col("text")).alias("_norm"), half_even(F.col("y0") / 6).cast("long").alias("_bin"), trim_ws("text").alias("_t"))
    key = ["doc_id", "zone", "_norm", "_bin"]
    need = F.greatest(F.lit(2.0), 0.4 * F.col("n_pages"))
    often = (edge.groupBy(*key).agg(F.count("*").alias("_seen")).filter("_seen >= 2").join(n_pages, "doc_id")
             .filter((F.col("n_pages") >= 2) & (F.col("_seen") >= need)).select(*key, F.lit(True).alias("_rep")))
    numbered = F.col("_t").rlike(_PAGE_NUM) & (F.length("_t") <= 16)
    # Margin lines learn whether they repeat; then each page is judged on its own from one gathered array
    # (a sheet holds few lines, and text travels only with candidates).
    flagged = (edge.join(often, key, "left").withColumn("_cand", F.coalesce("_rep", F.lit(False)) | numbered)
               .select(*PAGE, "el_id", "zone", "x0", "x1", "y0", "y1", "page_w", "_cand", F.when(F.col("_cand"), F.col("_t")).alias("text")))
    rest = ln.filter(zone.isNull()).select(*PAGE, "el_id", F.lit(None).cast("string").alias("zone"), "x0", "x1", "y0", "y1", "page_w",
                                           F.lit(False).alias("_cand"), F.lit(None).cast("string").alias("text"))
    fields = ["el_id", "zone", "x0", "x1", "y0", "y1", "page_w", "_cand", "text"]
    pages = flagged.unionByName(rest).groupBy(*PAGE).agg(F.collect_list(F.struct(*fields)).alias("_l"))
    pages = pages.filter((F.size("_l") >= 2) & F.exists("_l", lambda s: s["_cand"]))

    def alone(s):
        return ~F.exists("_l", lambda o: (o["el_id"] != s["el_id"]) & same_row(o["y0"], o["y1"], s["y0"], s["y1"]))
    pages = pages.withColumn("_found", F.filter("_l", lambda s: s["_cand"] & alone(s)))
    body = F.filter("_l", lambda s: ~F.exists("_found", lambda f: f["el_id"] == s["el_id"]))
    pages = pages.withColumn("_b", body).filter(F.size("_b") > 0)
    pages = pages.withColumn("_top", F.array_min(F.transform("_b", lambda s: s["y0"]))).withColumn("_bottom", F.array_max(F.transform("_b", lambda s: s["y1"])))
    kept = F.filter("_found", lambda s: F.when(s["zone"] == "top", s["y1"] <= F.col("_top")).otherwise(s["y0"] >= F.col("_bottom")))
    out = pages.select(*PAGE, F.inline(kept))
    return out.select(*PAGE, "el_id", "zone", "text", "x0", "x1", "y0", "y1", line_align(F.col("x0"), F.col("x1"), F.col("page_w")).alias("align"))


def page_margins(pages: DataFrame) -> DataFrame:
    """Margins that keep running headers outside the body. Needs top, bottom, page_h, v0, v1 (body extent) and
    the nullable extents head_y0/head_y1/foot_y0/foot_y1."""
    def margin(cur, h, free):
        return half_even(F.least(F.greatest(cur, h + 4), F.greatest(free - 1, F.lit(1.0))), 1)
    hh, fh = F.col("head_y1") - F.col("head_y0"), F.col("foot_y1") - F.col("foot_y0")
    p = pages.withColumn("new_top", F.when(hh.isNotNull(), margin(F.col("top"), hh, F.col("v0"))).otherwise(F.col("top")))
    p = p.withColumn("new_bottom", F.when(fh.isNotNull(), margin(F.col("bottom"), fh, F.col("page_h") - F.col("v1"))).otherwise(F.col("bottom")))
    return (p.withColumn("header_distance", F.when(hh.isNotNull(), F.greatest(F.lit(2.0), F.least(F.col("head_y0"), F.col("new_top") - hh - 1))))
            .withColumn("footer_distance", F.when(fh.isNotNull(), F.greatest(F.lit(2.0), F.least(F.col("page_h") - F.col("foot_y1"), F.col("new_bottom") - fh - 1)))))


def is_figure_region(lines: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    n = F.length(trim_ws(text))
    s = lines.groupBy(*key).agg(F.count_if(n > 0).alias("_n"), F.coalesce(F.sum(n), F.lit(0)).alias("_chars"), F.count_if(n > 25).alias("_long"))
    return s.select(*key, ((F.col("_n") == 0) | ((F.col("_chars") <= 300) & (F.col("_long") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 6)))))
                    .alias("is_figure"))


def grow_regions(regions: DataFrame, labels: DataFrame, sizes: DataFrame, near: float = 10, rounds: int = 3) -> DataFrame:
    """Let figure regions (above 30x30) absorb short small labels around them; the box grows within a round.

    `sizes` (doc_id, page, size) are the span sizes whose upper median is the body size. Only labels short
    and small enough are gathered, per page.
    """
    body = sizes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.col("size").cast("double"))).alias("_s"))
    body = body.select(*PAGE, F.get("_s", F.floor(F.size("_s") / 2).cast("int")).alias("_body"))
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    lab = (labels.join(body, PAGE, "left").filter((F.length(trim_ws("text")) <= 20) & (F.col("size") <= F.coalesce("_body", F.lit(10.0))))
           .filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
           .groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("label_no", *box))).alias("_l")))

    def absorb(r, b):
        inside = (b["x0"] >= r["x0"]) & (b["y0"] >= r["y0"]) & (b["x1"] <= r["x1"]) & (b["y1"] <= r["y1"])
        touches = ((b["x0"] < r["x1"] + near) & (b["x1"] > r["x0"] - near) & (b["y0"] < r["y1"] + near) & (b["y1"] > r["y0"] - near))
        grown = F.struct(F.least(r["x0"], b["x0"]).alias("x0"), F.least(r["y0"], b["y0"]).alias("y0"),
                         F.greatest(r["x1"], b["x1"]).alias("x1"), F.greatest(r["y1"], b["y1"]).alias("y1"))
        return F.when(~inside & touches, grown).otherwise(r)

    r = regions.select(*PAGE, "region_no", F.struct(*box).alias("_r")).join(lab, PAGE, "left")
    r = r.withColumn("_l", F.coalesce("_l", F.expr("cast(array() as array<struct<label_no:int,x0:double,y0:double,x1:double,y1:double>>)")))
    out = r.withColumn("_r", F.when((F.col("_r.x1") - F.col("_r.x0") > 30) & (F.col("_r.y1") - F.col("_r.y0") > 30), F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.col("_r"), lambda acc, _: F.aggregate("_l", acc, absorb))).otherwise(F.col("_r")))
    return out.select(*PAGE, "region_no", "_r.*")


def text_outside_figures(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Drop lines inside a region or covered by one over more than 0.8 of their area."""
    r = regions.select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    inside = (F.col("x0") >= F.col("_x0")) & (F.col("y0") >= F.col("_y0")) & (F.col("x1") <= F.col("_x1")) & (F.col("y1") <= F.col("_y1"))
    wide = F.greatest(overlap("x0", "x1", "_x0", "_x1"), F.lit(0))
    high = F.greatest(overlap("y0", "y1", "_y0", "_y1"), F.lit(0))
    covered = wide * high > 0.8 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return lines.join(r, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page")) & (inside | covered), "left_anti")


# --- cells ------------------------------------------------------------------------------------------

def ink_rows(chars: DataFrame, row_key: list[str]) -> DataFrame:
    """Extent without blanks and raw text of each row of a cell."""
    ink = trim_ws("c") != ""
    return chars.groupBy(*row_key).agg(F.min(F.when(ink, F.col("x0"))).alias("ink0"), F.max(F.when(ink, F.col("x1"))).alias("ink1"),
                                       ordered_concat("c", "char_no").alias("text"))


def cell_alignment(rows: DataFrame, cells: DataFrame, cell_key: list[str], left: float = 1.0, right: float = 1.0, center: float = 2.0) -> DataFrame:
    """Alignment of the text of table cells. `rows` = ink rows (+ optional n_pieces), `cells` = box and prior alignment."""
    pieces = F.col("n_pieces") if "n_pieces" in rows.columns else F.lit(1)
    t = trim_ws("text")
    r = rows.groupBy(*cell_key).agg(
        F.count("*").alias("n"), F.max(pieces).alias("_pieces"), F.bool_and(F.col("ink0").isNotNull()).alias("_ink"),
        F.bool_and((t != "") & ~t.rlike(WS)).alias("_words"), F.bool_and(F.col("text") == t).alias("_tight"),
        *[f(c).cast("double").alias(n) for n, f, c in (("a0", F.min, "ink0"), ("a1", F.max, "ink0"), ("b0", F.min, "ink1"), ("b1", F.max, "ink1"))],
        F.min((F.col("ink0") + F.col("ink1")) / 2).alias("c0"), F.max((F.col("ink0") + F.col("ink1")) / 2).alias("c1"))
    j = cells.join(r, cell_key)
    dl, dr = F.col("a0") - F.col("x0"), F.col("x1") - F.col("b1")
    mid = F.abs(dl - dr) / 2 < center
    lft, rgt, ctr = (F.col("a1") - F.col("a0") <= left), (F.col("b1") - F.col("b0") <= right), (F.col("c1") - F.col("c0") <= center)
    usable = (F.col("_pieces") <= 1) & F.col("_ink")
    one = usable & (F.col("n") == 1) & ~F.col("_tight")
    many = usable & (F.col("n") > 1) & F.col("_words") & (lft | rgt | ctr)
    single = F.when(mid, "center").when(dl <= 0.25 * (F.col("x1") - F.col("x0")), "left").otherwise("right")
    multi = (F.when(lft & rgt, F.when(mid, "center").when(dl < dr, "left").otherwise("right")).when(rgt, "right").when(ctr, "center").otherwise("left"))
    align = F.when(one, single).when(many, multi).otherwise(F.col("prior"))
    space = F.lit(0.0)
    j = j.withColumn("align", align).withColumn("hard_rows", F.coalesce(many, F.lit(False)))
    return j.select(*cell_key, "align", "hard_rows",
                    F.when(one | (many & (F.col("align") == "left")), F.greatest(space, dl)).when(many, space).alias("left_space"),
                    F.when(one | (many & (F.col("align") == "right")), F.greatest(space, dr)).when(many, space).alias("right_space"))


def hard_breaks(rows: DataFrame, cell_key: list[str], hard: str = "hard_rows", order: str = "row_no") -> DataFrame:
    """In hard-broken cells every row but the last ends with a break. The last row comes from a partial aggregate."""
    last = rows.groupBy(*cell_key).agg(F.max(order).alias("_last"))
    return rows.join(last, cell_key).withColumn("line_break", F.col(hard) & (F.col(order) < F.col("_last"))).drop("_last")


def trim_cell_edges(lines: DataFrame, cell_key: list[str], order: str = "row_no") -> DataFrame:
    """Strip the blank edges of a cell's text and the blanks around its hard breaks, nothing else."""
    w = Window.partitionBy(*cell_key).orderBy(order)
    head = F.lag("line_break").over(w).isNull() | F.lag("line_break").over(w)
    tail = F.lead(order).over(w).isNull() | F.col("line_break")
    t = lines.select("*", head.alias("_h"), tail.alias("_e"))
    text = F.when(F.col("_h"), F.regexp_replace("text", f"^{WS}+", "")).otherwise(F.col("text"))
    t = t.withColumn("text", text)
    return t.withColumn("text", F.when(F.col("_e"), F.regexp_replace("text", f"{WS}+\\z", "")).otherwise(F.col("text"))).drop("_h", "_e")


def classify_path_groups(paths: DataFrame, groups: DataFrame, inner: DataFrame, small: float = 6.0) -> DataFrame:
    """Table/shape or picture per group of paths, and how many small curves are set apart.

    Each path belongs to the first group it touches; paths inside an inner contour of that group are left out.
    """
    def touching(a, b):
        return ((F.col(f"{a}x0") < F.col(f"{b}x1")) & (F.col(f"{a}x1") > F.col(f"{b}x0"))
                & (F.col(f"{a}y0") < F.col(f"{b}y1")) & (F.col(f"{a}y1") > F.col(f"{b}y0")))
    p = paths.select(*PAGE, "path_no", "axis", *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    g = groups.select(*PAGE, "group_no", *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    own = (p.join(g, PAGE).filter(touching("p_", "g_")).groupBy(*PAGE, "path_no")
           .agg(F.min("group_no").alias("group_no"), *[F.first(c).alias(c) for c in ("axis", "p_x0", "p_y0", "p_x1", "p_y1")]))
    i = inner.select(*PAGE, "group_no", *[F.col(c).alias(f"i_{c}") for c in ("x0", "y0", "x1", "y1")])
    held = ((own.doc_id == i.doc_id) & (own.page == i.page) & (own.group_no == i.group_no) & (own.p_x0 >= i.i_x0) & (own.p_y0 >= i.i_y0)
            & (own.p_x1 <= i.i_x1) & (own.p_y1 <= i.i_y1))
    left = own.join(i, held, "left_anti")
    tiny = ~F.col("axis") & (F.greatest(F.col("p_x1") - F.col("p_x0"), F.col("p_y1") - F.col("p_y0")) <= small)
    s = left.groupBy(*PAGE, "group_no").agg(F.count_if(tiny).alias("n_small"), F.count_if(~tiny).alias("_rest"), F.bool_and(F.when(~tiny, F.col("axis"))).alias("_axis"))
    s = groups.select(*PAGE, "group_no").join(s, [*PAGE, "group_no"], "left")
    table = (F.coalesce("_rest", F.lit(0)) > 0) & F.coalesce("_axis", F.lit(False))
    return s.select(*PAGE, "group_no", F.when(table, "table").otherwise("picture").alias("kind"), F.coalesce("n_small", F.lit(0)).alias("n_small"))
