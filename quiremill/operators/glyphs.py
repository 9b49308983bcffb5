"""Character- and run-level cleanup.

Characters are rows keyed by LINE = (doc_id, page, line) and ordered by `ord`. Every window here is
bounded by one printed line, and all of them share the exchange on the line key.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.columns import CJK, HANGUL, WS, half_even, ordered_concat, trim_ws
from ..functions.ordered import islands
from ..functions.passes import FIRST, Rows, also, behind, column, in_hand, matching, meeting, per_key, ranked, text_codes, two_means
from ..rules import glyphs as R
from ..session import ensure_checkpoint_dir

LINE = ["doc_id", "page", "line"]
PAGE = ["doc_id", "page"]
ALNUM = "[A-Za-z0-9]"


def _blank(c) -> Column:
    """Nothing but white space. Text that starts with a visible ASCII character is settled without the pattern."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.between("!", "~"), F.lit(False)).otherwise(c.rlike(f"^{WS}*$"))


def normalize_bullets(text: Column) -> Column:
    src, dst = "".join(R.PRIVATE_BULLETS), "".join(R.PRIVATE_BULLETS.values())
    return F.translate(text, src, dst)


def synthetic_flag(char_flags: Column, mark: Column) -> Column:
    return (char_flags.bitwiseAND(R.SYNTHETIC_BITS) != 0) | F.coalesce(mark, F.lit(False))


def line_text(chars: DataFrame, key: list[str] | None = None, order: str | list[str] = "ord") -> DataFrame:
    """Text of every line: the characters `c` in `order`, null ones left out. Lines that a pass has just left are joined within
    that pass."""
    key = key or LINE
    schema = StructType([*(chars.schema[k] for k in key), StructField("text", StringType())])
    work = partial(_joined, keys=key)
    by = [order] if isinstance(order, str) else order
    joined = behind(chars, key, work, schema, by)
    return per_key(chars.select(*key, *by, "c"), key, by, work, schema) if joined is None else joined


def _joined(batch, keys: list[str]):
    """Key columns and the joined text of whole lines. The characters already stand in one buffer: only the places at which
    a text begins are new."""
    import numpy as np
    import pyarrow as pa

    rows = Rows.of(batch)
    c, begin = rows.arrow("c"), np.flatnonzero(column(rows, FIRST))
    if pa.types.is_large_string(c.type):
        c = c.cast(pa.string())
    _, offsets, data = c.buffers()
    offsets = np.frombuffer(offsets, np.int32)[c.offset:c.offset + len(c) + 1]
    ends = pa.py_buffer(np.append(offsets[begin], offsets[-1]).astype(np.int32))
    kept = rows.take(begin)
    return [*(kept.arrow(k) for k in keys), pa.StringArray.from_buffers(len(begin), ends, data or pa.py_buffer(b""))]


def bbox_union(boxes: DataFrame, key: list[str]) -> DataFrame:
    return boxes.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def merge_runs(spans: DataFrame) -> DataFrame:
    """Join spans of a line to the run before: blank ones always, others when style and spacing equal
    those of the run's first span. One window brings a line's spans in order, one pass over whole lines joins them."""
    fields = ["span", "text", "font", "size", "flags", "color", "alpha", "spacing", "x0", "y0", "x1", "y1"]
    kinds = {f.name: f.dataType for f in spans.schema} | {"run": IntegerType(), "text": StringType(), "n_spans": LongType()}
    out = [*LINE, "run", "text", *_STYLE, "n_spans", "x0", "y0", "x1", "y1"]
    schema = StructType([StructField(c, kinds[c]) for c in out])
    if in_hand(spans, LINE):
        return behind(spans, LINE, partial(_runs_in_hand, white=_white(spans)), schema, ["span"])
    marked = spans.select(*LINE, *fields, F.coalesce(_blank("text"), F.lit(False)).alias("_blank"),
                          F.col("size").cast("double").alias("_size"), F.col("spacing").cast("double").alias("_spacing"))
    return per_key(marked, LINE, fields, _runs, schema)


def _white(df: DataFrame):
    return matching(df.sparkSession, f"^{WS}$")


def _runs_in_hand(rows, white):
    """The same for spans that a pass has in hand."""
    import numpy as np

    code, n = text_codes(rows.arrow("text"))
    inked = np.concatenate([[0], np.cumsum(~white[code])])
    end = np.cumsum(n)
    null = rows.null("text")
    blank = (inked[end] == inked[end - n]) & (True if null is None else ~null)
    return _runs(rows.plus(_blank=blank, _size=column(rows, "size").astype(float), _spacing=column(rows, "spacing").astype(float)))


_STYLE = ["font", "size", "flags", "color", "alpha", "spacing"]


def _runs(batch):
    """Columns of the runs of whole lines."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    of = Rows.of(batch).arrow

    first = column(batch, FIRST).astype(bool)
    cut = _run_starts(first, column(batch, "_blank").astype(bool),
                      [pc.fill_null(of(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in ("font", "flags", "color", "alpha")],
                      column(batch, "_size").astype(float), column(batch, "_spacing").astype(float))
    begin = np.flatnonzero(cut)
    count = np.cumsum(cut)
    made = {"run": pa.array((count - count[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))])[begin]),
            "n_spans": pa.array(np.diff(np.append(begin, len(cut))))}
    some = np.logical_or.reduceat(of("text").is_valid().to_numpy(zero_copy_only=False), begin)
    *_, text = _joined(pa.RecordBatch.from_arrays([of("text"), pa.array(cut)], ["c", FIRST]), [])
    made["text"] = pa.StringArray.from_buffers(len(text), *text.buffers()[1:], pa.array(some).buffers()[1])
    # values of the first span that has a number
    known = of("span").is_valid().to_numpy(zero_copy_only=False)
    head = np.minimum.reduceat(np.where(known, np.arange(len(cut)), len(cut)), begin)
    head = pa.array(head, mask=head == len(cut))
    for name, least in (("x0", True), ("y0", True), ("x1", False), ("y1", False)):
        v, gaps = column(batch, name), of(name).null_count > 0
        made[name] = pa.array((np.fmin if least else np.fmax if gaps else np.maximum).reduceat(v, begin), from_pandas=gaps)
    return [*(of(k).take(pa.array(begin)) for k in LINE), made["run"], made["text"], *(of(c).take(head) for c in _STYLE),
            *(made[c] for c in ("n_spans", "x0", "y0", "x1", "y1"))]


def _run_starts(first, blank, exact, size, spacing):
    """Which spans open a run. Those equal to the visible span before them join whatever the run's first span is, those that
    differ in an `exact` code or by twice what is allowed open a run; only the others are compared with that span."""
    import numpy as np

    cut = first.copy()
    at = np.flatnonzero(first | ~blank)  # a run's first span and visible ones; other blanks always join
    before, now = at[:-1], at[1:]
    inside = ~first[now]
    before, now = before[inside], now[inside]
    alike = np.ones(len(now), bool)
    for code in exact:
        alike &= (code[before] == code[now]) & (code[now] >= 0)
    same = alike & (size[before] == size[now]) & (spacing[before] == spacing[now])
    with np.errstate(invalid="ignore"):
        near = alike & (np.abs(size[before] - size[now]) < 0.021) & (np.abs(spacing[before] - spacing[now]) < 0.21)
    cut[now[~near]] = True
    last = np.maximum.accumulate(np.where(cut, np.arange(len(cut)), 0))
    made = -1
    for i in now[near & ~same].tolist():
        head = max(last[i], made)
        if not (abs(size[head] - size[i]) < 0.01 and abs(spacing[head] - spacing[i]) < 0.1):
            cut[i], made = True, i
    return cut


def group_rows(pieces: DataFrame, block: list[str] | None = None) -> DataFrame:
    """Pieces on one height: join the row when they overlap its growing box by more than half the smaller height.

    A piece that starts below everything before it always opens a row, so only vertically chained
    pieces are taken together, and a chain whose pieces all share enough height is one row without a fold.
    """
    block = block or PAGE
    w = Window.partitionBy(*block).orderBy(F.col("y0") + F.col("y1"), "piece_no")
    below = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = pieces.withColumn("_below", below)
    chained = islands(cut, block, [F.col("y0") + F.col("y1"), F.col("piece_no")], F.col("_below").isNull() | (F.col("y0") >= F.col("_below")), "_chain")
    fields = [c for c in pieces.columns if c not in block]
    arr = chained.groupBy(*block, "_chain").agg(F.array_sort(F.collect_list(F.struct(
        (F.col("y0") + F.col("y1")).alias("_c"), F.col("piece_no").alias("_o"), F.col("y0").cast("double").alias("_y0"),
        F.col("y1").cast("double").alias("_y1"), F.struct(*fields).alias("f")))).alias("_a"),
        ((F.min(F.col("y1") - F.col("y0")) > 0) & (F.min("y1") - F.max("y0") > 0.5 * F.max(F.col("y1") - F.col("y0")))).alias("_one"))

    def step(acc, p):
        h = F.least(acc["y1"] - acc["y0"], p["_y1"] - p["_y0"])
        fits = (acc["n"] >= 0) & (h > 0) & (F.least(acc["y1"], p["_y1"]) - F.greatest(acc["y0"], p["_y0"]) > 0.5 * h)
        n = F.when(fits, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(fits, F.least(acc["y0"], p["_y0"])).otherwise(p["_y0"]).alias("y0"),
                        F.when(fits, F.greatest(acc["y1"], p["_y1"])).otherwise(p["_y1"]).alias("y1"),
                        n.alias("n"), F.array_append(acc["out"], n).alias("out"))

    zero = F.expr("named_struct('y0', 0D, 'y1', 0D, 'n', -1, 'out', cast(array() as array<int>))")
    folded = arr.withColumn("_r", F.when(F.col("_one"), F.array_repeat(F.lit(0), F.size("_a"))).otherwise(F.aggregate("_a", zero, step)["out"]))
    return folded.select(*block, F.inline(F.transform("_a", lambda s, i: F.struct(
        F.struct(F.col("_chain").alias("chain"), F.get(F.col("_r"), i).alias("n")).alias("row_key"), *[s["f"][f].alias(f) for f in fields]))))


def group_pieces(rows: DataFrame, block: list[str] | None = None) -> DataFrame:
    """Within a row, a new group starts at a gap of at least 0.6 of the largest size of the group and the piece.

    A gap that wide for the largest size of the whole row is a certain cut, a gap below 0.6 of a piece's own
    size a certain join; only stretches between certain cuts that also hold uncertain gaps are folded.
    """
    key = [*(block or PAGE), "row_key"]
    w = Window.partitionBy(*key).orderBy("x0", "piece_no")
    prior = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select("*", prior.alias("_right"), F.max("size").over(Window.partitionBy(*key)).alias("_big"))
    cut = F.col("_right").isNull() | (F.col("x0") - F.col("_right") >= 0.6 * F.greatest(F.col("_big"), F.lit(1)))
    sure = cut | (F.col("x0") - F.col("_right") < 0.6 * F.greatest(F.col("size"), F.lit(1)))
    chained = islands(marked.withColumn("_sure", sure), key, ["x0", "piece_no"], cut, "_chain")
    fields = [c for c in rows.columns if c not in key]
    arr = chained.groupBy(*key, "_chain").agg(F.array_sort(F.collect_list(F.struct(
        F.col("x0").cast("double").alias("_x0"), F.col("piece_no").alias("_o"), F.col("x1").cast("double").alias("_x1"),
        F.col("size").cast("double").alias("_s"), F.struct(*fields).alias("f")))).alias("_a"), F.bool_and("_sure").alias("_one"))

    def step(acc, p):
        fits = (acc["n"] >= 0) & (p["_x0"] - acc["right"] < 0.6 * F.greatest(acc["s"], p["_s"], F.lit(1.0)))
        n = F.when(fits, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(fits, F.greatest(acc["right"], p["_x1"])).otherwise(p["_x1"]).alias("right"),
                        F.when(fits, F.greatest(acc["s"], p["_s"])).otherwise(p["_s"]).alias("s"),
                        n.alias("n"), F.array_append(acc["out"], n).alias("out"))

    zero = F.expr("named_struct('right', 0D, 's', 0D, 'n', -1, 'out', cast(array() as array<int>))")
    folded = arr.withColumn("_r", F.when(F.col("_one"), F.array_repeat(F.lit(0), F.size("_a"))).otherwise(F.aggregate("_a", zero, step)["out"]))
    return folded.select(*key, F.inline(F.transform("_a", lambda s, i: F.struct(
        F.struct(F.col("_chain").alias("chain"), F.get(F.col("_r"), i).alias("n")).alias("group_key"), *[s["f"][f].alias(f) for f in fields]))))


def overprint_dedupe(chars: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Flag groups whose characters are drawn twice (`overprinted`) and blanks drawn twice (`keep` false).

    Blanks are compared with the last kept one, one pass over whole groups walks the runs of touching blanks.
    """
    by = ["_centre", *order]
    placed = also(chars, _centre=_centre)
    rest = [f for f in chars.schema if f.name not in key]
    schema = StructType([*(chars.schema[k] for k in key), StructField("keep", BooleanType()), *rest, StructField("overprinted", BooleanType())])
    if in_hand(chars, key):
        return behind(placed, key, partial(_overprints_in_hand, names=schema.names, white=_white(chars)), schema, by, stands=key)
    marked = placed.select("*", _drawn_twice(Window.partitionBy(*key).orderBy(*by)).alias("_twice"), _blank("c").alias("_blank"))
    return per_key(marked, key, by, partial(_overprints, names=schema.names), schema)


def _centre(r):
    return (r("x0") + r("x1")) / 2


def _overprints_in_hand(rows, names: list[str], white):
    blank = white[rows.codes("c")]
    return _overprints(rows.plus(_twice=_twice_drawn(rows, rows.filled(FIRST), blank), _blank=blank), names)


def _twice_drawn(rows, first, blank):
    """`_drawn_twice` for rows in order, FIRST of which open a group."""
    import numpy as np

    code, x0, x1 = rows.codes("c"), column(rows, "x0").astype(float), column(rows, "x1").astype(float)
    wide = np.minimum(x1 - x0, np.roll(x1 - x0, 1))
    shared = np.minimum(x1, np.roll(x1, 1)) - np.maximum(x0, np.roll(x0, 1))
    return ~first & (wide > 0) & (code == np.roll(code, 1)) & ~blank & (shared > 0.5 * wide)


def _overprints(batch, names: list[str]):
    """Columns of whole groups with `overprinted` and `keep`."""
    import numpy as np

    batch = Rows.of(batch)
    first = column(batch, FIRST).astype(bool)
    begin = np.flatnonzero(first)
    over = np.logical_or.reduceat(column(batch, "_twice").astype(bool), begin)[np.cumsum(first) - 1]
    keep = _kept_blanks(column(batch, "_blank").astype(bool), first, column(batch, "x0").astype(float), column(batch, "x1").astype(float))
    made = {"overprinted": over, "keep": keep}
    return Rows(batch.num_rows, {c: made[c] if c in made else partial(batch.raw, c) for c in names})


def merge_row_pieces(chars: DataFrame) -> DataFrame:
    """Rows, then groups, then one merged line per group, ordered by character position.

    Input characters carry `piece_no` (drawing order of their piece), `size` and `horizontal`. A group
    keeps the number of its earliest piece; overprinted groups and non-horizontal pieces stay apart.
    Pieces meet within their `block` of the page where there is such a column, so columns side by side stay apart.
    Output: `line` = number of the merged line, `ord` = place of the character in it.
    """
    kinds = {f.name: f.dataType for f in chars.schema} | {"ord": LongType(), "line": chars.schema["piece_no"].dataType}
    schema = StructType([StructField(c, kinds[c]) for c in [*[c for c in chars.columns if c != "line"], "line"]])
    if "block" not in chars.columns and in_hand(chars, PAGE):  # whole pages at once
        return behind(chars, PAGE, partial(_merged_pages, names=schema.names, white=_white(chars)), schema, ["piece_no"], stands=LINE)
    boxed = [F.min(F.when(F.col("horizontal"), F.col(c))).alias(c) for c in ("x0", "y0")]
    boxed += [F.max(F.when(F.col("horizontal"), F.col(c))).alias(c) for c in ("x1", "y1", "size")]
    if "block" in chars.columns:  # a piece may lie in several blocks
        block = [*PAGE, "block"]
        pieces = chars.filter("horizontal").groupBy(*block, "piece_no").agg(*boxed)
        joined = chars.join(_grouped(pieces, block).select(*PAGE, "piece_no", "_first", "_n").hint("shuffle_hash"), [*PAGE, "piece_no"], "left")
    else:  # a piece takes its characters along: they stay with their page, and nothing is joined. Upright pieces are blocks of their own
        inner = [c for c in chars.columns if c not in [*PAGE, "piece_no"]]
        pieces = chars.groupBy(*PAGE, "piece_no").agg(
            *boxed, F.collect_list(F.struct(*inner)).alias("_chars"), (~F.max(F.coalesce("horizontal", F.lit(False)))).alias("_upright"))
        alone = pieces.withColumn("_alone", F.when(F.col("_upright"), F.col("piece_no")))
        known = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("piece_no").isNotNull()
        joined = _grouped(alone, [*PAGE, "_upright", "_alone"]).select(
            *PAGE, "piece_no", F.when(known, F.col("_first")).alias("_first"), F.when(known, F.col("_n")).alias("_n"), F.inline("_chars"))
    joined = joined.withColumns({"_group": F.coalesce("_first", "piece_no"), "_centre": (F.col("x0") + F.col("x1")) / 2}).drop("_first")
    key, order = [*PAGE, "_group"], ["_centre", "piece_no", "ord"]
    marked = joined.withColumn("_twice", _drawn_twice(Window.partitionBy(*key).orderBy(*order))).withColumn("_blank", _blank("c"))
    return per_key(marked, key, order, partial(_merged_lines, names=[f.name for f in schema]), schema, stands=None if "block" in chars.columns else LINE)


def _grouped(pieces: DataFrame, block: list[str]) -> DataFrame:
    """`pieces` with the number of the earliest piece of their group and the number of its pieces."""
    w = Window.partitionBy(*block, "row_key", "group_key")
    return group_pieces(group_rows(pieces, block), block).select("*", F.min("piece_no").over(w).alias("_first"), F.count("*").over(w).alias("_n"))


def _drawn_twice(w) -> Column:
    """Whether a character covers more than half of an equal one before it."""
    pc, px0, px1 = (F.lag(c).over(w) for c in ("c", "x0", "x1"))
    width = F.least(F.col("x1") - F.col("x0"), px1 - px0)
    return F.coalesce((width > 0) & (pc == F.col("c")) & ~_blank("c") & (F.least(F.col("x1"), px1) - F.greatest(F.col("x0"), px0) > 0.5 * width), F.lit(False))


def _kept_blanks(blank, first, x0, x1):
    """Which rows stay when blanks are compared with the last blank that stayed. Only runs of touching blanks are walked."""
    import numpy as np
    keep = np.ones(len(blank), bool)
    behind = np.flatnonzero(blank[1:] & blank[:-1] & ~first[1:]) + 1
    last = -2
    for i in behind.tolist():
        if last != i - 1:
            a0, a1 = x0[i - 1], x1[i - 1]
        last = i
        wide = max(a1 - a0, x1[i] - x0[i], 0.1)
        if min(a1, x1[i]) - max(a0, x0[i]) > 0.3 * wide:
            keep[i] = False
        else:
            a0, a1 = x0[i], x1[i]
    return keep


def _merged_lines(batch, names: list[str]):
    """Columns of whole groups as merged lines: `line`, and `ord` counted anew."""
    import numpy as np

    batch = Rows.of(batch)
    first = column(batch, FIRST).astype(bool)
    begin = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    n = column(batch, "_n").astype(float)
    apart = (np.logical_or.reduceat(column(batch, "_twice").astype(bool), begin) | ~(n[begin] > 1))[group]  # stays as drawn
    piece, place = column(batch, "piece_no"), column(batch, "ord")
    stay = apart | _kept_blanks(column(batch, "_blank").astype(bool), first, column(batch, "x0").astype(float), column(batch, "x1").astype(float))
    rows = np.flatnonzero(stay)
    at = np.arange(batch.num_rows)
    by = np.where(apart, place, at)[rows], np.where(apart, piece, 0)[rows], group[rows]
    if not _sorted(by[::-1]):
        rows = rows[np.lexsort(by)]
    line = np.where(apart, piece, column(batch, "_group"))[rows]
    new = np.concatenate([[True], (group[rows][1:] != group[rows][:-1]) | (line[1:] != line[:-1])]) if len(rows) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    out = batch.take(rows) if len(rows) < batch.num_rows or (np.diff(rows) < 0).any() else batch
    made = {"line": line, "ord": np.arange(len(rows)) - start + 1}
    return Rows(len(rows), {c: made[c] if c in made else partial(out.raw, c) for c in names})


def _sorted(by) -> bool:
    """Whether places stand in order by these arrays, the first one first."""
    import numpy as np

    tie = np.ones(max(len(by[0]) - 1, 0), bool)
    for v in by:
        if (tie & ~(v[1:] >= v[:-1])).any():
            return False
        tie &= v[1:] == v[:-1]
    return True


def _merged_pages(rows, names: list[str], white):
    """Merged lines of the characters of whole pages, which stand by piece: pieces become rows and groups as arrays."""
    import numpy as np

    page, piece = np.cumsum(rows.filled(FIRST)) - 1, rows.filled("piece_no")
    opens = np.append(True, (page[1:] != page[:-1]) | (piece[1:] != piece[:-1]))
    begin = np.flatnonzero(opens)
    flat = rows.filled("horizontal", False).astype(bool)
    x0, x1, y0, y1, size = (column(rows, c).astype(float) for c in ("x0", "x1", "y0", "y1", "size"))
    box = [np.fmin.reduceat(np.where(flat, v, np.nan), begin) for v in (x0, y0)] + [np.fmax.reduceat(np.where(flat, v, np.nan), begin) for v in (x1, y1, size)]
    known = np.ones(len(begin), bool)
    for k in [*PAGE, "piece_no"]:
        if (null := rows.null(k)) is not None:
            known &= ~null[begin]
    group, n = piece[begin].copy(), np.where(known, 1, 0)
    level = np.flatnonzero(known & np.logical_or.reduceat(flat, begin))  # upright pieces stay by themselves
    if len(level):
        group[level], n[level] = _groups_of_pieces(page[begin][level], group[level], *(v[level] for v in box))
    of = np.cumsum(opens) - 1
    made = {"_page": page, "_group": group[of], "_n": n[of], "_centre": (x0 + x1) / 2, "_place": rows.filled("ord")}
    by = [made[c] for c in ("_page", "_group", "_centre")] + [piece, made["_place"]]
    rows = rows.plus(**made)
    if not _sorted(by):
        at = np.lexsort(by[::-1])
        rows, by = rows.take(at), [v[at] for v in by]
    first = np.append(True, (by[0][1:] != by[0][:-1]) | (by[1][1:] != by[1][:-1]))
    blank = white[rows.codes("c")]
    return _merged_lines(rows.plus(**{FIRST: first, "_twice": _twice_drawn(rows, first, blank), "_blank": blank}), names)


def _groups_of_pieces(page, piece, x0, y0, x1, y1, size):
    """(number of the earliest piece of its group, number of its pieces) for every piece: `group_rows` and `group_pieces` on arrays."""
    import numpy as np

    at = np.lexsort((piece, y0 + y1, page))
    p, top, low = page[at], y0[at], y1[at]
    chain, begin = _chains(p, low, lambda below: top >= below)
    tall = low - top
    least, most = np.minimum.reduceat(tall, begin), np.maximum.reduceat(tall, begin)
    one = (least > 0) & (np.minimum.reduceat(low, begin) - np.maximum.reduceat(top, begin) > 0.5 * most)
    row = np.zeros(len(at), np.int64)
    for i, j in _open_stretches(begin, len(at), one):
        row[i:j] = _fold_rows(top[i:j].tolist(), low[i:j].tolist())
    of = np.cumsum(np.append(True, (chain[1:] != chain[:-1]) | (row[1:] != row[:-1]))) - 1
    inner = np.lexsort((piece[at], x0[at], of))
    at, of = at[inner], of[inner]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    count = np.diff(np.append(head, len(at)))
    left, right, tall = x0[at], x1[at], np.fmax(size[at], 1)
    big = np.repeat(np.fmax.reduceat(tall, head), count)
    sure = np.ones(len(at), bool)

    def cut(before):
        wide = left - before >= 0.6 * big
        sure[:] = np.isnan(before) | wide | (left - before < 0.6 * tall)
        return wide
    chain, begin = _chains(of, right, cut)
    n = np.zeros(len(at), np.int64)
    for i, j in _open_stretches(begin, len(at), np.logical_and.reduceat(sure, begin)):
        n[i:j] = _fold_groups(left[i:j].tolist(), right[i:j].tolist(), tall[i:j].tolist())
    begin = np.flatnonzero(np.append(True, (chain[1:] != chain[:-1]) | (n[1:] != n[:-1])))
    count = np.diff(np.append(begin, len(at)))
    first, several = np.empty(len(at), piece.dtype), np.empty(len(at), np.int64)
    first[at] = np.repeat(np.minimum.reduceat(piece[at], begin), count)
    several[at] = np.repeat(count, count)
    return first, several


def _chains(key, end, cut):
    """(chain of every place, where chains begin) for places that stand by `key`: a key opens one, and so does a place for which `cut`
    holds, given the largest `end` of its key before it (NaN if there is none)."""
    import numpy as np

    value, rank = np.unique(end, return_inverse=True)
    new = np.append(True, key[1:] != key[:-1])
    base = (np.cumsum(new) - 1) * (len(value) + 1)
    most = np.maximum.accumulate(base + rank.reshape(-1))
    before = np.append(np.nan, value[most[:-1] - base[:-1]])
    before[new] = np.nan
    opens = new | cut(before)
    return np.cumsum(opens), np.flatnonzero(opens)


def _open_stretches(begin, n: int, settled):
    """(begin, end) of the chains of several places that are not settled as one."""
    import numpy as np

    end = np.append(begin[1:], n)
    some = ~settled & (end - begin > 1)
    return zip(begin[some].tolist(), end[some].tolist())


def _fold_rows(top: list[float], low: list[float]) -> list[int]:
    out, n, a, b = [], -1, 0.0, 0.0
    for t, w in zip(top, low):
        h = min(b - a, w - t)
        if n >= 0 and h > 0 and min(b, w) - max(a, t) > 0.5 * h:
            a, b = min(a, t), max(b, w)
        else:
            n, a, b = n + 1, t, w
        out.append(n)
    return out


def _fold_groups(left: list[float], right: list[float], size: list[float]) -> list[int]:
    out, n, end, big = [], -1, 0.0, 0.0
    for x, r, s in zip(left, right, size):
        if n >= 0 and x - end < 0.6 * max(big, s):
            end, big = max(end, r), max(big, s)
        else:
            n, end, big = n + 1, r, s
        out.append(n)
    return out


def _real_space(w) -> Column:
    return F.max((F.col("c") == " ") & ~F.col("syn")).over(w)


def infer_word_spaces(chars: DataFrame, script: str = HANGUL) -> DataFrame:
    """Insert blanks into lines of a script that are spaced by position only.

    Gaps beside the script's letters, in units of the font size, are split in two by 2-means (at most
    20 rounds); a blank goes where the gap belongs to the wider kind. Lines with a real blank, too few
    gaps or evenly spread gaps stay as they are. One window finds the gaps, one pass over whole lines puts the blanks in.
    """
    if in_hand(chars, LINE):
        work = partial(_spaced_lines, names=chars.columns, letter=matching(chars.sparkSession, f"^{script}"),
                       script=matching(chars.sparkSession, script), white=_white(chars))
        return behind(chars, LINE, work, chars.schema, ["ord"], stands=LINE)
    w = Window.partitionBy(*LINE).orderBy("ord")
    nc, nx0, nsize = F.lead("c").over(w), F.lead("x0").over(w), F.lead("size").over(w)
    letter = F.col("c").rlike(f"^{script}") | nc.rlike(f"^{script}")
    size = F.coalesce(F.nullif(F.greatest("size", nsize).cast("double"), F.lit(0.0)), F.lit(1.0))
    gap = F.when(~_blank("c") & ~_blank(nc) & letter, (nx0 - F.col("x1")) / size)
    width = gap * F.coalesce(F.nullif(F.col("size").cast("double"), F.lit(0.0)), F.lit(1.0))
    marked = chars.select("*", gap.alias("_gap"), ((F.col("c") == " ") & ~F.col("syn")).alias("_real"), F.col("c").rlike(script).alias("_script"),
                          (F.col("x1") + width).cast(chars.schema["x1"].dataType).alias("_x1"))
    return per_key(marked, LINE, ["ord"], partial(_put_blanks, names=chars.columns), chars.schema, stands=LINE)


def _put_blanks(batch, names: list[str]):
    """Columns of whole lines with the blanks put in; `ord` doubled to make room."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    batch = Rows.of(batch)
    begin, gap = np.flatnonzero(column(batch, FIRST)), column(batch, "_gap").astype(float)
    n = np.diff(np.append(begin, batch.num_rows))
    some = lambda name: np.logical_or.reduceat(column(batch, name).astype(bool), begin)
    line = np.repeat(np.arange(len(begin)), n)
    put = np.zeros(batch.num_rows, bool)
    at = np.flatnonzero(((n >= 3) & ~some("_real") & some("_script"))[line] & ~np.isnan(gap))
    if len(at):
        order = at[np.lexsort((gap[at], line[at]))]
        v, of = gap[order], line[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        last = np.append(first[1:], len(of)) - 1
        wide = (last > first) & (v[last] - v[first] >= 0.15)
        inside = np.repeat(wide, last - first + 1)
        v, of = v[inside], of[inside]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        c1, c2 = two_means(v, first)
        limit = np.full(len(begin), np.inf)
        limit[of[first]] = np.where(c2 - c1 >= 0.15, np.maximum((c1 + c2) / 2, c1 + 0.1), np.inf)
        put[at] = gap[at] > limit[line[at]]
    rows = np.repeat(np.arange(batch.num_rows), 1 + put)
    new = np.concatenate([[False], rows[1:] == rows[:-1]]) if len(rows) else np.zeros(0, bool)
    if not put.any():
        return Rows(batch.num_rows, {name: partial(batch.raw, name) for name in names} | {"ord": lambda: pc.multiply(batch.arrow("ord"), 2)})
    out, mask = batch.take(rows), pa.array(new)
    old = out.arrow
    by = {"c": lambda: pc.if_else(mask, " ", old("c")), "x0": lambda: pc.if_else(mask, old("x1").cast(old("x0").type), old("x0")),
          "x1": lambda: pc.if_else(mask, old("_x1"), old("x1")), "syn": lambda: pc.if_else(mask, True, old("syn")),
          "ord": lambda: pc.add(pc.multiply(old("ord"), 2), mask.cast(old("ord").type))}
    return Rows(len(rows), {name: by[name] if name in by else partial(out.raw, name) for name in names})


def _spaced_lines(rows, names: list[str], letter, script, white):
    """Whole lines with the blanks put in; gaps are found on arrays."""
    import numpy as np
    import pyarrow as pa

    code, first = rows.codes("c"), rows.filled(FIRST)
    ends = np.append(first[1:], True)
    x0, x1, size = (column(rows, c).astype(float) for c in ("x0", "x1", "size"))
    inked, beside = ~white[code], letter[code]
    tall = np.fmax(size, np.roll(size, -1))
    gap = (np.roll(x0, -1) - x1) / _or_one(tall)
    gap[ends | ~inked | ~np.roll(inked, -1) | ~(beside | np.roll(beside, -1))] = np.nan

    def new_x1():
        x = x1 + gap * _or_one(size)
        return _as_kind(x, rows.arrow("x1").type)
    return _put_blanks(rows.plus(_gap=gap, _real=(code == 32) & ~rows.filled("syn", True), _script=script[code], _x1=new_x1), names)


def _or_one(size):
    """Sizes, one for zero and unknown ones."""
    import numpy as np

    return np.where((size == 0) | np.isnan(size), 1.0, size)


def _as_kind(x, kind):
    """Numbers as a cast of columns gives them: whole ones are cut off, unknown ones null."""
    import numpy as np
    import pyarrow as pa

    gap = np.isnan(x)
    return pa.array(np.trunc(np.where(gap, 0, x)) if pa.types.is_integer(kind) else x, mask=gap).cast(kind)


def drop_autospace(chars: DataFrame, wide: str = CJK, narrow: str = ALNUM) -> DataFrame:
    """Drop narrow inferred blanks between wide-script letters and ASCII alphanumerics where real blanks exist."""
    if in_hand(chars, LINE):
        work = partial(_dropped, names=chars.columns, rule=partial(_autospaces, wide=_starting(chars, wide), narrow=_starting(chars, narrow)), white=_white(chars))
        return behind(chars, LINE, work, chars.schema, ["ord"], stands=LINE)
    line, w = Window.partitionBy(*LINE), Window.partitionBy(*LINE).orderBy("ord")
    a, b = F.lag("c").over(w), F.lead("c").over(w)
    ax1, bx0 = F.lag("x1").over(w), F.lead("x0").over(w)
    size = F.coalesce(F.nullif(F.col("size").cast("double"), F.lit(0.0)), F.lit(1.0))

    def is_(c, cls):
        return c.rlike(f"^{cls}")
    pair = F.when(is_(a, wide), is_(b, narrow)).otherwise(is_(b, wide) & is_(a, narrow))
    drop = (_real_space(line) & F.col("syn") & (F.col("c") == " ") & ~_blank(a) & ~_blank(b) & ((bx0 - ax1) / size < 0.6) & pair)
    return chars.withColumn("_d", F.coalesce(drop, F.lit(False))).filter(~F.col("_d")).drop("_d")


def _starting(df: DataFrame, script: str):
    return matching(df.sparkSession, f"^{script}")


def _dropped(rows, names: list[str], rule, white):
    """Whole lines without the inferred blanks between inked characters that `rule` finds."""
    import numpy as np

    code, first = rows.codes("c"), rows.filled(FIRST)
    at = np.flatnonzero((code == 32) & rows.filled("syn", False) & ~first & ~np.append(first[1:], True))
    at = at[~white[code[at - 1]] & ~white[code[at + 1]]]
    gap = (column(rows, "x0")[at + 1] - column(rows, "x1")[at - 1]) / _or_one(column(rows, "size")[at].astype(float))
    keep = np.ones(rows.num_rows, bool)
    keep[at[rule(rows, at, gap, code, first, white)]] = False
    out = rows if keep.all() else rows.take(np.flatnonzero(keep))
    return Rows(out.num_rows, {name: partial(out.raw, name) for name in names})


def _autospaces(rows, at, gap, code, first, white, wide, narrow):
    import numpy as np

    real = np.logical_or.reduceat((code == 32) & ~rows.filled("syn", True), np.flatnonzero(first))[(np.cumsum(first) - 1)[at]]
    a, b = code[at - 1], code[at + 1]
    return real & (gap < 0.6) & np.where(wide[a], narrow[b], wide[b] & narrow[a])


def _dot_spaces(rows, at, gap, code, first, white, dots: str):
    import numpy as np

    marks = np.array([ord(c) for c in dots], np.uint32)
    inked = ~white[code]
    line = np.cumsum(first)
    two = np.clip(at - 2, 0, None), np.clip(at + 2, None, len(code) - 1)
    aa, bb = ((line[i] == line[at]) & (np.abs(i - at) == 2) & inked[i] for i in two)
    return (gap < 1.0) & np.where(np.isin(code[at - 1], marks), aa, np.isin(code[at + 1], marks) & bb)


def drop_dot_spaces(chars: DataFrame, dots: str = R.MIDDLE_DOTS) -> DataFrame:
    """Drop inferred blanks beside a middle dot that stands between words."""
    if in_hand(chars, LINE):
        work = partial(_dropped, names=chars.columns, rule=partial(_dot_spaces, dots=dots), white=_white(chars))
        return behind(chars, LINE, work, chars.schema, ["ord"], stands=LINE)
    w = Window.partitionBy(*LINE).orderBy("ord")
    a, b, aa, bb = F.lag("c").over(w), F.lead("c").over(w), F.lag("c", 2).over(w), F.lead("c", 2).over(w)
    size = F.coalesce(F.nullif(F.col("size").cast("double"), F.lit(0.0)), F.lit(1.0))
    near = (F.lead("x0").over(w) - F.lag("x1").over(w)) / size < 1.0

    def dot(c):
        return F.contains(F.lit(dots), c)
    word = F.when(dot(a), F.coalesce(~_blank(aa), F.lit(False))).when(dot(b), F.coalesce(~_blank(bb), F.lit(False))).otherwise(F.lit(False))
    drop = F.col("syn") & (F.col("c") == " ") & ~_blank(a) & ~_blank(b) & word & near
    return chars.withColumn("_d", F.coalesce(drop, F.lit(False))).filter(~F.col("_d")).drop("_d")


def _with_spacing_parts(chars: DataFrame) -> DataFrame:
    """Add the letter gap `_g` to the next visible character of the span and the visible width `_w`."""
    w = Window.partitionBy(*LINE, "span").orderBy("ord")
    nxt, nox = F.lead("c").over(w), F.lead("origin_x").over(w)
    width = (F.col("x1") - F.col("x0")).cast("double")
    gap = nox - F.col("origin_x") - width
    gap = F.when(~_blank("c") & ~_blank(nxt) & (F.abs(gap) <= 0.5 * F.col("size")), gap)
    return chars.select("*", gap.alias("_g"), F.when(~_blank("c"), width).alias("_w"))


def _spacing() -> Column:
    """Aggregate over a span: its letter spacing from the parts above."""
    mean, n = F.avg("_g"), F.count("_g")
    raw = mean * n / (n + 1) - 0.02 * F.avg("_w")
    spacing = F.when(mean > 0, F.greatest(F.lit(0.0), raw)).otherwise(raw)
    return (F.when(F.coalesce(F.abs(mean), F.lit(0.0)) < 0.15, F.lit(0.0)).when(F.abs(spacing) >= 0.1, half_even(spacing, 2))
            .otherwise(F.lit(0.0)))


def char_spacing(chars: DataFrame) -> DataFrame:
    """Letter spacing of every span that has visible characters, in points (0 when negligible)."""
    return _with_spacing_parts(chars).groupBy(*LINE, "span").agg(_spacing().alias("spacing"))


def drop_margin_stamps(lines: DataFrame) -> DataFrame:
    """Drop tall vertical lines wholly outside the x-range of the page's horizontal text."""
    w = Window.partitionBy(*PAGE)
    h = F.col("horizontal")
    lo, hi = F.min(F.when(h, F.col("x0"))).over(w), F.max(F.when(h, F.col("x1"))).over(w)
    outside = (F.col("x1") <= lo + 1) | (F.col("x0") >= hi - 1)
    drop = ~h & outside & (F.col("y1") - F.col("y0") > 3 * (F.col("x1") - F.col("x0")))
    return lines.withColumn("_d", F.coalesce(drop, F.lit(False))).filter(~F.col("_d")).drop("_d")


def tidy_text(chars: DataFrame, script: str = HANGUL, wide: str = CJK, dots: str = R.MIDDLE_DOTS, cut: bool = False) -> DataFrame:
    """The whole cleanup in order, ending in merged runs. Needs char_flags, mark, piece_no, horizontal, origin_x.

    Every step reads the one before it once. `cut` checkpoints the merged lines (in the session's checkpoint folder) for
    callers that want the chain parted there; the characters of all lines are then written out.
    """
    more = {} if "alpha" in chars.columns else {"alpha": lambda r: 255}
    prepared = also(chars, ("char_flags", "mark"), c=_plain_bullets, syn=_synthetic, **more)
    c = merge_row_pieces(prepared)
    if cut:
        ensure_checkpoint_dir(c.sparkSession)
        c = c.checkpoint()
    c = drop_dot_spaces(infer_word_spaces(drop_autospace(c, wide), script), dots)
    fields = ["font", "size", "flags", "color", "alpha"]
    if in_hand(c, LINE):
        kinds = c.schema
        schema = StructType([*(kinds[k] for k in LINE), StructField("span", LongType()), StructField("text", StringType()), *(kinds[k] for k in fields),
                             *(kinds[k] for k in ("x0", "y0", "x1", "y1")), StructField("spacing", DoubleType())])
        return merge_runs(behind(c, LINE, partial(_spans_in_hand, names=schema.names, white=_white(chars)), schema, ["ord"], stands=LINE))
    # a span is a stretch of one source span; merging may interleave pieces, so stretches are renumbered
    w = Window.partitionBy(*LINE).orderBy("ord")
    turn = (F.lag("span").over(w) != F.col("span")) | (F.lag("piece_no").over(w) != F.col("piece_no"))
    c = islands(c.withColumn("_turn", F.coalesce(turn, F.lit(False))), LINE, ["ord"], F.col("_turn"), "_stretch")
    c = _with_spacing_parts(c.drop("span", "_turn").withColumnRenamed("_stretch", "span"))
    spans = c.groupBy(*LINE, "span").agg(
        ordered_concat("c", "ord").alias("text"), *[F.min_by(f, "ord").alias(f) for f in fields],
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), _spacing().alias("spacing"))
    return merge_runs(spans)


def _plain_bullets(r):
    c = r("c")
    return normalize_bullets(c) if isinstance(c, Column) else _translated(c)


def _translated(c):
    """`normalize_bullets` of an array of characters."""
    import numpy as np

    code = c.view(np.uint32).copy()
    for old, new in R.PRIVATE_BULLETS.items():
        code[code == ord(old)] = ord(new)
    return code.view("<U1")


def _synthetic(r):
    flags = r("char_flags")
    return synthetic_flag(flags, r("mark")) if isinstance(flags, Column) else ((flags & R.SYNTHETIC_BITS) != 0) | r("mark", False)


def _spans_in_hand(rows, names: list[str], white):
    """Spans of whole lines that stand by `ord`, renumbered, with their text, box and letter spacing."""
    import numpy as np
    import pyarrow as pa

    first, span, piece, code = rows.filled(FIRST), rows.filled("span"), rows.filled("piece_no"), rows.codes("c")
    opens = first | np.append(True, (span[1:] != span[:-1]) | (piece[1:] != piece[:-1]))
    begin, n = np.flatnonzero(opens), np.cumsum(opens)
    x0, x1, origin, size = (column(rows, c).astype(float) for c in ("x0", "x1", "origin_x", "size"))
    inked, width = ~white[code], x1 - x0
    gap = np.roll(origin, -1) - origin - width
    ok = inked & np.roll(inked, -1) & ~np.append(opens[1:], True) & (np.abs(gap) <= 0.5 * size)
    wide = inked & ~np.isnan(width)
    head = rows.take(begin)
    made = {k: partial(head.raw, k) for k in (*LINE, *_STYLE[:-1])}
    made["span"] = (n - n[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))])[begin]
    made["text"] = _joined(Rows(rows.num_rows, {"c": rows.arrow("c"), FIRST: opens}), [])[0]
    for c, least in (("x0", True), ("y0", True), ("x1", False), ("y1", False)):
        v = column(rows, c)
        made[c] = pa.array((np.fmin if least else np.fmax).reduceat(v, begin), from_pandas=True)
    made["spacing"] = _spacing_of(*(np.add.reduceat(np.where(k, v, 0), begin) for k, v in ((ok, gap), (ok, 1.0), (wide, width), (wide, 1.0))))
    return Rows(len(begin), {c: made[c] for c in names})


def _spacing_of(gap, n, width, m):
    """`_spacing` from the sums and numbers of gaps and widths."""
    import numpy as np
    from decimal import ROUND_HALF_EVEN, Decimal

    with np.errstate(invalid="ignore", divide="ignore"):
        mean = gap / n
        raw = mean * n / (n + 1) - 0.02 * (width / m)
    raw = np.where(mean > 0, np.maximum(raw, 0.0), raw)
    out = np.zeros(len(raw))
    some = np.flatnonzero((np.abs(mean) >= 0.15) & (np.abs(raw) >= 0.1))
    values, at = np.unique(raw[some], return_inverse=True)
    rounded = [float(Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for v in values.tolist()]
    out[some] = np.array(rounded)[at.reshape(-1)] if len(some) else 0
    return out


def restore_spaces(glyphs: DataFrame, runs: DataFrame) -> DataFrame:
    """Give back blanks that a renderer only left as gaps.

    `runs` (doc_id, page, run_no, text, x, y, h, char_x ARRAY) hold the text with blanks; `glyphs`
    (doc_id, page, glyph_no, c, x, y) the drawn characters. A blank goes behind the glyph drawn within
    0.8 of its predecessor; a leading blank behind the nearest glyph to the left. Glyphs and spots of one height
    are sorted together by x, and one pass over a page finds the glyph before or behind every spot. Runs meet the heights of
    their page by the page alone, so that runs and glyphs that stand by page are not exchanged.
    """
    chars = runs.select(*PAGE, "x", "y", "h", F.split("text", "").alias("_cs"), "char_x")
    blank = (F.col("_c") == " ") & ((F.col("_i") == 0) | (F.get(F.col("_cs"), F.col("_i") - 1) != " "))
    # the heights at which a page has glyphs: a run's spots take part in every row they can reach
    g = glyphs.withColumns({"_row": F.col("y").cast("double"), "_at": F.col("x").cast("double")})
    heights = g.select(*PAGE, "_row").distinct().groupBy(*PAGE).agg(F.collect_set("_row").alias("_rows"))
    low, high = (F.col("y") - 1).cast("double"), (F.col("y") + F.col("h") * 1.6 + 1).cast("double")
    reached = (chars.filter(F.size("char_x") >= F.size("_cs")).withColumns({"_low": low, "_high": high}).join(heights, PAGE)
               .withColumn("_rows", F.filter("_rows", lambda r: r.between(F.col("_low"), F.col("_high")))))
    spots = reached.filter(F.size("_rows") > 0).select(*PAGE, "x", "h", "char_x", "_low", "_high", "_rows", "_cs", F.posexplode("_cs").alias("_i", "_c")).filter(blank)
    lead = F.col("_i") == 0
    spots = spots.select(*PAGE, "_low", "_high", F.explode("_rows").alias("_row"), lead.alias("_lead"),
                         (F.col("x") + F.get("char_x", F.greatest(F.col("_i") - 1, F.lit(0)))).cast("double").alias("_sx"),
                         (2 * F.coalesce(F.nullif(F.col("h").cast("double"), F.lit(0.0)), F.lit(10.0))).alias("_reach"))
    # at one place: leading blanks stand before the glyphs, the others behind them
    spots = spots.select(*PAGE, "_low", "_high", "_row", F.when(F.col("_lead"), F.col("_sx") - 0.5).otherwise(F.col("_sx") - 0.81).alias("_at"),
                         F.when(F.col("_lead"), 0).otherwise(2).alias("_kind"), F.col("_sx"), F.col("_reach"))
    if (met := meeting(glyphs, spots, partial(_spots_met, names=glyphs.columns), glyphs.schema)) is not None:
        return met
    both = g.withColumn("_kind", F.lit(1)).unionByName(spots, allowMissingColumns=True)
    return per_key(both, PAGE, ["_row", "_at", "_kind", "glyph_no"], partial(_with_spaces, names=glyphs.columns), glyphs.schema, stands=PAGE)


def _spots_met(rows, spots, names: list[str]):
    """The glyphs of whole pages that a pass has in hand, with the blanks of the spots on these pages."""
    import numpy as np

    n, m = rows.num_rows, spots.num_rows

    def joined(mine, theirs):
        return np.concatenate([mine, theirs])
    number = rows.filled("glyph_no")
    made = {"_row": joined(column(rows, "y").astype(float), column(spots, "_row")), "_at": joined(column(rows, "x").astype(float), column(spots, "_at")),
            "_kind": joined(np.ones(n, np.int64), column(spots, "_kind")), "glyph_no": joined(number, np.zeros(m, number.dtype))}
    made |= {c: joined(np.full(n, np.nan), column(spots, c)) for c in ("_low", "_high", "_sx", "_reach")}
    page = [joined(ranked(rows, k), ranked(spots, k)) for k in PAGE]
    by = [*page, *(np.where(np.isnan(made[c]), -np.inf, made[c]) for c in ("_row", "_at")), made["_kind"], made["glyph_no"]]
    at = np.lexsort(by[::-1])
    first = np.append(True, np.logical_or.reduce([v[at][1:] != v[at][:-1] for v in page]))
    glyph = rows.take(np.where(at < n, at, 0))
    whole = {c: partial(glyph.raw, c) for c in names} | {c: v[at] for c, v in made.items()}
    return _with_spaces(Rows(n + m, whole | {FIRST: first}), names)


def _with_spaces(batch, names: list[str]):
    """The glyphs of whole pages, with a blank behind those that a spot points at."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    batch = Rows.of(batch)
    n = batch.num_rows
    first, row, kind, at = column(batch, FIRST).astype(bool), column(batch, "_row"), column(batch, "_kind"), column(batch, "_at")
    page = np.cumsum(first)
    opens = np.concatenate([[True], first[1:] | (row[1:] != row[:-1])]) if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    of_row = np.cumsum(opens)
    glyph = kind == 1
    before = np.maximum.accumulate(np.where(glyph, np.arange(n), -1))  # the last glyph up to here, the first one from here on
    behind = np.minimum.accumulate(np.where(glyph, np.arange(n), n)[::-1])[::-1]
    spot = np.flatnonzero(~glyph)
    lead = kind[spot] == 0
    found = np.where(lead, before[spot], behind[spot])
    there = np.where(lead, found >= begin[spot], found < n)
    found = np.clip(found, 0, max(n - 1, 0))
    sx, reach = column(batch, "_sx")[spot], column(batch, "_reach")[spot]
    behind = np.append(behind, n)
    while (far := np.flatnonzero(there & ~lead & (of_row[found] == of_row[spot]) & (sx - at[found] >= 0.8))).size:  # the next one, for as long as it is a hair too far
        step = behind[found[far] + 1]
        there[far] = step < n
        found[far] = np.minimum(step, n - 1)
    there &= (of_row[found] == of_row[spot]) & np.where(lead, at[found] > sx - reach, at[found] - sx < 0.8) if len(spot) else there
    spot, found, lead, sx, reach = (x[there] for x in (spot, found, lead, sx, reach))
    # a spot that reaches several rows takes the outermost glyph of all of them
    side = np.where(lead, -1.0, 1.0)
    low, high = column(batch, "_low")[spot], column(batch, "_high")[spot]
    number = batch.filled("glyph_no")
    order = np.lexsort((np.where(lead, -number[found], number[found]), at[found] * side, lead, reach, sx, high, low, page[spot]))
    same = np.zeros(len(order), bool)
    if len(order):
        ids = np.stack([page[spot], low, high, sx, reach, lead])[:, order]
        same[1:] = (ids[:, 1:] == ids[:, :-1]).all(0)
    hit = np.zeros(n, bool)
    hit[found[order][~same]] = True

    rows = np.flatnonzero(glyph)
    out = batch.take(rows) if len(rows) < batch.num_rows else batch
    c = out.arrow("c")
    put = pc.and_(pa.array(hit[rows]), pc.invert(pc.fill_null(pc.ends_with(c, " "), True)))
    c = pc.if_else(put, pc.binary_join_element_wise(c, " ", ""), c)
    return Rows(len(rows), {name: c if name == "c" else partial(out.raw, name) for name in names})


def match_marks_to_boxes(circles: DataFrame, marks: DataFrame) -> DataFrame:
    """Pair hidden dot glyphs with the small circles drawn for them: in mark order, first unused circle.

    Candidates are found per cell of the page; only those pairs (a few dots) are walked in order.
    """
    cell = 32.0
    c = circles.filter(F.col("r") <= 2.5).select(*PAGE, "circle_no", "cx", "cy", F.floor(F.col("cx") / cell).alias("_i"))
    m = marks.filter(F.col("text").rlike("^[·∙・•]$")).select(
        *PAGE, "mark_no", "x", "y", "size", F.explode(F.sequence(F.floor((F.col("x") - 1) / cell), F.floor((F.col("x") + F.col("size")) / cell))).alias("_i"))
    pairs = m.join(c, [*PAGE, "_i"]).filter(
        (F.col("cx") >= F.col("x") - 1) & (F.col("cx") <= F.col("x") + F.col("size"))
        & (F.col("cy") <= F.col("y") + 1) & (F.col("cy") >= F.col("y") - F.col("size")))
    per_page = pairs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("mark_no", "circle_no"))).alias("_p"))

    def step(acc, p):
        free = ~F.exists(acc, lambda q: (q["mark_no"] == p["mark_no"]) | (q["circle_no"] == p["circle_no"]))
        return F.when(free, F.array_append(acc, p)).otherwise(acc)

    kept = F.aggregate("_p", F.slice("_p", 1, 0), step)
    return per_page.select(*PAGE, F.inline(kept))


def good_font_name(name: Column) -> Column:
    allowed = "[\\x20-\\x7e" + CJK[1:]
    return F.coalesce(name.rlike(f"^{allowed}+\\z") & (trim_ws(name) != ""), F.lit(False))


def chosen_font_name(original: Column, embedded: Column) -> Column:
    return F.when(good_font_name(embedded), embedded).otherwise(original)


_ENTITY = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&(?i:lt|gt|amp|quot|apos|nbsp);"


def decode_entities(text: Column) -> Column:
    """Decode numeric and the six named entities in one pass (a decoded text is not decoded again)."""
    def char_of(cp):
        return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")

    def decode(e):
        body = F.lower(F.regexp_replace(e, "[&#;]", ""))
        cp = (F.when(e.rlike("^&#[xX]"), F.conv(F.substring(body, 2, 8), 16, 10)).when(e.startswith("&#"), body)).cast("long")
        named = F.when(body == "lt", F.lit("<"))
        for k, v in R.ENTITIES.items():
            named = named.when(body == k, F.lit(v))
        valid = (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
        return F.when(cp.isNull(), named).when(valid, char_of(cp)).otherwise(e)

    parts = F.split(text, _ENTITY)
    ents = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    joined = F.array_join(F.zip_with(parts, ents, lambda p, e: F.concat(p, F.coalesce(decode(e), F.lit("")))), "")
    return F.when(text.rlike(_ENTITY), joined).otherwise(text)


def normalize_text(text: Column) -> Column:
    out = F.regexp_replace(decode_entities(text), r"\p{Zs}", " ")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    return trim_ws(F.regexp_replace(out, "\n{3,}", "\n\n"))
