"""Input views derived from the driver tables by integer formulas (whole tables, whole texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ordered, passes
from ..operators.layout import text_extent
from .tables import table

EXTS = ("mp4 wav jpg png docx hwp pptx xlsx pdf csv gif xyz mov ogg jpeg svg doc hwpx ppt ods pdf tif ico".split() + [""])
HEADS = ("504B030414000600 D0CF11E0A1B11AE1 FFD8FFE000104A46 89504E470D0A1A0A 255044462D312E37 4749463839610100 "
         "5249464624080000 0000001866747970 4F67675300020000 664C614300000022 1A45DFA301000000 7B5C727466310000").split()


def _pick(items: list[str], index: str):
    return F.element_at(F.array(*[F.lit(x) for x in items]), F.expr(f"cast({index} as int) + 1"))


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    ext = _pick(EXTS, "doc_id % 24")
    ext = F.when(F.expr("(doc_id div 24) % 3 = 0"), F.upper(ext)).otherwise(ext)
    base = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", F.col("doc_id").alias("pos"),
        F.expr("case when doc_id % 5 < 3 then concat(source, '-m', doc_id % 6) "
               "else concat(source, '-x', doc_id % 12) end").alias("batch"),
        F.when(F.expr("doc_id % 24 = 23"), base).otherwise(F.concat(base, F.lit("."), ext)).alias("name"),
        F.col("n_chars").alias("size"))


def heads(spark: SparkSession, d: str) -> DataFrame:
    """files + content: a head, for a quarter of them the encryption marker, then the whole text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("did"), "text")
    head = F.unhex(_pick(HEADS, "(did + did div 24) % 12"))
    marker = F.when(F.expr("did % 4 = 0"), F.encode(F.lit("EncryptionInfo"), "UTF-16LE")).otherwise(F.lit(b""))
    content = docs.select("did", F.concat(head, marker, F.encode("text", "UTF-8")).alias("content"))
    return files(spark, d).join(content, F.col("doc_id") == F.col("did")).drop("did")


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
            .select("doc_id", F.expr("line_no div 12").cast("int").alias("page"), "line_no", "text",
                    F.expr("800 - 14 * (line_no % 12)").alias("y"), F.lit(72).alias("x0"),
                    (F.lit(72) + 6 * F.length("text")).alias("x1")))


#: Characters of text that one task takes. A character becomes a row of some 200 bytes, so that a task sorts about 200 MB.
TASK_CHARS = 1 << 20


def _width(spark: SparkSession, d: str) -> int:
    """Number of partitions for words and characters: by the text they come from, so that a task's share of rows does not grow."""
    n = table(spark, d, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_CHARS))


def _spread_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "page", "line_no", "y", "text").repartition(_width(spark, d), "doc_id", "page")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Words with positions. Lines are spread by page before the words are split out, so the page-level
    operators downstream reuse this one exchange. Its width is given by the length of the texts: rows multiply behind it,
    and adaptive coalescing would judge it by its small input."""
    words = (_spread_lines(spark, d)
             .select("doc_id", "page", "line_no", "y", F.posexplode(F.split("text", " ")).alias("item_no", "str")))
    w = (Window.partitionBy("doc_id", "page", "line_no").orderBy("item_no")
         .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(F.length("str") + 1).over(w), F.lit(0))
    return words.select("doc_id", "page", "line_no", "item_no", "str", (F.lit(72) + 6 * before).cast("int").alias("x"),
                        "y", F.lit(10).alias("size"), (6 * F.length("str")).alias("width"))


def raw_items(spark: SparkSession, d: str) -> DataFrame:
    """Words as a text extractor hands them over: a six-number transform, the size inside it."""
    return items(spark, d).select(
        "doc_id", "page", F.expr("line_no * 4294967296L + item_no").alias("item_no"), "str",
        F.expr("array(10D, 0D, 0D, case when item_no % 7 = 3 then 0D else 10D end, cast(x as double), cast(y as double))")
        .alias("transform"), F.col("width").cast("double").alias("width"), F.lit(10.0).alias("height"))


def chars(spark: SparkSession, d: str) -> DataFrame:
    """One row per character of every word plus one blank after it. Fonts change every third word. Passes over whole lines make
    the same rows from the lines themselves."""
    it = items(spark, d)
    ch = it.select("doc_id", "page", F.col("line_no").alias("line"), F.col("item_no").alias("span"), "x", "y",
                   F.posexplode(F.split(F.concat("str", F.lit(" ")), "")).alias("char_no", "c"))
    x0 = F.expr("x + 6 * char_no")
    out = ch.select("doc_id", "page", "line", "span", "char_no", "c", x0.alias("x0"), (x0 + 6).alias("x1"),
                    F.col("y").alias("y0"), (F.col("y") + 10).alias("y1"), F.lit(10).alias("size"),
                    F.expr("case when (span div 3) % 2 = 0 then 'Arial' else 'Batang' end").alias("font"),
                    F.expr("case when (span div 5) % 2 = 0 then 0 else 16 end").alias("flags"),
                    F.lit(0).alias("color"),
                    F.expr("c = ' ' and (doc_id + span) % 3 = 0").alias("syn"))
    return passes.made_by(out, _spread_lines(spark, d), ["doc_id", "page"], ["line_no"], _chars_of_pages)


#: Characters that a pass takes at a time: more where a page has more.
PART_CHARS = 1 << 18


def _chars_of_pages(batch):
    """The rows of `chars`, whole pages at a time, from the lines of whole pages."""
    import numpy as np
    import pyarrow.compute as pc

    first = np.flatnonzero(passes.column(batch, passes.FIRST))
    before = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False) + 1)])
    cut = [0]
    for i in first[1:].tolist():
        if before[i] - before[cut[-1]] >= PART_CHARS:
            cut.append(i)
    for begin, end in zip(cut, [*cut[1:], batch.num_rows]):
        yield _chars_of_lines(passes.Rows.of(batch.slice(begin, end - begin)))


def _chars_of_lines(rows):
    import numpy as np
    import pyarrow as pa

    text, length = passes.text_codes(rows.arrow("text"))
    n = length + 1  # a blank after the last word too
    line_at = np.repeat(np.arange(len(n)), n)
    code = np.full(len(line_at), 32, np.uint32)
    code[np.arange(len(text)) + np.repeat(np.arange(len(n)), length)] = text
    place = np.arange(len(code))
    opens = np.zeros(len(code), bool)  # first characters of lines
    opens[np.cumsum(n) - n] = True
    blank = code == 32
    words = np.cumsum(blank) - blank
    span = words - words[np.cumsum(n) - n][line_at]
    char_no = place - np.maximum.accumulate(np.where(opens | np.append(False, blank[:-1]), place, 0))
    line_no = rows.filled("line_no")
    key = np.cumsum(rows.filled(passes.FIRST) | np.append(True, line_no[1:] != line_no[:-1]))
    if (key[1:] == key[:-1]).any():  # lines of one number: their words stand by number, and go on where the word before ends
        at = np.lexsort((span, key[line_at]))
        line_at, code, span, char_no, blank = line_at[at], code[at], span[at], char_no[at], blank[at]
    key = key[line_at]
    opens = np.append(True, key[1:] != key[:-1])
    x0 = 72 + 6 * (place - np.maximum.accumulate(np.where(opens, place, 0)))
    of_line = rows.take(line_at)

    def pick(names, index):
        return pa.array(names).take(pa.array(index))

    def syn():
        at = (of_line.filled("doc_id") + span) % 3 == 0
        gap = of_line.null("doc_id")
        return blank & at if gap is None else pa.array(blank & at, mask=blank & gap)

    made = {k: (lambda k=k: of_line.raw(k)) for k in ("doc_id", "page")}
    made |= {"line": lambda: of_line.raw("line_no"), "span": span, "char_no": char_no, "c": code.view("<U1"), "x0": x0, "x1": lambda: x0 + 6,
             "y0": lambda: of_line.raw("y"), "y1": lambda: of_line.filled("y") + 10, "size": lambda: np.full(len(code), 10),
             "font": lambda: pick(["Arial", "Batang"], span // 3 % 2), "flags": lambda: np.where(span // 5 % 2 == 0, 0, 16),
             "color": lambda: np.zeros(len(code), np.int64), "syn": syn}
    return passes.Rows(len(code), made)


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two columns. A character is as wide as lets three quarters of a page's lines fit 220 points."""
    base = F.expr("case when line_no % 5 = 4 or line_no % 2 = 0 then 72 else 320 end")
    sized = text_extent(lines(spark, d).withColumn("n", F.length("text")), F.col("n"))
    return sized.select(
        "doc_id", "page", F.col("line_no").alias("el_id"), F.lit("line").alias("kind"), base.alias("x0"),
        F.col("y").alias("y0"),
        F.expr("case when line_no % 5 = 4 then 550 else (case when line_no % 2 = 0 then 72 else 320 end) + 220 * n div extent end").alias("x1"),
        (F.col("y") + 10).alias("y1"), "text", F.lit(10).alias("size"))


def column_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of tall two-column sheets: 48 lines a sheet, alternately left and right, every ninth full width."""
    src = lines(spark, d).select("doc_id", F.expr("cast(line_no div 48 as int)").alias("page"), "line_no", "text", F.length("text").alias("n"))
    left = "(line_no % 2 = 0)"
    full = "(line_no % 9 = 8)"
    return text_extent(src, F.col("n")).select(
        "doc_id", "page", F.col("line_no").alias("el_id"),
        F.lit("line").alias("kind"),
        F.expr(f"case when {full} or {left} then 72 else 320 end").alias("x0"),
        F.expr("14 * ((line_no % 48) div 2) + 40").alias("y0"),
        F.expr(f"case when {full} then 550 when {left} then 72 else 320 end + if({full}, 0, 120 + 100 * n div extent)").alias("x1"),
        F.expr("14 * ((line_no % 48) div 2) + 50").alias("y1"), "text", F.lit(10).alias("size"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """lineitem rows as table rows; text with blanks and tabs to clean, some cells null or empty."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                            "l_quantity", "l_returnflag", "l_linestatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # cells are made behind the exchange, which then carries numbers only, and rows keep standing by their order
    return li.withColumn("row_no", F.row_number().over(w)).select(F.col("l_orderkey").alias("doc_id"), "row_no", F.array(
        F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2),
        F.col("l_quantity").cast("decimal(12,2)").cast("string"),
        F.expr("case when l_partkey % 11 = 0 then null when l_partkey % 11 = 1 then '' "
               "else concat(' ', l_returnflag, '  \\t', l_linestatus, ' ') end")).alias("cells"))


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Extracted tables: customers are documents, orders are tables (one page each), lineitems are rows.
    Every third order lacks the last column, every second repeats a header row."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_no"))
    c = cells(spark, d).withColumnRenamed("doc_id", "table_no")
    cut = F.when(F.expr("table_no % 3 = 0"), F.slice("cells", 1, 2)).otherwise(F.col("cells"))
    body = c.join(o, "table_no").select("doc_id", "table_no", "row_no", cut.alias("cells"))
    # the header comes with the first row of its table, so rows are read once and keep standing by table
    head = F.expr("case when table_no % 3 = 0 then array('price', 'qty') else array('price', 'qty', 'flag') end")
    row = F.struct("row_no", "cells")
    both = F.when(F.expr("row_no = 1 and table_no % 2 = 0"), F.array(F.struct(F.lit(0).alias("row_no"), head.alias("cells")), row)).otherwise(F.array(row))
    return body.select("doc_id", "table_no", F.inline(both))


#: Table rows that one task takes: their boxes hold some half a million characters.
TASK_ROWS = 1 << 15


def cellboxes(spark: SparkSession, d: str) -> DataFrame:
    """Three boxes a row. Rows are spread by their number: boxes and characters multiply behind the exchange."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                            "l_quantity")
    li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // TASK_ROWS)), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (li.select("l_orderkey", "l_partkey", "l_quantity", F.row_number().over(w).alias("r"))
            .select(F.col("l_orderkey").alias("tbl"), "r", "l_partkey", "l_quantity",
                    F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("col"))
            .select("tbl", "r", "col", F.expr("72 + 100 * col + l_partkey % 3").alias("x0"),
                    F.expr("160 + 100 * col - l_partkey % 2").alias("x1"),
                    F.expr("100 + 14 * r").cast("long").alias("y0"), F.expr("112 + 14 * r").cast("long").alias("y1"),
                    "l_partkey", F.col("l_quantity").cast("int").alias("qty")))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as tiny frames; px holds every value in thirds."""
    e = ordered.row_number(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "frame_no")
    return e.select(F.col("label").alias("stream"), "frame_no", "vec_id",
                    F.expr("transform(embedding, v -> cast(floor(3 * cast(v as double)) as int))").alias("px"))


def bytes_of(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, px): every value of a vector moved to 0-255."""
    return table(spark, d, "embeddings").select(
        "vec_id", F.expr("transform(embedding, v -> cast(floor(128 + 127 * cast(v as double)) as int))").alias("px"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as RGB images: each value moved to 0-255, zeros up to a whole number of pixels."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.expr(
        "concat(transform(embedding, v -> cast(floor(128 + 127 * cast(v as double)) as int)), "
        "array_repeat(0, cast(pmod(-size(embedding), 3) as int)))").alias("px"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.expr("""case event_type
      when 'view' then concat('Stream #0:0: Video: ', element_at(array('h264','hevc','vp9'), cast(event_id % 3 as int) + 1),
                              ', yuv420p(tv), 640x360, ', case when event_id % 5 = 0 then '25 tbr' when event_id % 5 = 1
                              then '240 fps' else '29.97 fps' end)
      when 'click' then concat('Stream #0:1: Audio: ', element_at(array('aac','opus'), cast(event_id % 2 as int) + 1),
                               ', 44100 Hz, ', 64 + 32 * (event_id % 5), ' kb/s')
      when 'signup' then concat('Duration: 00:0', event_id % 10, ':12.50, start: 0')
      when 'purchase' then concat(case when event_id % 4 = 0 then '[3/4] parsing ' when event_id % 4 = 1
                                  then '[4/4] writing ' else '' end,
                                  '(', event_id % 9 + 1, '/10) Page ', event_id % 9 + 1)
      else concat('Ignore page ', event_id % 50) end""")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", "event_type", line.alias("line"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Download reports: bytes come from the event value; a third of the paths never learn their total."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("path"), "ts", F.col("event_id").alias("seq"),
                    F.expr("cast(floor(value * 100) as bigint)").alias("loaded"),
                    F.expr("case when user_id % 3 = 0 then cast(null as bigint) else 1000000 + user_id end").alias("total"))
