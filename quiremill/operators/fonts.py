"""Font names: ordered rules, aliases, document fonts, glyph coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HANGUL, WS, first_rule, list_map, lookup, str_map
from ..rules import fonts as R


def map_font_name(name: Column, text: Column) -> Column:
    """Office name of an embedded font: first matching rule, else a default for Hangul text, else a tidied name."""
    raw = F.substring_index(F.coalesce(name, F.lit("")), "+", -1)
    key = F.lower(F.regexp_replace(raw, rf"[_\-,]|{WS}", ""))
    clean = F.regexp_replace(F.regexp_replace(raw, R.STYLE_TAIL, ""), "(PSMT|PS|MT)$", "")
    hangul = F.coalesce(text, F.lit("")).rlike(HANGUL)
    fallback = F.when(hangul, F.when(key.rlike(R.SERIF_HINT), R.SERIF_DEFAULT).otherwise(R.SANS_DEFAULT)).otherwise(
        F.when(clean == "", raw).otherwise(clean))
    return first_rule(key, R.NAME_RULES, fallback)


def east_asian_font(name: Column, text: Column) -> Column:
    """East Asian font of a run with Hangul, null for other runs."""
    mapped = map_font_name(name, text)
    pick = F.when(mapped.isin(R.KOREAN_FONTS), mapped).when(F.lower(name).rlike(R.SERIF_HINT), R.SERIF_DEFAULT).otherwise(R.SANS_DEFAULT)
    return F.when(F.coalesce(text, F.lit("")).rlike(HANGUL), pick)


def font_class(family: Column) -> Column:
    return (F.when(family.rlike(R.MONO), "mono")
            .when(family.rlike(R.KOREAN), F.when(family.rlike(R.KOREAN_SERIF), "koSerif").otherwise("koSans"))
            .when(family.rlike(R.LATIN_SERIF), "latinSerif").when(family.rlike(R.LATIN_SANS), "latinSans").otherwise("koSans"))


def office_name(family: Column, cls: Column) -> Column:
    return first_rule(family, R.OFFICE_RULES, lookup(str_map(R.CLASS_OFFICE), cls))


def fold_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, rf"[_-]|{WS}", ""))


def family_key(name: Column) -> Column:
    return fold_name(F.coalesce(lookup(str_map(R.KO_EN), name), name))


def markup_fonts(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """Distinct font names in the attributes of document markup."""
    pat = F.lit(R.FONT_ATTR)
    pairs = F.arrays_zip(F.regexp_extract_all(markup, pat, F.lit(1)).alias("a"), F.regexp_extract_all(markup, pat, F.lit(2)).alias("b"))
    e = docs.select(key, F.explode(pairs).alias("p")).select(key, F.when(F.col("p.a") != "", F.col("p.a")).otherwise(F.col("p.b")).alias("n"))
    return e.select(key, F.regexp_replace("n", "^'|'$", "").alias("font")).distinct()


def binary_runs(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Readable runs of a binary document, UTF-16 ones and ASCII ones."""
    latin = F.decode(content, "ISO-8859-1")
    wide = F.transform(F.regexp_extract_all(latin, F.lit(R.WIDE_RUN), F.lit(0)), lambda m: F.decode(F.encode(m, "ISO-8859-1"), "UTF-16LE"))
    return docs.select(key, F.explode(F.concat(wide, F.regexp_extract_all(latin, F.lit(R.ASCII_RUN), F.lit(0)))).alias("run"))


def fonts_needed(exact: DataFrame, runs: DataFrame, installed: DataFrame, key: str) -> DataFrame:
    """(document, family key) pairs whose installed font should be taken along.

    `exact` (key, font) are names from markup, `runs` (key, run) text runs, `installed` (family). A family
    name inside a run is found by joining the name's first three characters with the runs' trigrams and
    then checking the few candidates, not by testing every name against every run.
    """
    fams = installed.select("family", fold_name(F.col("family")).alias("family_key")).filter(~F.col("family_key").isin(R.COVERED))
    by_key = exact.select(key, family_key(F.col("font")).alias("family_key")).join(fams.select("family_key").distinct(), "family_key", "left_semi")
    korean = F.array(*[F.struct(F.lit(fold).alias("k"), F.lit(ko).alias("n")) for ko, fold in
                       ((ko, "".join(ch for ch in en.lower() if ch not in " _-")) for ko, en in R.KO_EN.items())])
    also = F.transform(F.filter(korean, lambda s: s["k"] == F.col("family_key")), lambda s: s["n"])
    names = (fams.select("family_key", F.explode(F.concat(F.array("family"), also)).alias("name")).filter(F.length("name") >= 3)
             .select("family_key", "name", F.substring("name", 1, 3).alias("gram")).distinct())
    distinct_runs = runs.filter(F.length("run") >= 3).distinct()
    grams = distinct_runs.select(key, "run", F.explode(F.array_distinct(F.expr(
        "transform(sequence(1, length(run) - 2), i -> substring(run, i, 3))"))).alias("gram"))
    by_run = grams.join(names, "gram").filter(F.contains("run", F.col("name"))).select("family_key", key)
    return by_key.select(key, "family_key").unionByName(by_run.select(key, "family_key")).distinct()


_BLOCK = 256


def chain_places(coverage: DataFrame) -> DataFrame:
    """For every class and block of 256 code points that a font of its chain touches, the place in the chain (from 1) of the
    first font that covers each code point. At most 4,352 blocks a class, whatever is drawn."""
    chains = F.array(*[F.struct(F.lit(cls).alias("cls"), F.array(*[F.lit(f) for f in fonts]).alias("chain")) for cls, fonts in R.CHAINS.items()])
    block = F.sequence(F.floor(F.col("cp_start") / _BLOCK), F.floor(F.col("cp_end") / _BLOCK))
    cov = coverage.select("font", "cp_start", "cp_end", F.explode(block).alias("_b")).select("*", F.inline(chains))
    cov = cov.withColumn("_pos", F.array_position("chain", F.col("font"))).filter("_pos > 0")
    spans = cov.groupBy("cls", "_b").agg(F.array_sort(F.collect_set(F.struct("_pos", "cp_start", "cp_end"))).alias("_spans"))

    def first(i):
        cp = F.col("_b") * _BLOCK + i
        return F.get(F.filter("_spans", lambda s: cp.between(s["cp_start"], s["cp_end"])), F.lit(0))["_pos"].cast("byte")
    return spans.select("cls", "_b", F.transform(F.sequence(F.lit(0), F.lit(_BLOCK - 1)), first).alias("_places"))


def glyph_fonts(codepoints: DataFrame, coverage: DataFrame) -> DataFrame:
    """Add `font` to rows with `cls`, `cp` and `c`: own rules for ASCII and Hangul, else the first font of the class chain
    that covers the code point. The rows only look up their block's places: they are read once and stay where they are."""
    chain = lookup(list_map(R.CHAINS), F.col("cls"))
    head = F.get(chain, F.lit(0))
    fixed = (F.when(F.col("cp") < 0x80, head)
             .when(F.col("c").rlike(R.GLYPH_HANGUL), F.when(head.startswith("Liberation"), F.get(chain, F.lit(1))).otherwise(head)))
    places = chain_places(coverage).select(F.col("cls").alias("_cls"), F.col("_b").alias("_block"), "_places")
    seen = codepoints.join(places, (F.col("cls") == F.col("_cls")) & (F.floor(F.col("cp") / _BLOCK) == F.col("_block")), "left")
    hit = F.get(chain, F.get("_places", (F.col("cp") % _BLOCK).cast("int")).cast("int") - 1)
    return seen.select(*codepoints.columns, F.coalesce(fixed, hit, head).alias("font"))


def glyph_fallback(chars: DataFrame, coverage: DataFrame) -> DataFrame:
    """Add `font` to rows with `cls` and `c`; null without a character."""
    cp = F.when(F.length("c") == 1, F.ascii("c")).otherwise(F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("int"))
    fonts = glyph_fonts(chars.withColumn("cp", cp), coverage)
    return fonts.select(*chars.columns, F.when(F.col("c").isNotNull(), F.col("font")).alias("font"))


def font_substitution(requests: DataFrame, installed: DataFrame) -> DataFrame:
    """Family actually drawn with: the family itself, else its first accepted substitute that is installed."""
    have = installed.select(F.col("family").alias("_have")).distinct()
    listed = requests.withColumn("_try", F.concat(F.array("family"), F.coalesce(lookup(list_map(R.SUBSTITUTES), F.col("family")), F.expr("cast(array() as array<string>)"))))
    tried = listed.select("family", "_try").distinct().select("family", F.posexplode("_try").alias("_pos", "_name"))
    found = tried.join(have, F.col("_name") == F.col("_have")).groupBy("family").agg(F.min_by("_name", "_pos").alias("drawn_with"))
    return listed.drop("_try").join(found, "family", "left")


def fonts_used(texts: DataFrame, key: list[str], for_office: bool = False) -> DataFrame:
    """Distinct font ids per document or page. `texts` carry family, cls, font (see glyph_fallback), weight, stroke,
    fill, stroke_width, size; thin strokes in the fill colour are a drawn bold."""
    drawn = F.coalesce((F.col("stroke") != "none") & (F.col("stroke") == F.col("fill")) & (F.coalesce("stroke_width", F.lit(0.0)) <= F.col("size") * 0.08), F.lit(False))
    # names and weights are matched with patterns, so this is done for the few kinds of text of a page, not for each of its texts
    kinds = texts.select(*key, "family", "cls", "font", "weight", drawn.alias("_drawn")).distinct()
    bold = F.col("font").isin(R.WITH_BOLD) & (F.coalesce(F.col("weight"), F.lit("")).rlike("bold|[6-9]00") | F.col("_drawn"))
    base = F.concat(office_name(F.col("family"), F.col("cls")), F.lit("-"), lookup(str_map(R.CODES), F.col("font"))) if for_office else F.col("font")
    return kinds.select(*key, F.concat(base, F.when(bold, F.lit("-Bold")).otherwise(F.lit(""))).alias("font_id"), bold.alias("bold")).distinct()


def first_ink(text: Column) -> Column:
    """First visible character, a blank when there is none."""
    first, ink = F.substring(text, 1, 1), F.regexp_extract(text, f"[^{WS[1:]}", 0)
    return F.when(first.between("!", "~"), first).when(ink == "", F.lit(" ")).otherwise(ink)
