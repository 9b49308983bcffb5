"""F: fonts."""

from pyspark.sql import functions as F

from ..operators import fonts as P
from ..rules import fonts as R
from ..sources import views as V
from ..sources.tables import spread, table
from .catalog_queries import _values
from .registry import query
from .sqlviews import sql_list

NAMES = ["ABCDEF+Arial-BoldMT", "HCR Batang", "Malgun_Gothic", "CMR10", "LMMath-Regular", "Foo-BoldItalicMT", "UnknownSong", "TimesNewRomanPS-BoldMT",
         "나눔고딕", "Helvetica,Bold", "Courier New", "CenturyGothic", "Wingdings-Regular", "Noto Sans CJK KR", "Verdana", "Consolas", "Segoe UI",
         "바탕체", "Georgia", "PSMT", "D2Coding", "Pretendard", "맑은 고딕", "Unheard Of", "함초롬바탕", "New Gulim", "Noto Serif KR", "Roboto Slab-Light"]


def _font_names(spark, d):
    """Font names cycling over the parts, with the part's own name behind the unknown ones."""
    n = F.element_at(F.array(*[F.lit(x) for x in NAMES]), F.expr(f"cast(p_partkey % {len(NAMES)} as int) + 1"))
    name = F.when(F.expr("p_partkey % 3 = 2"), F.concat("p_name", F.lit("-"), n)).otherwise(n)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.expr("if(p_partkey % 2 = 0, '한글 본문', p_name)").alias("text"))


_N = {"f_fonts": f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN p_name || '-' || {sql_list(NAMES)}[p_partkey % {len(NAMES)} + 1] ELSE {sql_list(NAMES)}[p_partkey % {len(NAMES)} + 1] END AS name,
   CASE WHEN p_partkey % 2 = 0 THEN '한글 본문' ELSE p_name END AS text FROM part""",
      "r_rules": "SELECT * FROM (" + _values([(i, p, v) for i, (p, v) in enumerate(R.NAME_RULES)]) + ") t(i, p, v)",
      "f_keyed": r"SELECT *, string_split(name, '+')[-1] AS raw, lower(regexp_replace(string_split(name, '+')[-1], '[\s_\-,]', '', 'g')) AS k FROM f_fonts",
      "f_ruled": "SELECT f.id, f.name, f.text, f.raw, f.k, min_by(r.v, r.i) AS hit FROM f_keyed f LEFT JOIN r_rules r ON regexp_matches(f.k, r.p) GROUP BY ALL",
      "f_mapped": rf"""SELECT *, coalesce(hit, CASE WHEN regexp_matches(text, '[가-힣]') THEN CASE WHEN regexp_matches(k, '{R.SERIF_HINT}') THEN '바탕' ELSE '맑은 고딕' END
        ELSE coalesce(nullif(regexp_replace(regexp_replace(raw, '{R.STYLE_TAIL}', ''), '(PSMT|PS|MT)$', ''), ''), raw) END) AS font FROM f_ruled"""}


@query("map_font_names", "SELECT id, name, font FROM f_mapped", _N)
def _(spark, d):
    return _font_names(spark, d).select("id", "name", P.map_font_name(F.col("name"), F.col("text")).alias("font"))


@query("east_asian_font", f"""SELECT id, CASE WHEN regexp_matches(text, '[가-힣]') THEN CASE WHEN list_contains({sql_list(R.KOREAN_FONTS)}, font) THEN font WHEN regexp_matches(lower(name), '{R.SERIF_HINT}') THEN '바탕'
  ELSE '맑은 고딕' END END AS east FROM f_mapped""", _N)
def _(spark, d):
    return _font_names(spark, d).select("id", P.east_asian_font(F.col("name"), F.col("text")).alias("east"))


_CLS = _N | {"r_office": "SELECT * FROM (" + _values([(i, p, v) for i, (p, v) in enumerate(R.OFFICE_RULES)]) + ") t(i, p, v)",
             "f_class": f"""SELECT id, name, CASE WHEN regexp_matches(name, '{R.MONO}') THEN 'mono' WHEN regexp_matches(name, '{R.KOREAN}') THEN CASE WHEN regexp_matches(name, '{R.KOREAN_SERIF}') THEN 'koSerif' ELSE 'koSans' END
   WHEN regexp_matches(name, '{R.LATIN_SERIF}') THEN 'latinSerif' WHEN regexp_matches(name, '{R.LATIN_SANS}') THEN 'latinSans' ELSE 'koSans' END AS cls FROM f_fonts"""}


@query("font_class", """SELECT f.id, f.cls, coalesce((SELECT min_by(v, i) FROM r_office WHERE regexp_matches(f.name, p)), CASE f.cls WHEN 'koSans' THEN 'MalgunGothic' WHEN 'koSerif' THEN 'Batang' WHEN 'latinSans' THEN 'Arial'
  WHEN 'latinSerif' THEN 'TimesNewRoman' ELSE 'CourierNew' END) AS office FROM f_class f""", _CLS)
def _(spark, d):
    c = _font_names(spark, d).withColumn("cls", P.font_class(F.col("name")))
    return c.select("id", "cls", P.office_name(F.col("name"), F.col("cls")).alias("office"))


_KOEN = {"r_koen": f"SELECT * FROM ({_values(list(R.KO_EN.items()))}) t(k, v)"}


@query("family_key", r"SELECT id, lower(regexp_replace(coalesce(v, name), '[\s_-]', '', 'g')) AS key FROM f_fonts LEFT JOIN r_koen ON name = k", _N | _KOEN)
def _(spark, d):
    return _font_names(spark, d).select("id", P.family_key(F.col("name")).alias("key"))


@query("document_fonts", r"""SELECT DISTINCT page_id, font FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]{2,60})"', 1)) AS font FROM pages)""")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.replace("html", F.lit('href="'), F.lit('typeface="')).alias("markup"))
    return P.markup_fonts(p, "page_id", "markup")


@query("binary_runs", r"""SELECT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\x20-\x7e]{3,60}')) AS run FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', chr(1), 'g') AS t FROM documents))
UNION ALL SELECT doc_id, source FROM documents""")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id").select("doc_id", F.concat(
        F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", "\u0001"), "UTF-8"), F.lit(b"\x01\x01\x01\x01"), F.encode("source", "UTF-16LE"), F.lit(b"\x01\x01")).alias("content"))
    return P.binary_runs(docs, "doc_id", "content")


_NEED = {"f_inst": "SELECT DISTINCT p_name AS family, lower(regexp_replace(p_name, '[\\s_-]', '', 'g')) AS k FROM part",
         "f_links": """SELECT DISTINCT page_id, lower(regexp_replace(replace(f, '/', ''), '[\\s_-]', '', 'g')) AS k FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]{2,60})"', 1)) AS f FROM pages)"""}


@query("fonts_needed", """SELECT DISTINCT l_orderkey AS doc_id, f.k AS family_key FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f_inst f ON f.family = p_name
UNION SELECT DISTINCT -l_orderkey - 1, f.k FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f_inst f ON contains(p_type || ' uses ' || upper(p_name[1]) || p_name[2:] || '; ' || p_name || ' regular', f.family)""", _NEED)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    docs = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    exact = docs.select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("font"))
    runs = docs.select((-F.col("l_orderkey") - 1).alias("doc_id"),
                       F.expr("concat(p_type, ' uses ', upper(substring(p_name, 1, 1)), substring(p_name, 2), '; ', p_name, ' regular')").alias("run"))
    return P.fonts_needed(exact, runs, part.select(F.col("p_name").alias("family")).distinct(), "doc_id")


# Sample coverage used as the second input; the characters come from the documents.
COVERAGE = [("NanumGothic", 0x20, 0x17F), ("NanumGothic", 0x2010, 0x2030), ("HanjaSans", 0x4E00, 0x9FFF), ("Symbols", 0x2190, 0x2BFF), ("Symbols", 0xE0, 0xEF),
            ("LiberationSans", 0xA0, 0x24F), ("LiberationSerif", 0xA0, 0xDE), ("LiberationMono", 0xA0, 0xDF), ("NanumMyeongjo", 0xF0, 0x17F), ("HanjaSerif", 0x3400, 0x9FFF)]


def coverage(spark):
    rows = F.array(*[F.struct(F.lit(f).alias("font"), F.lit(a).alias("cp_start"), F.lit(b).alias("cp_end")) for f, a, b in COVERAGE])
    return spark.range(1).select(F.inline(rows))


_FALL = {"r_cov": "SELECT * FROM (" + _values(COVERAGE) + ") t(font, a, b)",
         "r_chain": "SELECT * FROM (" + _values([(c, i, f) for c, fs in R.CHAINS.items() for i, f in enumerate(fs)]) + ") t(cls, i, font)",
         "f_dchars": f"""SELECT doc_id, {sql_list(list(R.CHAINS))}[doc_id % 5 + 1] AS cls, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id, c"""}


@query("glyph_fallback", """SELECT doc_id, cls, c, n, coalesce(CASE WHEN unicode(c) >= 128 THEN (SELECT min_by(r.font, r.i) FROM r_chain r JOIN r_cov v ON r.font = v.font WHERE r.cls = f.cls AND unicode(f.c) BETWEEN v.a AND v.b) END,
  (SELECT font FROM r_chain r WHERE r.cls = f.cls AND r.i = 0)) AS font FROM f_dchars f""", _FALL)
def _(spark, d):
    ch = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.split("text", "")).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    ch = ch.withColumn("cls", F.element_at(F.array(*[F.lit(x) for x in R.CHAINS]), F.expr("cast(doc_id % 5 as int) + 1")))
    return P.glyph_fallback(ch, coverage(spark)).select("doc_id", "cls", "c", "n", "font")


_SUBST = _N | {"r_subst": "SELECT * FROM (" + _values([(f, i, a) for f, accepted in R.SUBSTITUTES.items() for i, a in enumerate(accepted)]) + ") t(family, i, sub)",
               "f_have": "SELECT unnest(['Carlito', 'Noto Sans KR Hanja', 'DejaVu Sans', 'Georgia', 'Noto Serif KR Hanja', 'NanumMyeongjo', 'Liberation Mono', 'Verdana']) AS h"}


@query("font_substitution", """SELECT id, name AS family, coalesce(CASE WHEN name IN (SELECT h FROM f_have) THEN name END, (SELECT min_by(sub, i) FROM r_subst WHERE family = name AND sub IN (SELECT h FROM f_have))) AS drawn_with FROM f_fonts""", _SUBST)
def _(spark, d):
    have = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Carlito", "Noto Sans KR Hanja", "DejaVu Sans", "Georgia", "Noto Serif KR Hanja", "NanumMyeongjo",
                                                                        "Liberation Mono", "Verdana")])).alias("family"))
    return P.font_substitution(_font_names(spark, d).select("id", F.col("name").alias("family")), have)


_FAMS = ["바탕", "Arial", "Courier", "맑은 고딕", "Times"]
_CLASSES = ["koSerif", "latinSans", "mono", "koSans", "latinSerif"]
_WORD = "translate(str, 'wzWZ', '漢글→…')"  # characters that Latin fonts lack
_USED = {"r_cov": "SELECT * FROM (" + _values(COVERAGE) + ") t(font, a, b)",
         "r_chain": "SELECT * FROM (" + _values([(c, i, f) for c, fs in R.CHAINS.items() for i, f in enumerate(fs)]) + ") t(cls, i, font)",
         "r_code": "SELECT * FROM (" + _values([(f, c, f in R.WITH_BOLD) for f, c in R.CODES.items()]) + ") t(font, code, can_bold)",
         "f_ink": rf"""SELECT doc_id, page, line_no, item_no, {sql_list(_CLASSES)}[item_no % 5 + 1] AS cls, {sql_list([R.CLASS_OFFICE[c] for c in _CLASSES])}[item_no % 5 + 1] AS office,
            coalesce(nullif(left(regexp_replace({_WORD}, '^[\s\p{{Z}}]+', ''), 1), ''), ' ') AS c FROM f_items""",
         "f_inkfont": """SELECT cls, c, CASE WHEN unicode(c) < 128 THEN (SELECT font FROM r_chain r WHERE r.cls = k.cls AND i = 0)
            WHEN regexp_matches(c, '[\u1100-\u11ff\u3130-\u318f\uac00-\ud7af]') THEN (SELECT font FROM r_chain r WHERE r.cls = k.cls AND i = CASE WHEN k.cls IN ('latinSans', 'latinSerif', 'mono') THEN 1 ELSE 0 END)
            ELSE coalesce((SELECT min_by(r.font, r.i) FROM r_chain r JOIN r_cov v ON r.font = v.font WHERE r.cls = k.cls AND unicode(k.c) BETWEEN v.a AND v.b), (SELECT font FROM r_chain r WHERE r.cls = k.cls AND i = 0)) END AS font
            FROM (SELECT DISTINCT cls, c FROM f_ink) k""",
         "f_used": """SELECT doc_id, page, office || '-' || code AS base, can_bold AND (line_no % 7 = 0 OR (item_no % 4 = 1 AND doc_id % 3 = 0)) AS bold
            FROM f_ink JOIN f_inkfont USING (cls, c) JOIN r_code USING (font)"""}


@query("fonts_used", "SELECT DISTINCT doc_id, page, base || CASE WHEN bold THEN '-Bold' ELSE '' END AS font_id, bold FROM f_used", _USED)
def _(spark, d):
    t = V.items(spark, d).select(
        "doc_id", "page", F.element_at(F.array(*[F.lit(x) for x in _FAMS]), F.expr("item_no % 5 + 1")).alias("family"), P.first_ink(F.expr(_WORD)).alias("c"),
        F.expr("if(line_no % 7 = 0, '700', 'normal')").alias("weight"), F.expr("if(item_no % 4 = 1, '#000', 'none')").alias("stroke"), F.lit("#000").alias("fill"),
        F.expr("if(doc_id % 3 = 0, 0.5D, 2D)").alias("stroke_width"), F.lit(10.0).alias("size"))
    g = P.glyph_fallback(t.withColumn("cls", P.font_class(F.col("family"))), coverage(spark))
    return P.fonts_used(g, ["doc_id", "page"], for_office=True)
