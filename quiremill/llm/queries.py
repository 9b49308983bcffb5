"""The numbered queries: each maps given tables to an operator's interface and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import alignment, archives, bpe, decontaminate, divergence, exact_dedup, html_text, line_runs, quality, repeats, sharding, simhash, token_counts
from .common import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the production vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query()
def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    path, pattern = vocabulary()
    return bpe.encode_documents(table(spark, d, "documents"), path, pattern, with_content=True).select(
        "doc_id", "n_tokens", F.sha2(F.encode(F.array_join("token_ids", " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"))


@query(r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t""")
def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, d, "documents")).withColumnRenamed("digest", "text_sha256")


def files_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as the library's files; a page's number gives the time of its capture."""
    return table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("name"),
                                           F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id")).alias("mtime"),
                                           F.col("html").alias("content"))


@query()
def op3_html_text(spark: SparkSession, d: str) -> DataFrame:
    found = html_text.main_text(files_of_pages(spark, d))
    return found.select(F.col("file_id").alias("page_id"), F.col("name").alias("url"), "text",
                        F.length("text").cast("long").alias("n_chars"))


SHARDS = [f"shard-{i:03d}" for i in range(100)]


@query()
def op4_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"))
    return sharding.place(docs, SHARDS).withColumnRenamed("file_id", "doc_id")


def edits_of_documents(docs: DataFrame) -> DataFrame:
    """Three edits of every document: its source in front, ten characters out of the middle, its language at the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda begin, end, text, seq=0: F.struct(
        begin.alias("begin"), end.alias("end"), text.alias("text"), F.lit(seq).alias("seq"))
    mid = F.floor(n / 2).cast("int")
    return docs.select("doc_id", F.explode(F.array(
        edit(F.lit(0), F.lit(0), F.concat("source", F.lit("\n"))), edit(mid, mid + 10, F.lit(None).cast("string")),
        edit(n, n, F.concat(F.lit(" "), "lang"), 1))).alias("e")).select("doc_id", "e.*")


@query()
def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    path, pattern = vocabulary()
    docs = table(spark, d, "documents")
    trees = token_counts.token_trees(docs, path, pattern)
    return token_counts.recount(trees, edits_of_documents(docs), path, pattern).select(
        "doc_id", "n_before", "n_tokens", "n_edits", "chars_encoded")


@query()
def op6_repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, d, "documents"))


@query(r"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages),
     q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM q""")
def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    history = archives.archive_files(files_of_pages(spark, d), new_folder(spark, "warc"))
    return history.select(F.col("file_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents")).select(
        "doc_id", simhash.hex_of("fingerprint").alias("fingerprint"), "component_id")


@query()
def op9_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, d: str) -> quality.Model:
    labels = table(spark, d, "labels").select("doc_id", "quality").filter(~held_out())
    return quality.fit(table(spark, d, "documents"), labels, "quality")


@query()
def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, d, "documents"), quality_model(spark, d))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
     o AS (SELECT lang, source, unnest(words) AS item FROM d),
     u AS (SELECT lang, unnest(list_distinct(words)) AS item FROM d),
     k AS (SELECT lang, item FROM u GROUP BY ALL HAVING count(*) >= 30),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, item, count(*) AS n FROM o SEMI JOIN k USING (lang, item) GROUP BY ALL),
     gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
     lc AS (SELECT lang, item, sum(n) AS n FROM c GROUP BY ALL),
     lt AS (SELECT lang, sum(n) AS total FROM lc GROUP BY ALL),
     p AS (SELECT lang, source, item, coalesce(c.n, 0) AS n,
                  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total, 0)::HUGEINT + 5 * v) AS p
           FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gt USING (lang, source) LEFT JOIN c USING (lang, source, item)),
     q AS (SELECT lang, item, 1 + (1000000000::HUGEINT * (n + 5)) // (total::HUGEINT + 5 * v) AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
           UNION ALL SELECT lang, source, 'term', item, p - q FROM p JOIN q USING (lang, item) WHERE p.n > 0 AND p > q),
     s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM s WHERE part = 'pair' OR rank <= 50""")
def op11_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("text", "lang", F.col("source").alias("category"))
    return divergence.category_divergence(docs).withColumnRenamed("category", "source")


@query()
def op12_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers
    return alignment.align_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     d AS (SELECT k.*, f.last IS NOT NULL AND f.last <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""")
def op13_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_runs.without_frequent_lines(table(spark, d, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
