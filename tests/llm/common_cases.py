"""Awkward documents every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (4, "one two three"), (5, "one  two\nthree"), (None, "one two three"),
        (None, None), (6, LONG), (7, LONG), (8, "漢字 é 😀 a\x00b"), (9, "x" * 50_000)]
CLASH = ["digest", "content", "salt", "count", "copy", "fingerprint", "component_id", "score", "slot", "shard", "token_ids", "_n", "doc", "place",
         "gram", "node", "root", "_fp", "a", "b", "edits", "_id", "_key", "payload_digest", "_p", "_first", "text_sha256", "name"]


def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASH])


def empty(spark):
    return awkward(spark).filter("false")


def files_of(docs):
    return docs.drop("name", "content").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("http://a.example/"), F.col("doc_id").cast("string")).alias("name"),
                                               F.timestamp_seconds(F.lit(1_600_000_000)).alias("mtime"), F.col("text").alias("content"),
                                               *[c for c in docs.columns if c not in ("doc_id", "text", "name", "content", "slot", "shard")])
