"""Exact duplicates among converted documents, without Python: local, salted and global combining on full content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, whole_text

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text with every run of blanks, tabs and line ends as one blank; null as the empty text."""
    return F.regexp_replace(whole_text(text), BLANKS, " ")


def sha256_of(content: Column) -> Column:
    """Never null, so that a join on it needs no filter that would compute it twice."""
    return F.coalesce(F.sha2(F.encode(content, "UTF-8"), 256), F.lit(""))


def exact_groups(docs: DataFrame, salts: int = 16, digest=sha256_of) -> DataFrame:
    """(digest, content, keep_id, group_size): one row per distinct normalised text.

    Rows are keyed by digest, full content and a salt drawn from their input partition. The combining step of the first
    aggregate merges the copies inside a partition, so at most one row per distinct text leaves it; the exchange by the
    salted key merges the partitions of one salt, so a text that fills a third of the table is spread over `salts` tasks;
    the second aggregate merges the salt winners. The content is a grouping key throughout: texts that only share a
    digest never meet.
    """
    rows = docs.select("doc_id", normalised().alias("content")).select(
        "doc_id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    local = rows.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return local.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _members(ids: DataFrame, groups: DataFrame, key: list[str], hot: int) -> DataFrame:
    """Every row of `ids` (key, doc_id, row) with its group (key, keep_id, group_size) and whether it is the one that stays.

    The groups that hold more than one in `hot` of all rows, at most `hot` of them, are broadcast, so their rows stay where
    they are; the others meet by key."""
    first = ids.groupBy(*key, "doc_id").agg(F.min("row").alias("_first")).withColumnRenamed("doc_id", "_keep")
    same = F.col("keep_id").eqNullSafe(F.col("_keep"))
    named = kept(groups.join(first, key).filter(same).drop("_keep"))
    total = named.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * hot > total
    big = F.broadcast(named.filter(large))
    met = ids.join(big, key).unionByName(ids.join(big.select(*key), key, "left_anti").join(named.filter(~large), key))
    return met.withColumn("kept", F.col("row") == F.col("_first"))


def exact_duplicates(docs: DataFrame, salts: int = 16, digest=sha256_of, hot: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size long, kept boolean, digest): one row per row of `docs` (doc_id, text).

    Texts are equal when they are identical after white-space normalisation (`normalised`; null equals the empty text).
    The smallest doc_id of a group stays; null ids come last, a group without any id keeps one of its rows (keep_id
    null). Of rows that repeat both id and text one stays and the others are reported as dropped. Documents find their
    group by digest; where a digest stands for several texts, by the full content. Other columns are not read.
    """
    groups = kept(exact_groups(docs, salts, digest).drop("content"))
    shared = groups.groupBy("digest").count().filter("count > 1").select("digest")
    row = F.monotonically_increasing_id().alias("row")
    ids = kept(docs.select("doc_id", digest(normalised()).alias("digest"), row))
    if shared.isEmpty():
        found = _members(ids, groups, ["digest"], hot)
    else:  # a digest with two texts: these documents are matched by the texts themselves
        some = kept(docs.select("doc_id", normalised().alias("content"), row).withColumn("digest", digest(F.col("content")))
                    .join(shared, "digest", "left_semi"))
        per_text = some.groupBy("digest", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        one = _members(ids.join(shared, "digest", "left_anti"), groups.join(shared, "digest", "left_anti"), ["digest"], hot)
        found = one.unionByName(_members(some, per_text, ["digest", "content"], hot).drop("content"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "digest")


def without_exact_duplicates(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, all columns as they are. Of rows that repeat id and text, which
    one stays is open when their other columns differ; the others go before the exchange, in each partition."""
    def key(digest):  # one key that is never null: ranking and join share its exchange and order
        return F.concat(digest, F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))

    stay = exact_duplicates(docs, salts).filter("kept").select(key(F.col("digest")).alias("_stay"))
    rows = docs.select(F.struct("*").alias("_row"), key(sha256_of(normalised())).alias("_key"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).filter("_n = 1")
    return first.join(stay, F.col("_key") == F.col("_stay"), "left_semi").select("_row.*")
