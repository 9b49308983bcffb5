"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import bpe, decontaminate, exact_dedup, quality, simhash
from quiremill.llm.common import free_name, new_folder
from quiremill.llm.queries import quality_model, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model does not reject (score 0.3 or more); every row is judged by its own text, whatever its id."""
    score = free_name(docs, "score")
    return quality.with_scores(docs, quality_model(spark, sf_dir), score).filter(F.col(score) >= 0.3).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the smallest doc_id, null ids last; of rows that repeat id and
    text any one."""
    return exact_dedup.without_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: that with the smallest doc_id, null ids last, then by the text's
    digest; rows are told apart by id and text, so an id that repeats or is null does no harm."""
    return simhash.without_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no passage of the benchmark stay, whatever their id."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens) of every row that is left; null ids stay null."""
    path, pattern = vocabulary()
    return bpe.encode_documents(docs, path, pattern)


STAGES = [("quality_classifier", good_quality), ("exact_dedup", exact_copies), ("simhash_near_dedup", near_copies),
          ("benchmark_decontamination", benchmark_passages), ("byte_bpe", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
