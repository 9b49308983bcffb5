"""Readers: parquet tables, raw files and declared JSON/CSV inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key, for work that is heavy per row: a scan's splits follow bytes, not work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def scan_files(spark: SparkSession, path: str, glob: str = "*", with_content: bool = False) -> DataFrame:
    """Files as rows. Without `with_content` the bytes are pruned from the scan and never read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    cols = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime")]
    return raw.select(*cols, *(["content"] if with_content else []))


def read_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A declared input kept as JSON lines."""
    return spark.read.schema(schema(name)).json(path)
