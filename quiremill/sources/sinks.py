"""Writers for finished results: text, CSV lines and workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BUCKETS = 256


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def write_text(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """(doc_id, text) as JSON lines in folders by a hash of doc_id: as many folders as buckets, however many documents."""
    docs.select(bucket(buckets).alias("bucket"), "doc_id", "text").write.partitionBy("bucket").mode("errorifexists").json(path)


def write_csv_lines(lines: DataFrame, path: str, rows_per_part: int = 1_000_000, buckets: int = BUCKETS) -> None:
    """CSV lines with their document, sheet and row number, in folders by a hash of doc_id. A long document is split
    into numbered parts by its own row numbers, so it is written by many tasks and its parts still read in order."""
    part = lines.withColumn("part", F.floor((F.col("row_no") - 1) / rows_per_part)).withColumn("bucket", bucket(buckets))
    (part.repartition("doc_id", "sheet_no", "part").sortWithinPartitions("bucket", "doc_id", "sheet_no", "part", "row_no")
     .select("bucket", "doc_id", "sheet_no", "part", "row_no", "line")
     .write.partitionBy("bucket").mode("errorifexists").parquet(path))


def write_pieces(pieces: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Piece tables in ranges of (key, place): a long document is written by many tasks, and the files read in order."""
    order = [*(key or ["doc_id"]), "piece_no"]
    pieces.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def join_pieces(pieces: DataFrame, out, **key) -> int:
    """Writes one document's pieces in order to `out`, an open text file, one after the other; returns the characters."""
    mine, at = pieces, 0
    for name, value in key.items():
        mine = mine.filter(F.col(name).eqNullSafe(F.lit(value)))
    for r in mine.select("piece_no", "begin", "text").orderBy("piece_no").toLocalIterator():
        if r["begin"] != at:
            raise ValueError(f"piece {r['piece_no']} begins at {r['begin']}, the pieces before end at {at}")
        at += len(r["text"])
        out.write(r["text"])
    return at


def write_blobs(blobs: DataFrame, path: str) -> None:
    """(doc_id, workbook) binaries kept as a parquet table for whoever serves them."""
    blobs.write.mode("errorifexists").parquet(path)
