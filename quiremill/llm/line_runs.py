"""Lines that many converted documents repeat (notices, running headers, licences), removed from all but the last of them.

Documents come in batches, the largest ids first. A batch's lines become one sorted run of (line hash, documents, last id).
The run is merge-anti-joined with the runs before it: hashes they don't hold are fresh, and the batch's last id is the one
that keeps the line; for the others only the number of documents is added. Runs have levels: `fanout` runs of one level are
compacted to one run of the next, so a batch meets few runs. All runs are bucketed and sorted by the hash in the same way,
so the join reads sorted buckets side by side and exchanges nothing but the new batch.

Hashes have 128 bits of a cryptographic function, so two lines do not share one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_arrow, new_folder, type_of, whole_text

MIN_CHARS, MIN_DOCS = 40, 5
FLUSH = 200_000
HOT_LINES = 1_000_000
HASH = ["h1", "h2"]
BLANKS = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of a line's key: blanks stripped at both ends, A-Z in lower case; None for a key of fewer code points."""
    import hashlib
    key = line.strip(BLANKS)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _halves(digests: list[bytes]):
    """The two columns of a list of hashes."""
    import numpy as np
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs, last_id): every line hash of `docs` (doc_id, text) with the rows that hold it and their largest id."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"h1 long, h2 long, n long, last {type_of(docs, 'doc_id')}"
    target = to_arrow_schema(_parse_datatype_string(ddl))

    def out(found):
        h1, h2 = _halves(list(found))
        n, last = zip(*found.values())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((h1, h2, n, last), target)], schema=target)

    def run(batches):
        found: dict[bytes, tuple] = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                here = {line_hash(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")}
                here.discard(None)
                for h in here:
                    n, last = found.get(h, (0, None))
                    found[h] = (n + 1, i if last is None or i is not None and i > last else last)
                if len(found) >= FLUSH:
                    yield out(found)
                    found = {}
        if found:
            yield out(found)

    rows = docs.select("doc_id", whole_text("text").alias("text")).mapInArrow(run, ddl)
    return rows.groupBy(*HASH).agg(F.sum("n").alias("n_docs"), F.max("last").alias("last_id"))


class LineRuns:
    """Levelled sorted runs of line hashes in the shared checkpoint folder: (h1, h2, n_docs, last_id, fresh)."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark = spark.newSession()  # the sort order of buckets is used here, not in the caller's session
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # a union of bucketed tables does not keep their buckets together
        self.fanout, self.levels, self.made = fanout, [[]], []
        self.folder, self.name = new_folder(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{len(self.made)}"
        (rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{len(self.made)}")
         .format("parquet").saveAsTable(name))
        self.made.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Adds the `line_counts` of a batch whose ids are all smaller than those before."""
        met = batch
        seen = []
        for i, run in enumerate(self.runs()):
            known = run.filter("fresh").select(*HASH, F.lit(True).alias(f"seen{i}"))
            met = met.join(known, HASH, "left")
            seen.append(F.col(f"seen{i}").isNull())
        fresh = F.lit(True)
        for s in seen:
            fresh = fresh & s
        self.levels[0].append(self._write(met.select(*HASH, "n_docs", "last_id", fresh.alias("fresh"))))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = self._write(_merged([self.spark.table(n) for n in self.levels[level]]))
            self.levels[level] = []
            self.levels[level + 1].append(merged)
            level += 1

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(h1, h2, n_docs, last_id) of the lines that at least `min_docs` documents hold; last_id keeps them."""
        runs = self.runs()
        found = kept(_merged(runs).filter(F.col("n_docs") >= min_docs).drop("fresh"))
        for name in self.made:
            self.spark.sql(f"DROP TABLE {name}")  # the name; the run's files stay with the checkpoints
        return found


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: the documents of a hash, the id of its fresh entry, and whether that is among them."""
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max(F.when(F.col("fresh"), F.col("last_id"))).alias("last_id"),
                                   F.max("fresh").alias("fresh"))


def _batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """`docs` cut into about `n` batches by ranges of doc_id, the largest ids first, null ids last."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    parts = (ids.repartitionByRange(max(n, 1), "doc_id").groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")).orderBy(F.desc("lo")).collect())
    total, done, cuts = sum(p["n"] for p in parts), 0, []
    for p in parts:
        done += p["n"]
        if done * n >= total * (len(cuts) + 1) and p is not parts[-1]:
            cuts.append(p["lo"])
    i = F.col("doc_id")
    edges = [None, *cuts, None]
    out = []
    for hi, lo in zip(edges, edges[1:]):
        keep = F.lit(True) if hi is None else i < F.lit(hi)
        keep = keep & (i >= F.lit(lo)) if lo is not None else (keep | i.isNull())
        out.append(docs.filter(keep))
    return out


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(h1, h2, n_docs, last_id) of every line of at least `min_chars` that at least `min_docs` rows of `docs` hold."""
    store = LineRuns(docs.sparkSession, fanout)
    for batch in _batches(docs.select("doc_id", "text"), batches):
        store.add(line_counts(batch, min_chars))
    return store.frequent(min_docs)


def _split_by_size(lines: DataFrame, hot_lines: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent lines, at most `hot_lines`, and the others (None if there are none)."""
    by_power = lines.groupBy(F.floor(F.log2("n_docs")).alias("p")).count().orderBy(F.desc("p")).collect()
    room, level = hot_lines, None
    for r in by_power:
        room -= r["count"]
        if room < 0:
            break
        level = r["p"]
    power = F.floor(F.log2("n_docs"))
    if room >= 0:
        return lines, None
    if level is None:
        return lines.limit(0), lines
    return lines.filter(power >= level), lines.filter(power < level)


def without_frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3,
                           hot_lines: int = HOT_LINES) -> DataFrame:
    """(doc_id, text, n_lines long, n_dropped long): every converted document (doc_id, text) without the lines that many repeat.

    A text is split at line feeds (null or empty: one empty line). A line's key is the line with blanks, tabs and line ends
    stripped at both ends and A-Z in lower case. Keys of at least `min_chars` code points that at least `min_docs` rows hold
    lose all their lines except in the largest doc_id that holds them; the other lines stay, joined by line feeds. Rows
    that repeat an id count as documents of their own and keep or lose a line together; a null id is smaller than every
    other. Other columns are not read; no rows give no rows.

    Decisions for the `hot_lines` most frequent lines travel to the tasks (24 bytes a line); those for the rest meet the
    documents in a join, so their number has no bound.
    """
    import numpy as np

    lines = frequent_lines(docs, min_chars, min_docs, batches, fanout)
    id_type = type_of(docs, "doc_id")
    src = docs.select("doc_id", whole_text("text").alias("text"))
    hot, cold = _split_by_size(lines, hot_lines)
    ids = [*hot.select(*HASH, "last_id").toLocalIterator()]
    keeper = docs.sparkSession.sparkContext.broadcast(
        {np.array([r["h1"], r["h2"]], ">i8").tobytes(): r["last_id"] for r in ids})
    if cold is None:
        src = src.withColumn("drops", F.lit(None).cast("array<binary>"))
    else:
        src = _with_drops(src, cold, min_chars, id_type)

    def work(batch):
        import pyarrow as pa
        last, texts, n_lines, n_dropped = keeper.value, [], [], []
        for i, text, drops in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            rows = text.as_buffer().to_pybytes().split(b"\n")
            drops = set(drops or ())
            stay = []
            for x in rows:
                h = line_hash(x, min_chars)
                if h is None or h not in drops and (h not in last or last[h] == i):
                    stay.append(x)
            texts.append(b"\n".join(stay))
            n_lines.append(len(rows))
            n_dropped.append(len(rows) - len(stay))
        return {"doc_id": batch.column(0), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": n_lines, "n_dropped": n_dropped}

    return map_arrow(src, work, f"doc_id {id_type}, text string, n_lines long, n_dropped long")


def _with_drops(src: DataFrame, lines: DataFrame, min_chars: int, id_type: str) -> DataFrame:
    """`src` with the hashes of those `lines` that each document loses."""
    def work(batch):
        import pyarrow as pa
        found, at = [], []
        for k, text in enumerate(batch.column(1)):
            here = {line_hash(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n")} - {None}
            found += here
            at += [k] * len(here)
        h1, h2 = _halves(found)
        return {"doc_id": batch.column(0).take(pa.array(at, pa.int64())), "hash": pa.array(found, pa.binary()), "h1": h1, "h2": h2}

    held = map_arrow(src, work, f"doc_id {id_type}, hash binary, h1 long, h2 long")
    drops = (held.join(lines, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
             .groupBy("doc_id").agg(F.collect_set("hash").alias("drops")).withColumnRenamed("doc_id", "_doc"))
    return src.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "drops")
