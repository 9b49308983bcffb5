import gzip
import hashlib
import random
from collections import Counter

import pytest
from common_cases import ROWS, awkward, empty, files_of
from pyspark.sql import functions as F

from quiremill.llm import archives as A
from quiremill.llm.common import new_folder


def test_loser_tree_merges():
    rnd = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rnd.randint(0, 50) for _ in range(rnd.randint(0, 30))) for _ in range(k)]
        assert list(A.LoserTree(runs, lambda v: v)) == sorted(v for r in runs for v in r)


@pytest.mark.parametrize("url,key", [("http://www.Example.com:80/A?b=C#d", "com,example)/a?b=c"), ("https://x.org", "org,x)/"), ("", ")/"),
                                     ("//u@h.de/p", "de,h)/p")])
def test_url_keys(url, key):
    assert A.url_key(url) == key


def plain(rows, min_bytes=100):
    """(id, bytes, digest, type, refers_to) by the rule: rows (id, text)."""
    first = {}
    for i, t in rows:
        p = (t or "").encode()
        if len(p) >= min_bytes and i is not None:
            first[p] = min(first.get(p, i), i)
    out = Counter()
    for i, t in rows:
        p = (t or "").encode()
        refers = first[p] if i is not None and p in first and i > first[p] else None
        out[(i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if refers is not None else "response", refers)] += 1
    return out


def found(df):
    return Counter((r.file_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_awkward_files(spark):
    assert found(A.archive_files(files_of(awkward(spark)), new_folder(spark, "warc"))) == plain(ROWS)
    assert A.archive_files(files_of(empty(spark)), new_folder(spark, "warc")).count() == 0


def test_payloads_that_look_like_records(spark):
    texts = ["WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5, "\r\n\r\n" * 60, "\n", "é" * 60, "x" * 99, "x" * 99, "y" * 100, "y" * 100]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "file_id long, content string").select(
        "*", F.lit("http://h/a b\r\nWARC-Type: fake").alias("name"), F.lit(None).cast("timestamp").alias("mtime"))
    got = A.archive_files(df, new_folder(spark, "warc"))
    assert found(got) == plain(rows) and {r.url_key for r in got.collect()} == {"h)/a%20b%0d%0awarc-type:%20fake"}
    raw = df.withColumn("content", F.unhex(F.lit("FF00FE0D0A" * 30)))
    assert found(A.archive_files(raw, new_folder(spark, "warc"))).total() == len(rows)


def test_history_is_in_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    df = pages.selectExpr("page_id file_id", "if(page_id % 3 = 0, 'http://hot.example/', url) name", "timestamp_seconds(1600000000 - page_id) mtime", "html content")
    folder = new_folder(spark, "warc")
    got = A.archive_files(df.repartition(5), folder)
    rows = [(r.url_key, r.captured, r.file_id) for r in got.collect()]
    assert rows == sorted(rows) and len(rows) == df.count()
    one = next(iter(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).limit(1).collect()))
    records = list(A.records(A.unpacked(one.content, 1000)))
    assert records and all(h["WARC-Type"] in ("response", "revisit") for _, h, _ in records)


def test_a_changed_archive_is_noticed():
    with pytest.raises(ValueError):
        list(A.records([b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"]))
    with pytest.raises(ValueError):
        list(A.unpacked(gzip.compress(b"abc" * 100)[:-9]))


def test_records_are_read_in_pieces():
    """Records across the borders of parts and gzip members; one record and one part are all that is held."""
    rnd = random.Random(2)
    blocks = [bytes(rnd.choice(b"\r\nab") for _ in range(rnd.choice([0, 1, 7, 3000]))) for _ in range(60)]
    made = [b"WARC/1.1\r\nContent-Length: %d\r\nX: y\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in blocks]
    want = [(sum(map(len, made[:i])), x) for i, x in enumerate(blocks)]
    for packed in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))):
        for piece in (1, 5, 4096, 1 << 20):
            assert [(at, x) for at, _, x in A.records(A.unpacked(packed, piece))] == want
    assert list(A.records([])) == [] and list(A.records([b""])) == []


def test_memory_is_that_of_a_record():
    """An archive of 60 MB with records of 100 KB is read within a few MB."""
    import tracemalloc
    record = b"WARC/1.1\r\nContent-Length: 100000\r\n\r\n" + b"x" * 100_000 + b"\r\n\r\n"
    packed = gzip.compress(record * 600, 1)
    tracemalloc.start()
    assert sum(1 for _ in A.records(A.unpacked(packed))) == 600
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_archives_are_cut_by_bytes(spark):
    df = spark.range(0, 300, 1, 1).select(F.col("id").alias("file_id"), F.lit("http://h/").alias("name"), F.lit(None).cast("timestamp").alias("mtime"),
                                          F.concat(F.repeat(F.lit("x"), 1_000_000), F.col("id")).alias("content"))
    folder = new_folder(spark, "warc")
    A.write_archives(df, folder)
    entries = A.read_archives(spark, folder)
    assert entries.groupBy("archive").agg(F.sum("payload_bytes").alias("n")).filter(f"n > {A.ARCHIVE_BYTES}").isEmpty() and entries.count() == 300


def test_ranges_grow_with_the_entries(spark):
    df = spark.range(0, 600, 1, 4).select(F.col("id").alias("file_id"), F.lit("http://hot.example/").alias("name"),
                                          F.timestamp_seconds(F.col("id") % 7).alias("mtime"), F.col("id").cast("string").alias("content"))
    folder = new_folder(spark, "warc")
    A.write_archives(df, folder, records_per_file=40)
    got = A.capture_history(A.read_archives(spark, folder), range_entries=50)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    rows = [(r.url_key, r.captured, r.file_id) for r in got.collect()]
    assert len(sizes) >= 9 and max(sizes) <= 200 and rows == sorted(rows) and len(rows) == 600
