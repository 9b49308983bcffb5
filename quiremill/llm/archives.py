"""WARC archives of collected files: written by Spark's text writer, read back, indexed by one global order of captures.

A record is one row of text: WARC header, blank line, HTTP header, blank line, payload; the writer's line separator is the
two line ends that close a record. Equal payloads are stored once: the others are revisit records. Reading gives one
locally sorted run of index entries for each archive; runs are dealt out by ranges of (URL key, time), pieces of runs as they
are sorted, and merged there with a loser tree, so every URL's captures stand together in the order of time. The number of
ranges grows with the entries, so a range has a bounded number of them; a record is the most that is held of an archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_arrow, type_of

CRLF = "\r\n"
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
RANGE_ENTRIES = 50_000
# Fixed value: the profile of revisit records in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_of(content: Column) -> Column:
    return F.coalesce(content.cast("binary"), F.lit(b""))


def record_roles(files: DataFrame, min_bytes: int = 100) -> DataFrame:
    """`files` with payload_digest, payload_bytes and refers_to: the smallest file_id with an equal payload, for a file that
    is not that one; null for payloads under `min_bytes`, single payloads and the first itself."""
    rows = (files.withColumn("_p", payload_of(F.col("content")))
            .withColumns({"payload_digest": F.sha2("_p", 256), "payload_bytes": F.octet_length("_p").cast("long")}).drop("_p"))
    first = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.min("file_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("payload_digest", "_first"))
    return rows.join(first, "payload_digest", "left").withColumn(
        "refers_to", F.when(F.col("file_id") > F.col("_first"), F.col("_first"))).drop("_first")


def _header(c: Column) -> Column:
    """A value on one line: control characters and blanks are percent-encoded."""
    out = F.coalesce(c, F.lit(""))
    for code in (0x09, 0x0A, 0x0D, 0x20):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(out, r"[\x00-\x20\x7F]", "%00")


def write_archives(files: DataFrame, path: str, min_bytes: int = 100, records_per_file: int | None = None) -> None:
    """Writes gzip-compressed WARC 1.1 archives of `files` (file_id, name, mtime timestamp, content) under `path`.

    Each row is one record: a response with its payload, or a revisit of the equal payload with the smallest file_id
    (payloads of at least `min_bytes`; null content is an empty payload). A null name or time is left empty; a row
    without an id is always a response. Rows that repeat an id are written each. Other columns are not read. An archive
    has at most ARCHIVE_RECORDS records, and of payloads of average size no more than ARCHIVE_BYTES.
    """
    if records_per_file is None:
        mean = files.agg(F.avg(F.octet_length(payload_of(F.col("content"))))).first()[0] or 0
        records_per_file = max(1, min(ARCHIVE_RECORDS, int(ARCHIVE_BYTES / (mean + 500))))
    r = record_roles(files.select("file_id", "name", "mtime", "content"), min_bytes)
    revisit = F.col("refers_to").isNotNull()
    rid = lambda c: F.concat(F.lit("<urn:file:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), rid("file_id"),
        F.lit(f"{CRLF}WARC-Date: "), F.coalesce(F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("")),
        F.lit(f"{CRLF}WARC-Target-URI: "), _header(F.col("name")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), rid("refers_to"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2), http)
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("content").cast("string"), F.lit("")))
    (r.select(F.concat(head, body).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def url_key(url: str) -> str:
    """Sort key of a URL: host parts from the top domain down, then path and query in lower case."""
    import re
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url, re.I)
    host, rest = m[1].lower(), m[2].lower()
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def records(parts):
    """(offset, headers, block) of every record of an archive whose uncompressed bytes come in parts; one record and one
    part are held at a time."""
    parts = iter(parts)
    held, at = bytearray(), 0

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while held or more():
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if not held:
                    return
                raise ValueError(f"the record at {at} has no end of its header")
        headers = dict(h.split(": ", 1) for h in held[:end].decode("utf-8", "replace").split(CRLF)[1:])
        begin = end + 4
        stop = begin + int(headers["Content-Length"])
        while len(held) < stop + 4 and more():
            pass
        if held[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield at, headers, bytes(held[begin:stop])
        del held[:stop + 4]
        at += stop + 4


def unpacked(packed, piece: int = 1 << 20):
    """The uncompressed bytes of gzip members in parts of about `piece` bytes."""
    import zlib
    rest = memoryview(packed)
    while len(rest):
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.decompress(rest, piece)
            if not data and not z.unconsumed_tail and not z.eof:
                raise ValueError("the archive is cut off")
            yield data
            rest = memoryview(z.unconsumed_tail)
        rest = memoryview(z.unused_data)


ENTRY = ("url_key string, captured string, {id}, name string, record_type string, payload_bytes long, payload_digest string, "
         "refers_to {kind}, archive string, offset long")


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Index entries of the archives under `path`, one for each record; each archive's entries are a sorted run.

    For a response, bytes and digest are those of the payload that was read; a stored digest that differs fails. A revisit
    has those of its header. A record without an id has a null file_id; equal records are an entry each; a folder without
    archives has no entries. A task holds one compressed archive, one of its records and its entries.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def as_id(v: str):
        v = v.removeprefix("<urn:file:").removesuffix(">")
        return (None if not v else int(v)) if id_type in ("bigint", "int") else v

    def work(batch):
        import hashlib
        rows = []
        for name, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            name, run = name.rsplit("/", 1)[-1], []
            for at, h, block in records(unpacked(packed.as_buffer())):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                n = int(head.rpartition(b"Content-Length: ")[2])
                if h["WARC-Type"] == "response":
                    found = hashlib.sha256(payload).hexdigest()
                    if found != digest or len(payload) != n:
                        raise ValueError(f"{name}, record at {at}: the payload is not what was written")
                refers = as_id(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                url = h["WARC-Target-URI"]
                run.append((url_key(url), h["WARC-Date"], as_id(h["WARC-Record-ID"]), url, h["WARC-Type"], n, digest, refers, name, at))
            run.sort(key=_order)
            rows += run
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    ddl = ENTRY.format(id=f"file_id {id_type}", kind=id_type)
    names = [c.split()[0] for c in ddl.split(", ")]
    return map_arrow(files, work, ddl, rows=1)


def _order(row):
    """URL key, time, id (null first), place."""
    return (row[0], row[1], row[2] is not None, 0 if row[2] is None else row[2], row[8], row[9])


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, so a new head plays one match per level."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _better(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its match
                self.losers[node] = winner
                return
            if self._better(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.keys[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            self._play(i)


def capture_history(entries: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """All index entries in one global order of (url_key, captured, file_id): the partitions are ranges of it, in order.

    The runs' entries are dealt out by range, about `range_entries` to each, so a host or URL that fills a third of the index
    is still spread; equal entries are told apart by archive and offset. A run's piece of a range arrives as it was sorted
    (a recomputed one that does not is put in order), and the pieces are merged by a loser tree. Null ids come first among
    equal keys and times; no entries give no rows.
    """
    import pyarrow as pa

    entries = kept(entries)
    width = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // range_entries))
    pieces = entries.repartitionByRange(width, "url_key", "captured", "file_id", "archive", "offset")

    def merge(batches):
        runs: dict[str, list] = {}
        schema = None
        for b in batches:
            schema = b.schema
            for r in zip(*[c.to_pylist() for c in b.columns]):
                runs.setdefault(r[8], []).append(r)
        for run in runs.values():
            if any(_order(x) > _order(y) for x, y in zip(run, run[1:])):
                run.sort(key=_order)
        out = []
        for r in LoserTree(list(runs.values()), _order):
            out.append(r)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return pieces.mapInArrow(merge, entries.schema)


def archive_files(files: DataFrame, path: str, min_bytes: int = 100) -> DataFrame:
    """Writes `files` to archives under `path`, reads these back and returns their capture history (`ENTRY`)."""
    write_archives(files, path, min_bytes)
    return capture_history(read_archives(files.sparkSession, path, type_of(files, "file_id")))
