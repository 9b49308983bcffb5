"""Passages of many words that stand in more than one converted document, by a sparse suffix array.

Only suffixes at content-selected places are kept: a place is a minimiser if the hash of its next `gram` words is the least
of `window` neighbouring ones, with window + gram - 1 = min_words, so any passage of min_words words holds the same
minimiser wherever it stands. Suffixes are sorted and neighbours of different documents compared; the match is extended to
the right and to the left of the minimiser, over as many words as decide whether it is long enough: what lies beyond
belongs to the next minimiser of the passage, and touching matches are joined.
Suffixes are first sorted by the hash of their gram alone, as narrow rows; only those with an equal neighbour get their
surrounding words and are sorted again by what follows. Where a gram has more than two suffixes, a shared passage need not
show between neighbours (another document may share more behind the gram but less before it): the windows of min_words
words around the gram that neighbours leave open are grouped by hash, and those of two documents are shared. All sorts are
over ranges that may cut a group of equal suffixes, so no passage is too common; at the cuts every window counts as open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, new_folder, type_of, whole_text, worker_cache

WIDTH = 4  # bytes that stand for a word in a comparison
MEMO = 300_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash
        v = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = v
        return v


def word_hashes(text: str):
    import numpy as np
    words = text.split()
    return np.fromiter(map(worker_cache("repeat words", _Hashes).__getitem__, words), np.uint64, len(words))


def minimisers(h, window: int, gram: int):
    """(places, gram hashes) of the retained suffixes of a text, given its word hashes."""
    import numpy as np
    n = len(h) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), base)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]))
    g = (sums[gram:] - sums[:n]) * back
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xC2B2AE3D27D4EB4F)
    g ^= g >> np.uint64(29)
    least = _sliding(g, window, np.minimum)
    widest = _sliding(np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]), window, np.maximum)
    at = np.flatnonzero(widest == g)  # the least of some window it stands in
    return at, g[at]


def _sliding(x, width: int, best):
    """best(x[i:i + width]) for every i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:len(out) - step], out[step:])
        have += step
    return out


def _written(df: DataFrame) -> DataFrame:
    """The rows, written once as compressed columns: a checkpoint keeps whole rows uncompressed."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "repeats")
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def suffix_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram long, doc long, place int) of every retained suffix; `docs` (doc, text)."""
    import numpy as np
    import pyarrow as pa

    def work(batch):
        found = [minimisers(word_hashes(t), window, gram) for t in batch.column(1).to_pylist()]
        n = [len(p) for p, _ in found]
        return {"gram": pa.array(np.concatenate([g for _, g in found]).view(np.int64)),
                "doc": pa.array(np.repeat(batch.column(0).to_numpy(), n)),
                "place": pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))}

    return map_arrow(docs.select("doc", "text"), work, "gram long, doc long, place int")


def _shared_suffixes(rows: DataFrame, width: int) -> DataFrame:
    """(doc, place, gram) of suffixes with an equal gram next to them in sorted order, or at the end of a range."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            g = new.column("gram").to_numpy()
            same = g[1:] == g[:-1]
            keep = np.zeros(len(g), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held is None:
                keep[0] = True  # the range before may end with the same gram
            elif seen_equal:
                keep[0] = True
            out = new.slice(0, len(g) - 1).filter(pa.array(keep[:-1]))
            yield from out.combine_chunks().to_batches()
            held, seen_equal = new.slice(len(g) - 1).combine_chunks(), bool(keep[-1])
        if held is not None:
            yield from held.to_batches()

    return (rows.repartitionByRange(width, "gram", "doc", "place").sortWithinPartitions("gram", "doc", "place")
            .mapInArrow(work, "gram long, doc long, place int"))


def _with_context(docs: DataFrame, places: DataFrame, gram: int, reach: int) -> DataFrame:
    """(gram, doc, places array<int>, after binary, before binary): up to `reach` words behind the gram and, last first,
    before it. Places of a document with the same words around them are one row, so a text that repeats itself stays small."""
    import numpy as np

    lists = places.groupBy("doc").agg(F.collect_list(F.struct("place", "gram")).alias("at"))  # a document's own places
    met = docs.join(lists, "doc")

    def work(batch):
        rows = []
        for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            h = word_hashes(text).astype(">u4")
            turned, alike = h[::-1], {}
            for p in at:
                i = p["place"]
                key = (p["gram"], h[i + gram:i + gram + reach].tobytes(), turned[len(h) - i:len(h) - i + reach].tobytes())
                alike.setdefault(key, []).append(i)
            rows += [(g, doc, sorted(places), after, before) for (g, after, before), places in alike.items()]
        names = ("gram", "doc", "places", "after", "before")
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    return map_arrow(met.select("doc", "text", "at"), work, "gram long, doc long, places array<int>, after binary, before binary", rows=64)


def common_words(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n * 8 - x.bit_length()) // (8 * WIDTH)


class _Neighbours:
    """Compares each suffix of a run sorted by (gram, what follows, ...) with the nearest one of another document on either side.

    `spare` words are wanted besides the gram; window r has r of them behind it and the others before. No suffix of another
    document has more words behind the gram in common than one of these neighbours, so what is still open about a suffix are
    its windows with at most so many words behind. Their hashes go into `rows`, but not those shared with the neighbour in
    front: that one, or one before it, has handed in the same window. Where a gram has two suffixes, nothing is open.
    """

    def __init__(self, spare: int):
        self.spare = spare
        self.run: list[list] = []  # the latest suffixes of one document, all behind `other`: [row, words behind, shared, shared in front]
        self.other: list | None = None
        self.waits: list[list] = []  # finished suffixes of a gram of which there are no more than two so far
        self.n, self.first = 0, True  # suffixes of this gram; is it the first gram, which may have begun in the range before
        self.start = True  # has no other document come so far
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        if self.run and self.run[-1][0][0] != row[0]:
            self.end()
            self.first = self.start = False
        new = [row, self.spare if self.start else 0, 0, 0]
        if self.run and self.run[-1][0][1] != row[1]:
            new[1], self.start = 0, False
            for r in self.run:
                self.compare(r, new)
            self.finish(([] if self.other is None else [self.other]) + self.run[:-1])
            self.other, self.run = self.run[-1], []
        elif self.other is not None:
            self.compare(self.other, new)
        self.run.append(new)
        self.n += 1

    def compare(self, a: list, b: list) -> None:
        right, left = common_words(a[0][3], b[0][3]), common_words(a[0][4], b[0][4])
        a[1], b[1] = max(a[1], right), max(b[1], right)
        if left + right >= self.spare:
            windows = (2 << right) - (1 << self.spare - left)
            a[2], b[2], b[3] = a[2] | windows, b[2] | windows, b[3] | windows

    def end(self, cut: bool = False) -> None:
        """The gram ends, or, if `cut`, goes on in the next range."""
        if cut:
            for r in self.run:
                r[1] = self.spare
        self.finish(([] if self.other is None else [self.other]) + self.run)
        for r in self.waits:
            self.tell(r, self.first or cut)
        self.run, self.other, self.waits, self.n = [], None, [], 0

    def finish(self, records: list[list]) -> None:
        self.waits += records
        if self.n > 2 or self.first:
            for r in self.waits:
                self.tell(r, True)
            self.waits = []

    def tell(self, record: list, open_windows: bool) -> None:
        (gram, doc, places, after, before), right, shared, front = record
        hashes, windows = [], []
        if open_windows:
            import xxhash
            for r in range(max(0, self.spare - len(before) // WIDTH), min(right, len(after) // WIDTH) + 1):
                if not front >> r & 1:
                    h = xxhash.xxh64_intdigest(bytes([r]) + after[:WIDTH * r] + before[:WIDTH * (self.spare - r)], gram & 0xFFFFFFFFFFFFFFFF)
                    hashes.append(h - (h >> 63 << 64))
                    windows.append(2 * r + (shared >> r & 1))
        if shared or hashes:
            least, most = ((shared & -shared).bit_length() - 1, shared.bit_length() - 1) if shared else (None, None)
            self.rows.append((doc, gram, places, least, most, hashes, windows))


def _matches(rows: DataFrame, gram: int, spare: int, width: int) -> DataFrame:
    """(doc, first_word, end_word) of every place around which min_words words stand in another document as well: from the
    first to the last word of such windows, which all hold the gram."""
    import pyarrow as pa

    order = ["gram", "after", "before", "doc"]
    sorted_rows = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).select("gram", "doc", "places", "after", "before")
    ddl = "doc long, gram long, places array<int>, least int, most int, hashes array<long>, windows array<int>"
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def told(side):
        out, side.rows = side.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in ddl.split(", ")])

    def work(batches):
        side = _Neighbours(spare)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                side.add(row)
                if len(side.rows) >= 2048:
                    yield told(side)
        side.end(cut=True)
        yield told(side)

    found = _written(sorted_rows.mapInArrow(work, ddl))
    one = found.filter("size(hashes) > 0").select("doc", "gram", "places", F.explode(F.arrays_zip("hashes", "windows")).alias("w")).select(
        "doc", "gram", "places", F.col("w.hashes").alias("hash"), F.shiftright("w.windows", 1).alias("r"), (F.col("w.windows") % 2).alias("shared"))
    # a window two documents share, or one that a suffix shares with its neighbour
    common = one.groupBy("gram", "hash").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("shared").alias("shared")).filter(
        "a <> b or shared = 1").select("gram", "hash")
    more = one.filter("shared = 0").join(common, ["gram", "hash"], "left_semi").select("doc", "places", F.col("r").alias("least"), F.col("r").alias("most"))
    both = found.filter("least is not null").select("doc", "places", "least", "most").unionByName(more)
    return both.select("doc", F.explode("places").alias("p"), "least", "most").select(
        "doc", (F.col("p") - spare + F.col("least")).alias("first_word"), (F.col("p") + gram + F.col("most")).alias("end_word"))


def repeated_passages(docs: DataFrame, min_words: int = 50, window: int = 25) -> DataFrame:
    """(doc_id, first_word int, end_word int, n_words int): the stretches of every document (words first_word to end_word,
    end excluded) that are covered by passages of at least `min_words` words standing in another document as well.

    `docs` (doc_id, text); words are what white space separates, compared exactly by their hashes. Rows with the same id and
    text are one document, rows with null ids and different texts are different ones. Every such passage is found, whatever
    else repeats near it. Null, empty and short texts have no passages. Other columns are not read.
    """
    gram = min_words - window + 1
    reach = window - 1
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select("doc_id", whole_text("text").alias("text")).withColumn(
        "doc", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    rows = _written(suffix_rows(named, window, gram))
    shared = _shared_suffixes(rows, width)
    context = _written(_with_context(named.select("doc", "text"), shared, gram, reach))
    spans = _matches(context, gram, reach, width).groupBy("doc", "first_word").agg(F.max("end_word").alias("end_word"))
    w = Window.partitionBy("doc").orderBy("first_word")
    upto = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col("first_word") <= upto, 0).otherwise(1)).withColumn("_no", F.sum("_new").over(w))
    joined = islands.groupBy("doc", "_no").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    ids = named.select("doc", "doc_id").join(joined, "doc")
    return ids.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"))
