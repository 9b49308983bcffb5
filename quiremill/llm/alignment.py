"""Which tokens of one tokenizer correspond to which of another in converted documents.

Both tokenizers cut the same bytes. The incidence of tokens and bytes is a sparse matrix for each of them, in compressed
rows built here; the product of one with the other's transpose, row by row, holds the overlapping tokens. Where no token of
the second spans two neighbours of the first, both end: there the tokens are cut into groups. The incidence of a
document's token ids and its groups gives, multiplied in the same way, how often two ids share a group.

The links of every document are written once, by id pair; how many documents hold a pair is a sum over them, and travels
back to the documents: the most frequent pairs by broadcast, as many as its bound allows, the others by a join.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_arrow, new_folder, type_of, whole_text, worker_cache

CHUNK_BYTES = 256 << 10
STRETCH = 1 << 20
EXPAND = 4_000_000
HOT_PAIRS = 1_000_000
LONG_BLANKS = re.compile(r"\s{2000}")


class Rows(NamedTuple):
    """A sparse matrix in compressed rows: row r has columns[start[r]:start[r + 1]] with these values."""
    start: object
    columns: object
    values: object
    width: int


def incidence(rows, columns, values, height: int, width: int) -> Rows:
    """Rows from entries (row, column, value) in the order of their rows."""
    import numpy as np
    start = np.zeros(height + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=height), out=start[1:])
    return Rows(start, columns, values, width)


def spans(lengths) -> Rows:
    """Token by byte: token t covers the next lengths[t] bytes."""
    import numpy as np
    start = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return Rows(start, np.arange(start[-1]), np.ones(start[-1], np.int32), int(start[-1]))


def transposed(m: Rows) -> Rows:
    import numpy as np
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    order = np.argsort(m.columns, kind="stable") if (np.diff(m.columns) < 0).any() else slice(None)
    return incidence(m.columns[order], row[order], m.values[order], m.width, len(m.start) - 1)


def _summed(key, value):
    """Equal keys as one, in order, with the sum of their values."""
    import numpy as np
    if not len(key):
        return key, value
    if (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(value, first)


def product(a: Rows, b: Rows, expand: int = EXPAND) -> Rows:
    """a · b, row by row: the entries of a row of `a` gather the rows of `b` they name, and equal columns are summed. About
    `expand` gathered entries are held at a time."""
    import numpy as np
    row = np.repeat(np.arange(len(a.start) - 1), np.diff(a.start))
    size = np.diff(b.start)[a.columns]
    total = np.cumsum(size)
    parts, at = [], 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + expand, "right")))
        n = size[at:end]
        out = np.repeat(b.start[:-1][a.columns[at:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts.append(_summed(np.repeat(row[at:end], n) * b.width + b.columns[out],
                             np.repeat(a.values[at:end].astype(np.int64), n) * b.values[out]))
        at = end
    if not parts:
        return incidence(row, row, row, len(a.start) - 1, b.width)
    key, value = parts[0] if len(parts) == 1 else _summed(*map(np.concatenate, zip(*parts)))
    return incidence(key // b.width, key % b.width, value, len(a.start) - 1, b.width)


def token_groups(size_a, size_b):
    """Group numbers of the tokens of both sides, from their sizes in bytes. The bytes are multiplied in stretches between
    offsets where both sides end."""
    import numpy as np
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    last = shared[np.flatnonzero(np.diff(shared // STRETCH, append=-1))]
    a, b, n, x, y = [], [], 0, 0, 0
    for end in last.tolist():
        i, j = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
        of_a, of_b = groups_of(product(spans(size_a[x:i]), transposed(spans(size_b[y:j]))))
        a.append(of_a + n)
        b.append(of_b + n)
        n, x, y = n + int(of_a[-1]) + 1, i, j
    return np.concatenate(a), np.concatenate(b)


def groups_of(overlap: Rows):
    """Group numbers of the tokens of both sides, in their order: a group ends where both sides end."""
    import numpy as np
    first, last = overlap.columns[overlap.start[:-1]], overlap.columns[overlap.start[1:] - 1]
    a = np.cumsum(np.concatenate([[True], first[1:] != last[:-1]])) - 1
    b = np.zeros(overlap.width, np.int64)
    b[overlap.columns] = np.repeat(a, np.diff(overlap.start))
    return a, b


class Pair:
    """The two tokenizers, their tokens' bytes and the decimal ids with what stands behind them; one for each worker process."""

    def __init__(self, bpe_json: str, pieces_model: str):
        import json

        import numpy as np
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(bpe_json, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in enumerate(_byte_characters())}
        of = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{bpe_json}: the ids do not follow the merges")
        # The file's vocabulary as ranks. Words are the pre-tokenizer's, whose pattern the library fixes.
        self.ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={b: i for i, b in of.items()}, special_tokens={})
        self.whole = Tokenizer.from_file(bpe_json)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
        self.b_bytes = [_piece_bytes(self.pieces, i) for i in range(self.pieces.get_piece_size())]
        self.a_size = np.zeros(max(of) + 1, np.int64)
        for i, b in of.items():
            self.a_size[i] = len(b)
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        self.written = {end: _written(max(len(self.a_size), len(self.b_size)), end) for end in ",|;"}

    def encode(self, text: str):
        """(ids A, ids B) of a text, or None where the tokens' bytes are not those of the text behind a space."""
        import numpy as np
        if not text:
            return None
        spaced = " " + text
        data = spaced.encode()
        # a long run of blanks is too deep a recursion for the pattern's matcher
        a = self.whole.encode(spaced, add_special_tokens=False).ids if LONG_BLANKS.search(text) else self.ranks.encode_ordinary(spaced)
        if self.ranks.decode_bytes(a) != data:
            return None
        b = self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> list[str]:
    """The printable character that stands for every byte in byte-level vocabularies: Latin-1 where it is visible, else one
    counted on from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def _piece_bytes(pieces, i: int) -> bytes:
    piece = pieces.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()


def _written(n: int, end: str):
    """Decimal numbers with `end`, a row of zero-filled bytes each."""
    import numpy as np
    return np.char.add(np.arange(n).astype(str), end).astype("S8").view(np.uint8).reshape(n, 8)


def _align(pair: Pair, texts: list[str | None]):
    """For every text (n_a, n_b, n_groups, n_links, groups, a ids, b ids, links): the distinct linked id pairs with the number
    of their links."""
    import numpy as np
    nothing = np.zeros(0, np.int64)
    out = [(0, 0, 0, 0, b"", nothing, nothing, nothing)] * len(texts)
    encoded = [(k, e) for k, t in enumerate(texts) if (e := pair.encode(t)) is not None]
    if not encoded:
        return out
    a, b = (np.concatenate([e[side] for _, e in encoded]) for side in (0, 1))
    docs = np.arange(len(encoded))
    of_a, of_b = (np.repeat(docs, [len(e[side]) for _, e in encoded]) for side in (0, 1))
    in_a, in_b = token_groups(pair.a_size[a], pair.b_size[b])
    n = int(in_a[-1]) + 1

    # token ids of a document by groups, and groups by token ids
    n_a, n_b = len(pair.a_size), len(pair.b_size)
    key, times = _summed((of_a * n_a + a) * n + in_a, np.ones(len(a), np.int64))
    row_key, row = np.unique(key // n, return_inverse=True)
    ids = incidence(row, key % n, times, len(row_key), n)
    key, times = _summed(in_b * n_b + b, np.ones(len(b), np.int64))
    shared = product(ids, incidence(key // n_b, key % n_b, times, n, n_b))
    a_ids = np.repeat(row_key % n_a, np.diff(shared.start))
    of_link = np.repeat(row_key // n_a, np.diff(shared.start))
    cut = np.searchsorted(of_link, np.arange(len(encoded) + 1))

    order = np.argsort(np.concatenate([in_a * 2, in_b * 2 + 1]), kind="stable")
    ends_a, ends_b = (np.concatenate([g[1:] != g[:-1], [True]]) for g in (in_a, in_b))
    written = np.concatenate([np.where(ends_a[:, None], pair.written["|"][a], pair.written[","][a]),
                              np.where(ends_b[:, None], pair.written[";"][b], pair.written[","][b])])[order]
    text = written[written != 0].tobytes()
    size = np.bincount(np.concatenate([of_a, of_b])[order], (written != 0).sum(1), len(encoded)).astype(np.int64)
    ends = np.cumsum(size)
    count = [np.bincount(x, minlength=len(encoded)) for x in (of_a, of_b)]
    first = np.concatenate([[True], in_a[1:] != in_a[:-1]])
    n_groups = np.bincount(of_a[first], minlength=len(encoded))
    for d, (k, _) in enumerate(encoded):
        s = slice(cut[d], cut[d + 1])
        out[k] = (int(count[0][d]), int(count[1][d]), int(n_groups[d]), int(shared.values[s].sum()), text[ends[d] - size[d]:ends[d] - 1],
                  a_ids[s], shared.columns[s], shared.values[s])
    return out


def aligned(docs: DataFrame, bpe_json: str, pieces_model: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, a, b, links): the alignment of every whole text, one row per row.

    `groups` is text, `a1,a2|b1;a3|b2,b3`, or its SHA-256 with `digest`; `a`, `b` and `links` are arrays of the distinct id
    pairs that share a group and how many pairs of their tokens do.
    """
    import pyarrow as pa

    def lists(arrays):
        import numpy as np
        ends = np.cumsum([0, *map(len, arrays)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int32)))

    def work(batch):
        import hashlib
        pair = worker_cache(("alignment", bpe_json, pieces_model), lambda: Pair(bpe_json, pieces_model))
        found, some, size = [], [], 0
        for text in batch.column(1).to_pylist():
            some.append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                found += _align(pair, some)
                some, size = [], 0
        found += _align(pair, some)
        n_a, n_b, n_groups, n_links, groups, a, b, links = zip(*found)
        if digest:
            groups = [g and hashlib.sha256(g).hexdigest().encode() for g in groups]
        return {"doc_id": batch.column(0), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups": pa.array(groups, pa.binary()).cast(pa.string()), "a": lists(a), "b": lists(b), "links": lists(links)}

    src = docs.select("doc_id", whole_text("text").alias("text"))
    return map_arrow(src, work, f"doc_id {type_of(docs, 'doc_id')}, n_a long, n_b long, n_groups long, n_links long, groups string, "
                                "a array<int>, b array<int>, links array<int>", rows=64)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): how many rows of `links` hold an id pair, and whether no pair of its `a` has more."""
    counts = kept(links.groupBy("a", "b").agg(F.count("*").alias("n_docs")))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _hot(counts: DataFrame, hot_pairs: int) -> int:
    """The least power of two from which at most `hot_pairs` pairs are that frequent."""
    level = F.length(F.bin("n_docs")) - 1
    room, least = hot_pairs, 62
    for r in counts.groupBy(level.alias("p")).count().orderBy(F.desc("p")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["p"]
    return 1 << least


def align_tokens(docs: DataFrame, bpe_json: str, pieces_model: str, digest: bool = False, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): how the tokens of two tokenizers line up in every
    converted document (doc_id, text), one row per row.

    A, a byte-level vocabulary in a tokenizer file, encodes a space and the text; B, a piece model that adds the space
    itself, the text; special tokens' strings are plain text. A text that is null or empty, or whose joined tokens are not
    the bytes of space and text, has no tokens: zeros and the empty `groups`. Byte offsets where tokens of both end cut them
    into groups, and two tokens that share a group are linked. An id pair's count is the number of rows of `docs` that hold
    it linked; `n_best` are the links whose pair has the highest count of its A id (ties too), `count_sum` is the sum of
    the counts over the links. `groups` is `a1,a2|b1;a3|b2,b3` in decimal ids, or its SHA-256 with `digest`. Ids may be null
    or repeat; other columns are not read; no rows give no rows.

    Broadcast are at most `hot_pairs` id pairs, the most frequent; the others are joined, and none of them is frequent.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "alignment")
    (aligned(docs, bpe_json, pieces_model, digest).withColumn("row", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(path))
    stored = spark.read.parquet(path)
    links = stored.select("row", F.explode(F.arrays_zip("a", "b", "links")).alias("l")).select("row", "l.*")
    counts = kept(pair_counts(links))
    least = _hot(counts, hot_pairs)
    hot, cold = F.broadcast(counts.filter(F.col("n_docs") >= least)), counts.filter(F.col("n_docs") < least)

    def sums(met):
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0).cast("long")).alias("n_best"),
                                      F.sum(F.col("n_docs") * F.col("links")).alias("count_sum"))

    found = sums(links.join(hot, ["a", "b"]))
    if least > 1:
        found = found.unionByName(sums(links.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(cold, ["a", "b"])))
        found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.join(found, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
