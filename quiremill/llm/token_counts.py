"""Token counts of converted documents that are kept up to date under edits.

A document's text is cut into leaves at blanks where every pre-token pattern of this kind begins a new match, so leaves can
be counted apart. Over the leaves stands a segment tree of sums of characters and tokens. An edit re-encodes the leaf it
touches and, where it breaks the border to a neighbour, that neighbour as well; the sums above change by the differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, _shared
from .common import map_arrow, type_of, whole_text, worker_cache

LEAF = 256


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """The text in leaves of at least `size` characters (but the last), cut before single blanks between two words."""
    out, at = [], 0
    while at < len(text):
        cut = at + size
        while cut < len(text) and not border(text, cut):
            cut = text.find(" ", cut + 1)
            if cut < 0:
                cut = len(text)
        out.append(text[at:cut])
        at = cut
    return out


def border(text: str, at: int) -> bool:
    """Whether a match surely begins at `at`: a single blank between two characters other than white space."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


class TokenTree:
    """Segment tree over the leaves of one document."""

    def __init__(self, leaves: list[str], tokens: list[int], count):
        self.leaves, self.count, self.encoded = list(leaves), count, 0
        self.n = max(1, len(leaves))
        self.chars, self.tokens = [0] * (2 * self.n), [0] * (2 * self.n)
        for i, (leaf, k) in enumerate(zip(leaves, tokens)):
            self.chars[self.n + i], self.tokens[self.n + i] = len(leaf), k
        for i in range(self.n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        if not leaves:
            self.leaves = [""]

    def total(self) -> int:
        return sum(self.tokens[self.n:]) if self.n == 1 else self.tokens[1]

    def before(self, leaf: int) -> int:
        """Characters before a leaf, from the sums above it."""
        i, out = self.n + leaf, 0
        low, high = self.n, i
        while low < high:
            if low & 1:
                out += self.chars[low]
                low += 1
            if high & 1:
                high -= 1
                out += self.chars[high]
            low //= 2
            high //= 2
        return out

    def leaf_at(self, pos: int) -> int:
        """The last leaf that begins at or before `pos`."""
        lo, hi = 0, len(self.leaves) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.before(mid) <= pos:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def set(self, leaf: int, text: str, tokens: int) -> None:
        i = self.n + leaf
        dc, dt = len(text) - self.chars[i], tokens - self.tokens[i]
        self.leaves[leaf] = text
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def replace(self, begin: int, end: int, text: str) -> None:
        """Characters [begin, end) of the present text become `text`; places behind the end are taken as the end."""
        size = sum(self.chars[self.n:]) if self.n == 1 else self.chars[1]
        begin, end = min(max(begin, 0), size), min(max(end, begin, 0), size)
        first, last = self.leaf_at(begin), self.leaf_at(end)
        at = self.before(first)
        joined = "".join(self.leaves[first:last + 1])
        joined = joined[:begin - at] + text + joined[end - at:]
        # boundary context: neighbours whose border with the new text is not sure any more join it
        while first > 0 and not self._sure(self._back(first), joined):
            first -= 1
            joined = self.leaves[first] + joined
        while last + 1 < len(self.leaves) and not self._sure(joined, self._on(last + 1)):
            last += 1
            joined += self.leaves[last]
        self.encoded += len(joined)
        self.set(first, joined, self.count(joined))
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self.set(i, "", 0)

    def _back(self, leaf: int) -> str:
        """Text just before a leaf: the nearest leaf that is not empty."""
        return next((self.leaves[i] for i in range(leaf - 1, -1, -1) if self.leaves[i]), "")

    def _on(self, leaf: int) -> str:
        return next((self.leaves[i] for i in range(leaf, len(self.leaves)) if self.leaves[i]), "")

    @staticmethod
    def _sure(left: str, right: str) -> bool:
        return not left or not right or len(right) > 1 and border(left[-1] + right[:2], 1)


def token_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, leaves array<string>, leaf_tokens array<int>, n_tokens long): the state of every document's tree, one row per
    row of `docs` (doc_id, text); null or empty text has no leaves. Other columns are not read."""
    shared, key = _shared(docs, ranks_path, pattern)

    def work(batch):
        c = worker_cache(("bpe", key), lambda: Codec(shared.value, pattern))
        leaves = [leaves_of(t) for t in batch.column(1).to_pylist()]
        counts = [[len(c.encode(x)) // 4 for x in ls] for ls in leaves]
        return {"doc_id": batch.column(0), "leaves": leaves, "leaf_tokens": counts, "n_tokens": [sum(n) for n in counts]}

    src = docs.select("doc_id", whole_text("text").alias("text"))
    return map_arrow(src, work, f"doc_id {type_of(docs, 'doc_id')}, leaves array<string>, leaf_tokens array<int>, n_tokens long")


def apart(edits: list[dict], size: int) -> list[tuple[int, int, str]]:
    """(begin, end, text) without overlaps for edits in order of (begin, end) of a text of `size` characters: each takes what
    it or one before it covers, up to the next one's begin."""
    out, upto = [], 0
    for e, after in zip(edits, [*edits[1:], None]):
        begin, upto = min(e["begin"], size), max(upto, min(e["end"], size))
        end = max(begin, upto if after is None else min(upto, after["begin"]))
        if e["text"] or end > begin:
            out.append((begin, end, e["text"]))
    return out


def recount(trees: DataFrame, edits: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, leaves, leaf_tokens, n_tokens long, n_before long, n_edits int, n_left_out int, chars_encoded long): the
    trees after the edits.

    `edits` (doc_id, begin, end, text and, if they have an order, seq) replace the characters [begin, end) of the text that
    the tree stands for, null text by nothing. Places count in the text before any edit, those outside it as its nearer end.
    All edits are applied: what any of them covers goes, every text stands at its own begin; at one place first the
    insertions by (seq, text), then the replacements by their end. Only rows for the same characters [begin, end) are
    versions of one replacement: the least text is taken, n_left_out counts the others. Documents without edits keep their
    tree as it is; edits of unknown or null documents, or with null places, change nothing. Documents with the same id get
    the same edits.
    """
    shared, key = _shared(trees, ranks_path, pattern)
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    placed = edits.dropna(subset=["doc_id", "begin", "end"]).select(
        F.col("doc_id").alias("_id"), F.greatest(F.col("begin").cast("long"), F.lit(0)).alias("begin"), F.col("end").cast("long").alias("end"),
        F.coalesce("text", F.lit("")).alias("text"), seq.alias("seq")).withColumn("end", F.greatest("begin", "end")).repartition("_id")
    inserts = F.col("begin") == F.col("end")
    one = placed.groupBy("_id", "begin", "end").agg(
        F.sort_array(F.collect_list(F.when(inserts, F.struct("seq", "text")))).alias("all"), F.min("text").alias("least"), F.count("*").alias("rows"))
    merged = F.when(inserts, F.array_join(F.col("all.text"), "")).otherwise(F.col("least"))
    lists = one.select("_id", "begin", "end", merged.alias("text"), "rows").groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end", "text", "rows"))).alias("edits"))
    met = trees.join(lists, trees["doc_id"] == F.col("_id"), "left").select("doc_id", "leaves", "leaf_tokens", "n_tokens", "edits")

    def work(batch):
        c = worker_cache(("bpe", key), lambda: Codec(shared.value, pattern))
        out = []
        for i, leaves, tokens, n, es in zip(*[col.to_pylist() for col in batch.columns]):
            if not es:
                out.append((i, leaves, tokens, n, n, 0, 0, 0))
                continue
            tree = TokenTree(leaves, tokens, lambda t: len(c.encode(t)) // 4)
            for begin, end, text in reversed(apart(es, sum(map(len, leaves)))):
                tree.replace(begin, end, text)
            versions = sum(e["rows"] - 1 for e in es if e["end"] > e["begin"])
            left = [(t, k) for t, k in zip(tree.leaves, tree.tokens[tree.n:]) if t]
            out.append((i, [t for t, _ in left], [k for _, k in left], tree.total(), n, sum(e["rows"] for e in es) - versions, versions, tree.encoded))
        return dict(zip(NAMES, map(list, zip(*out))))

    return map_arrow(met, work, f"doc_id {type_of(trees, 'doc_id')}, leaves array<string>, leaf_tokens array<int>, n_tokens long, "
                     "n_before long, n_edits int, n_left_out int, chars_encoded long")


NAMES = ["doc_id", "leaves", "leaf_tokens", "n_tokens", "n_before", "n_edits", "n_left_out", "chars_encoded"]
