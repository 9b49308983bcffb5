"""How far the vocabulary of converted documents differs between the file categories they come from.

Two passes over the documents. The first counts in how many documents of its language a term occurs; exact sums are
filtered, so the kept terms are known before anything is counted by category. The kept terms of a language are dealt to
shards of bounded size, and a task for each shard builds a minimal perfect hash of its terms: levels of bits, in which a
term stands at the first level where no other falls on its place; its slot is the number of set bits before it. The hashes
and the terms in the order of their slots are broadcast in blocks of bounded size. The second pass looks every term up,
compares it with the stored one and adds to a dense array of slots for each (language, category); Spark sums the arrays.

A category's probability of a term is a whole number of parts in 10^9, so all sums are exact.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, map_arrow, whole_text

MIN_DOCS, TOP_TERMS = 30, 50
SHARD_TERMS = 16_384
BLOCK_TERMS, BLOCK_BYTES = 2_000_000, 32 << 20
FLUSH_TERMS, FLUSH_SLOTS = 300_000, 8_000_000
TILE_TERMS, TILE_GROUPS = 4_096, 256
PARTS, PRIOR = 1_000_000_000, 5
SEED = 42  # that of Spark's xxhash64

# Letters stay, A-Z in lower case; the other ASCII characters part terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of characters other than ASCII non-letters, only A-Z in lower case, of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(whole_text("lang").alias("lang"), whole_text("category").alias("category"), whole_text("text").alias("text"))


def frequent_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n_docs): the terms that at least `min_docs` documents of their language hold; exact."""
    import pyarrow as pa

    def run(batches):
        found: dict[str, Counter] = {}

        def rows():
            for lang, counts in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, Counter()).update(set(terms_of(text.as_buffer().to_pybytes())))
                if sum(map(len, found.values())) >= FLUSH_TERMS:
                    yield from rows()
                    found.clear()
        yield from rows()

    per = _inputs(docs).select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return per.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _place(h, level: int, size: int):
    """Place of every hash at a level."""
    import numpy as np
    x = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def hash_of(term: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(term, SEED)


class PerfectHash:
    """Minimal perfect hash of a set of terms: slots 0 … n-1, each with its term. Terms that share a 64-bit hash, which no
    level parts, follow in a small dictionary."""

    def __init__(self, sizes: list[int], bits: bytes, blob: bytes, ends, rest: int):
        import numpy as np
        self.levels, at = [], 0
        flat = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        rank = np.cumsum(flat, dtype=np.int32) - 1
        for size in sizes:
            self.levels.append((size, flat[at:at + size], rank[at:at + size]))
            at += size
        self.blob, self.ends, self.n = blob, np.concatenate([[0], np.frombuffer(ends, np.int32)]).astype(np.int64), len(ends) // 4
        self.rest = {self.term(s): s for s in range(self.n - rest, self.n)}

    def term(self, slot: int) -> bytes:
        return self.blob[self.ends[slot]:self.ends[slot + 1]]

    @staticmethod
    def build(terms: list[bytes], of=hash_of, load: float = 0.6, levels: int = 48) -> tuple:
        """(sizes, bits, terms in the order of slots as one blob, its ends, number of terms outside the levels)."""
        import numpy as np
        h = np.fromiter(map(of, terms), np.uint64, len(terms))
        left, sizes, bits, order = np.arange(len(terms)), [], [], []
        while len(left) and len(sizes) < levels:
            size = max(8, int(len(left) / load) + 1)
            at = _place(h[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            ok = alone[at]
            order.append(left[ok][np.argsort(at[ok])])
            sizes.append(size)
            bits.append(alone)
            left = left[~ok]
        order = [terms[i] for part in [*order, left] for i in part.tolist()]
        packed = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
        ends = np.cumsum([len(t) for t in order], dtype=np.int32)
        return sizes, packed, b"".join(order), ends.tobytes(), len(left)

    def slots(self, terms: list[bytes], h):
        """Slot of every term, -1 for those that are not in the set: the stored term decides."""
        import numpy as np
        found, open_ = np.full(len(terms), -1, np.int64), np.arange(len(terms))
        for level, (size, bits, rank) in enumerate(self.levels):
            at = _place(h[open_], level, size)
            hit = bits[at]
            found[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        ends, blob = self.ends, self.blob
        lo, hi = ends[found].tolist(), ends[found + 1].tolist()
        for i, (s, a, b) in enumerate(zip(found.tolist(), lo, hi)):
            if s >= 0 and blob[a:b] != terms[i]:
                found[i] = -1
        if self.rest:
            for i in np.flatnonzero(found < 0).tolist():
                found[i] = self.rest.get(terms[i], -1)
        return found


def perfect_hashes(terms: DataFrame, shard_terms: int = SHARD_TERMS, of=hash_of) -> DataFrame:
    """(lang, n_shards, shard, sizes, bits, blob, ends, rest): a perfect hash for each shard of a language's terms."""
    import pandas as pd

    langs = terms.groupBy("lang").agg(F.ceil(F.count("*") / shard_terms).cast("int").alias("n_shards"))
    dealt = terms.select("lang", "term").join(F.broadcast(langs), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("n_shards")).cast("int"))

    def build(part):
        sizes, bits, blob, ends, rest = PerfectHash.build([t.encode() for t in part["term"]], of)
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "n_shards": part["n_shards"].iloc[:1], "shard": part["shard"].iloc[:1],
                             "sizes": [sizes], "bits": [bits], "blob": [blob], "ends": [ends], "rest": [rest]})

    return dealt.groupBy("lang", "shard").applyInPandas(
        build, "lang string, n_shards int, shard int, sizes array<int>, bits binary, blob binary, ends binary, rest int")


def terms_by_slot(hashes: DataFrame) -> DataFrame:
    """(lang, shard, slot, item): the terms of the hashes."""
    def work(batch):
        import numpy as np
        import pyarrow as pa
        lang, shard, slot, item = [], [], [], []
        for name, k, blob, ends in zip(*(c.to_pylist() for c in batch.columns)):
            at = [0, *np.frombuffer(ends, np.int32).tolist()]
            item += [blob[a:b] for a, b in zip(at, at[1:])]
            n = len(at) - 1
            lang += [name] * n
            shard += [k] * n
            slot += range(n)
        return {"lang": lang, "shard": shard, "slot": slot, "item": pa.array(item, pa.binary()).cast(pa.string())}

    return map_arrow(hashes.select("lang", "shard", "blob", "ends"), work, "lang string, shard int, slot int, item string", rows=1)


def _blocks(hashes: DataFrame, block_terms: int, block_bytes: int):
    """The hashes in blocks of bounded size, in the order of language and shard."""
    block, n, size = [], 0, 0
    for r in hashes.orderBy("lang", "shard").toLocalIterator():
        more = len(r["ends"]) // 4
        if block and (n + more > block_terms or size + len(r["blob"]) > block_bytes):
            yield block
            block, n, size = [], 0, 0
        block.append(tuple(r))
        n, size = n + more, size + len(r["blob"])
    if block:
        yield block


def _recount(src: DataFrame, block: list[tuple]) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    shared = src.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        tables: dict[str, tuple[int, dict[int, PerfectHash]]] = {}
        for lang, n_shards, shard, *table in shared.value:
            tables.setdefault(lang, (n_shards, {}))[1][shard] = PerfectHash(*table)
        dense: dict[tuple, np.ndarray] = {}  # (lang, category, shard) -> counts by slot

        def rows():
            for (lang, category, shard), counts in dense.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([category] * len(at), pa.string()), pa.array(np.full(len(at), shard), pa.int32()),
                     pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "category", "shard", "slot", "n"])
            dense.clear()

        for batch in batches:
            texts: dict[tuple, list] = {}
            for lang, category, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang in tables:
                    texts.setdefault((lang, category), []).append(text)
            for (lang, category), some in texts.items():
                n_shards, shards = tables[lang]
                counts: Counter = Counter()
                for text in some:
                    counts.update(terms_of(text.as_buffer().to_pybytes()))
                words = list(counts)
                n = np.fromiter(counts.values(), np.int64, len(words))
                h = np.fromiter(map(hash_of, words), np.uint64, len(words))
                of = h.view(np.int64) % n_shards
                for shard, table in shards.items():
                    at = np.flatnonzero(of == shard)
                    slots = table.slots([words[i] for i in at.tolist()], h[at])
                    ok = slots >= 0
                    if ok.any():
                        key = (lang, category, shard)
                        if key not in dense:
                            dense[key] = np.zeros(table.n, np.int64)
                        dense[key][slots[ok]] += n[at[ok]]
                if sum(map(len, dense.values())) >= FLUSH_SLOTS:
                    yield from rows()
        yield from rows()

    return src.mapInArrow(run, "lang string, category string, shard int, slot int, n long")


def term_counts(docs: DataFrame, hashes: DataFrame, block_terms: int = BLOCK_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, category, shard, slot, n): occurrences of the kept terms, those that occur. One pass over `docs` for each block
    of `hashes`; a language of any size is counted whole."""
    src = _inputs(docs)
    out = src.sparkSession.createDataFrame([], "lang string, category string, shard int, slot int, n long")
    for block in _blocks(hashes, block_terms, block_bytes):
        out = out.unionByName(_recount(src, block))
    return out.groupBy("lang", "category", "shard", "slot").agg(F.sum("n").alias("n"))


def _share(n, total, v):
    """1 + floor(10^9 (n + 5) / (total + 5 v)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(n) + F.lit(PRIOR).cast("decimal(20,0)")) * F.lit(PARTS).cast("decimal(11,0)")
    below = wide(total) + wide(v) * F.lit(PRIOR).cast("decimal(11,0)")
    return F.lit(1) + F.call_function("div", top, below)


def _distances(counts: DataFrame, groups: list) -> DataFrame:
    """(lang, a, b, part): for numbers a < b of two categories the sum of |p - q| over the terms that occur in a tile, less what
    these terms would give if they occurred in neither. `groups` are (lang, no, p of a term that does not occur)."""
    import numpy as np
    import pandas as pd

    of: dict[str, list] = {}
    for lang, no, zero in groups:
        of.setdefault(lang, []).append((no, zero))
    shared = counts.sparkSession.sparkContext.broadcast(
        {lang: np.array([z for _, z in sorted(x)], np.int64) for lang, x in of.items()})
    last = max((len(x) - 1) // TILE_GROUPS for x in of.values()) if of else 0
    block = F.floor(F.col("no") / TILE_GROUPS).cast("int")
    met = (counts.select("lang", "shard", F.floor(F.col("slot") / TILE_TERMS).cast("int").alias("tile"), "slot", "no", "p", block.alias("own"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(last))))
           .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("own", "other"))

    def tile(key, part):
        lang, lo, hi = key[0], int(key[3]), int(key[4])
        zero = shared.value[lang]
        slots, col = np.unique(part["slot"].to_numpy(), return_inverse=True)
        no, p = part["no"].to_numpy(), part["p"].to_numpy()

        def dense(b):
            z = zero[b * TILE_GROUPS:(b + 1) * TILE_GROUPS]
            m = np.repeat(z[:, None], len(slots), 1)
            own = no // TILE_GROUPS == b
            m[no[own] - b * TILE_GROUPS, col[own]] = p[own]
            return z, m

        za, ma = dense(lo)
        zb, mb = dense(hi)
        a, b, s = [], [], []
        for i in range(len(za)):
            first = i + 1 if lo == hi else 0
            part_i = np.abs(mb[first:] - ma[i]).sum(1) - len(slots) * np.abs(zb[first:] - za[i])
            a.append(np.full(len(part_i), lo * TILE_GROUPS + i))
            b.append(hi * TILE_GROUPS + np.arange(first, len(zb)))
            s.append(part_i)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"lang": lang, "a": cat(a), "b": cat(b), "part": cat(s)})

    return (met.groupBy("lang", "shard", "tile", "lo", "hi").applyInPandas(tile, "lang string, a int, b int, part long")
            .groupBy("lang", "a", "b").agg(F.sum("part").alias("part")))


def category_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, shard_terms: int = SHARD_TERMS,
                        block_terms: int = BLOCK_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, category, part, item, value long, rank int): how the categories of converted documents (text, lang, category)
    differ within a language.

    A language keeps the V terms that at least `min_docs` of its documents hold. In a category that has `total` occurrences
    of kept terms, a term that occurs n times (0 too) has p = 1 + floor(10^9 (n + 5) / (total + 5 V)); in the whole language
    likewise. Part `pair`: every other category of the language by the sum of |p - q| over all kept terms. Part `term`: the
    `top_terms` terms that occur and have the largest p - q > 0 against the language. Ranks count from 1 by value
    descending, item ascending in UTF-8. Null text, language or category count as empty ones; repeated rows count each; a
    category without terms has its pairs, one alone in its language has none; no rows give no rows. Other columns are not read.

    One row for each (language, category) goes to the driver and the tasks; the pairs of categories are the result, so what
    is broadcast is about the root of it.
    """
    terms = kept(frequent_terms(docs, min_docs))
    hashes = kept(perfect_hashes(terms, shard_terms))
    counts = kept(term_counts(docs, hashes, block_terms, block_bytes))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "category").agg(F.sum("n").alias("total"))
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0))
    groups = (_inputs(docs).groupBy("lang", "category").agg(F.count("*").alias("n_docs")).join(sizes, "lang", "left")
              .join(totals, ["lang", "category"], "left").na.fill(0, ["v", "total"])
              .select("lang", "category", "v", "total", zero.alias("zero"),
                      (F.row_number().over(Window.partitionBy("lang").orderBy("category")) - 1).alias("no")))
    groups = kept(groups)
    by_slot = terms_by_slot(hashes)
    shares = counts.join(F.broadcast(groups), ["lang", "category"]).select(
        "lang", "category", "no", "shard", "slot", "n", "v", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))

    far = _distances(shares, [tuple(r) for r in groups.select("lang", "no", "zero").collect()])
    mine = groups.select("lang", "category", "v", F.col("no").alias("x"), F.col("zero").alias("p0"))
    theirs = groups.select("lang", F.col("category").alias("item"), F.col("no").alias("y"), F.col("zero").alias("q0"))
    pairs = (mine.join(theirs, "lang").filter("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
             .join(far, ["lang", "a", "b"], "left")
             .select("lang", "category", F.lit("pair").alias("part"), "item",
                     (F.col("v") * F.abs(F.col("p0") - F.col("q0")) + F.coalesce("part", F.lit(0))).alias("value")))

    whole = counts.groupBy("lang").agg(F.sum("n").alias("all")).join(sizes, "lang")
    language = (counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")).join(F.broadcast(whole), "lang")
                .select("lang", "shard", "slot", _share(F.col("n"), F.col("all"), F.col("v")).alias("q"))
                .join(by_slot, ["lang", "shard", "slot"]))
    above = (shares.join(language, ["lang", "shard", "slot"]).filter("p > q")
             .select("lang", "category", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "category").orderBy(F.desc("value"), "item"))
    best = above.withColumn("rank", place).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", place).unionByName(best)
