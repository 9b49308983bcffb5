"""Near duplicates among converted documents: SimHash fingerprints linked through a Gray-ordered hierarchical index.

Two fingerprints of 64 bits that differ in at most `bits` places agree on all but `bits` of their blocks. For every choice of
that many agreeing blocks a copy of each distinct fingerprint has these blocks in front, and the copies are
range-partitioned and sorted by (choice, Gray rank): equal blocks stand together, and neighbours differ in few bits. The
number of blocks grows with the fingerprints, so that few of them share the blocks in front: four (16 bits in front) up to
some millions, five (25) up to some billions, six (32) beyond. A task cuts its sorted run into nodes that do not cross a
block value. Above the leaves, every `FAN` neighbours share an upper node that holds the bits on which all of
them agree; a search adds up the differences on those masked bits on its way down and leaves whole groups once there are
too many. Range partitions have bounded size whatever the skew: a block value that does not fit in one node, or that a
partition's border cuts, leaves the task as nodes, and pairs of such nodes are searched in tasks of their own.
A search yields a spanning forest of its links, so the edges stay linear in the fingerprints; connected components come
from alternating star joins over the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, kept, map_arrow, type_of, whole_text

FAN = 8
NODE = 1024


# --- fingerprints ---------------------------------------------------------------------------------------

def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long): SimHash of the whole text of every document, one row per row.

    Words are runs without blanks, tabs and line ends, A-Z in lower case; shingles of `shingle` words, repeats included,
    joined by a blank, are hashed with XXH64. A bit is one if it is set in over half of the hashes. A text of fewer words
    is one shingle; null and blank texts have the fingerprint 0. Ids may be null or repeat; other columns are not read.
    """
    def work(batch):
        return {"doc_id": batch.column(0), "fingerprint": [_fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]}

    src = docs.select("doc_id", whole_text("text").alias("text"))
    return map_arrow(src, work, f"doc_id {type_of(docs, 'doc_id')}, fingerprint long")


def _fingerprint(text: str, shingle: int, seed: int) -> int:
    import numpy as np
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: exactly A-Z, and exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(shingle)]))]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, dtype="<u8")
    for i in range(0, len(every), 4096):
        counts += np.unpackbits(every[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(every), bitorder="little")
    return int(bits.view("<i8")[0])


def hex_of(fingerprint: str | Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# --- the index ------------------------------------------------------------------------------------------

def gray_rank(x):
    """Place of each 64-bit word in the reflected Gray sequence (numpy, unsigned)."""
    import numpy as np
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class HierarchicalIndex:
    """Levels of nodes over a run of fingerprints in Gray order; `groups` numbers the runs that must not be mixed."""

    def __init__(self, leaves, groups):
        import numpy as np
        self.leaves = leaves
        ones, zeros, owner = leaves, ~leaves, groups
        self.levels = []  # from the leaves up: mask of agreed bits, their pattern, first child, number of children
        while len(ones):
            n = len(ones)
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            if len(begin) == n:
                break
            place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
            first = np.flatnonzero(place % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            owner = owner[first]
            self.levels.append((ones | zeros, ones, first, np.diff(np.append(first, n))))
        self.owner = owner  # one root per group

    def links(self, queries, groups, bits: int, block: int = 1 << 15):
        """Yields (query number, leaf number) arrays: all leaves of the query's group within `bits` of it."""
        import numpy as np
        root_of = np.searchsorted(self.owner, groups)
        for at in range(0, len(queries), block):
            q = np.arange(at, min(at + block, len(queries)))
            yield from self._down(queries, q, root_of[q], bits, len(self.levels) - 1, np.zeros(len(q), np.uint8), None)

    def _down(self, queries, q, node, bits, level, so_far, above):
        """`above`: the mask that `so_far` differences were counted on, for each entry."""
        import numpy as np
        limit = 1 << 20
        if len(q) > limit:  # bounded memory: parts of the frontier one after the other
            for i in range(0, len(q), limit):
                part = slice(i, i + limit)
                yield from self._down(queries, q[part], node[part], bits, level, so_far[part], None if above is None else above[part])
            return
        if level < 0:
            d = np.bitwise_count(queries[q] ^ self.leaves[node])
            ok = d <= bits
            yield q[ok], node[ok]
            return
        mask, pattern, first, width = self.levels[level]
        here = mask[node]
        fresh = here if above is None else here & ~above
        so_far = so_far + np.bitwise_count((queries[q] ^ pattern[node]) & fresh)
        ok = so_far <= bits
        q, node, so_far, here = q[ok], node[ok], so_far[ok], here[ok]
        n = width[node]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield from self._down(queries, np.repeat(q, n), np.repeat(first[node], n) + step, bits, level - 1, np.repeat(so_far, n), np.repeat(here, n))


class Forest:
    """Union of numbered items, many pairs at a time."""

    def __init__(self, n: int):
        import numpy as np
        self.root = np.arange(n)

    def join(self, a, b) -> None:
        import numpy as np
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def n_blocks(count: int, bits: int = 3, share: int = 64) -> int:
    """The least number of blocks with which a block value holds about `share` of `count` fingerprints or fewer."""
    return next((b for b in range(bits + 1, bits + 4) if count >> front_bits(_choices(b, bits)[0], b) <= share), bits + 4)


def _choices(blocks: int, bits: int) -> list[tuple[int, ...]]:
    """Every choice of blocks that may agree."""
    from itertools import combinations
    return list(combinations(range(blocks), blocks - bits))


def _spans(choice: tuple[int, ...], blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks, those chosen first; block 0 has the highest bits."""
    order = [*choice, *(b for b in range(blocks) if b not in choice)]
    return [(64 - (b + 1) * 64 // blocks, (b + 1) * 64 // blocks - b * 64 // blocks) for b in order]


def front_bits(choice: tuple[int, ...], blocks: int) -> int:
    return sum(w for _, w in _spans(choice, blocks)[:len(choice)])


def in_front(fp: Column, choice: tuple[int, ...], blocks: int) -> Column:
    """The bits of the chosen blocks, then the others."""
    at, out = 64, F.lit(0).cast("long")
    for low, width in _spans(choice, blocks):
        at -= width
        part = F.shiftrightunsigned(fp, low) if low else fp
        part = part.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else part
        out = out.bitwiseOR(F.shiftleft(part, at) if at else part)
    return out


def in_place(x, choice: tuple[int, ...], blocks: int):
    """What `in_front` was made of (numpy, unsigned)."""
    import numpy as np
    at, out = 64, np.zeros(len(x), np.uint64)
    for low, width in _spans(choice, blocks):
        at -= width
        out |= (x >> np.uint64(at) & np.uint64((1 << width) - 1)) << np.uint64(low)
    return out


def links(fps: DataFrame, bits: int = 3, node: int = NODE, blocks: int | None = None) -> DataFrame:
    """(a, b) edges, a < b: a graph over the distinct fingerprints of `fps` (fp long) in which two fingerprints are
    connected exactly if a chain of steps of at most `bits` differing bits connects them. Null fingerprints link to none,
    equal ones change nothing, no rows give no edges. `blocks` is chosen by the number of rows if not given."""
    import numpy as np

    blocks = blocks or n_blocks(fps.count(), bits)
    choices = _choices(blocks, bits)
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), in_front(F.col("fp"), c, blocks).alias("x")) for s, c in enumerate(choices)])
    rank = F.col("x")
    copies = fps.filter("fp is not null").select(F.explode(slots).alias("c")).select("c.slot", "c.x")
    for s in (1, 2, 4, 8, 16, 32):  # Gray rank: prefix parity from the highest bit
        copies = copies.withColumn("g" if s > 1 else "g", (F.col("g") if s > 1 else rank).bitwiseXOR(
            F.shiftrightunsigned(F.col("g") if s > 1 else rank, s)))
    signed = F.col("g").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = copies.withColumn("g", signed).repartitionByRange(width, "slot", "g").sortWithinPartitions("slot", "g").select("slot", "x")
    lead = np.array([64 - front_bits(c, blocks) for c in choices], np.uint64)

    def back(x, slot):
        out = np.zeros(len(x), np.uint64)
        for s in np.unique(slot):
            out[slot == s] = in_place(x[slot == s], choices[s], blocks)
        return out.view(np.int64)

    def search(batches):
        """Edges of complete block values; the rest as nodes (slot, key, values)."""
        import pyarrow as pa
        held_x, held_s = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = True

        def edges_of(x, s, group):
            forest = Forest(len(x))
            for q, leaf in HierarchicalIndex(x, group).links(x, group, bits):
                pair = q > leaf
                forest.join(q[pair], leaf[pair])
            moved = np.flatnonzero(forest.root != np.arange(len(x)))
            return back(x[moved], s[moved]), back(x[forest.root[moved]], s[moved])

        def out(a=(), b=(), slot=(), key=(), values=()):
            n, m = len(a), len(slot)
            return pa.RecordBatch.from_arrays([
                pa.array([*a, *[None] * m], pa.int64()), pa.array([*b, *[None] * m], pa.int64()),
                pa.array([*[None] * n, *slot], pa.int32()), pa.array([*[None] * n, *key], pa.int64()),
                pa.array([*[None] * n, *values], pa.list_(pa.int64()))], ["a", "b", "slot", "key", "values"])

        def cut(x, s, last):
            nonlocal first
            key = x >> lead[s]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(x)))
            whole = size <= node
            if first:
                whole[0] = False
            if last:
                whole[-1] = False
            first = False
            inside = np.repeat(whole, size)
            group = np.cumsum(new)
            a, b = edges_of(x[inside], s[inside], group[inside]) if inside.any() else ((), ())
            nodes = [(i, min(i + node, f + n)) for f, n in zip(begin[~whole], size[~whole]) for i in range(f, f + n, node)]
            return out(a, b, [int(s[i]) for i, _ in nodes], [int(key[i]) for i, _ in nodes],
                       [x[i:j].view(np.int64) for i, j in nodes])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([held_x, batch.column(1).to_numpy().view(np.uint64)])
            s = np.concatenate([held_s, batch.column(0).to_numpy().astype(np.int64)])
            key = x >> lead[s]
            open_from = np.flatnonzero((s != s[-1]) | (key != key[-1]))
            stop = int(open_from[-1]) + 1 if len(open_from) else 0
            if len(x) - stop > 64 * node:  # a block value that is long anyway: its full nodes leave at once
                full = stop + (len(x) - stop) // node * node
                part = cut(x[:stop], s[:stop], False) if stop else None
                if part:
                    yield part
                for i in range(stop, full, node):
                    yield out((), (), [int(s[i])], [int(key[i])], [x[i:i + node].view(np.int64)])
                first, stop = True, full  # what is left of this value is not whole
            elif stop:
                yield cut(x[:stop], s[:stop], False)
            held_x, held_s = x[stop:], s[stop:]
        if len(held_x):
            yield cut(held_x, held_s, True)

    found = kept(run.mapInArrow(search, "a long, b long, slot int, key long, values array<long>"))
    nodes = found.filter("slot is not null").select(
        "slot", "key", "values", F.xxhash64("values").alias("no"))
    left = nodes.select("slot", "key", F.col("values").alias("left"), F.col("no").alias("no_l"))
    right = nodes.select("slot", "key", F.col("values").alias("right"), F.col("no").alias("no_r"))
    pairs = left.join(right, ["slot", "key"]).filter("no_l <= no_r")

    def search_nodes(batch):
        import pyarrow as pa
        a, b = [], []
        for i, slot in enumerate(batch.column(0).to_pylist()):
            l, r = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (1, 2))
            order = np.argsort(gray_rank(r), kind="stable")
            index = HierarchicalIndex(r[order], np.zeros(len(r), np.int64))
            forest = Forest(len(l) + len(r))
            for q, leaf in index.links(l, np.zeros(len(l), np.int64), bits):
                forest.join(q, len(l) + leaf)
            every = np.concatenate([l, r[order]])
            moved = np.flatnonzero(forest.root != np.arange(len(every)))
            at = np.full(len(moved), slot)
            a.append(back(every[moved], at))
            b.append(back(every[forest.root[moved]], at))
        return {"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))}

    far = map_arrow(pairs.select("slot", "left", "right"), search_nodes, "a long, b long")
    every = found.filter("a is not null").select("a", "b").unionByName(far)
    return every.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


# --- components -----------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge. `edges` (a, b), a < b, longs without nulls;
    repeated edges change nothing, no edges give no rows.

    Alternating stars: every node first hands its larger neighbours, then its smaller ones, to the smallest node it sees,
    until nothing changes. Each step is an aggregate with map-side combining and a join back on the node; the hot node of
    a large component has one row on the small side of that join, so its partition can be split.
    """
    now = kept(edges.select("a", "b").distinct())

    def size(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        return tuple(r)

    before = None
    while (state := size(now)) != before:
        before = state
        now = kept(_star(_star(now, True), False).distinct())
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).distinct().unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a < b, after one step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # node a sees b
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    if large:
        moved = met.filter("b > a").select(F.col("m").alias("a"), "b")
    else:
        moved = met.filter("b <> m").select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row per row of `docs` (doc_id, text).

    Fingerprints link at `bits` or fewer differing bits; `component_id` is the smallest doc_id that a chain of links
    reaches, itself included. Equal fingerprints, also those of blank texts, are one class; only classes are searched,
    and documents find their component through their fingerprint. Null ids have the component of their class, null if no
    id is reached.
    """
    fps = kept(fingerprints(docs, shingle, seed))
    classes = kept(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select(F.col("fingerprint").alias("fp")), bits))
    in_class = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    in_class = kept(in_class)
    best = in_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = in_class.join(best, "root").select(F.col("fingerprint").alias("_fp"), "component_id")
    return fps.join(named, F.col("fingerprint") == F.col("_fp")).select("doc_id", "fingerprint", "component_id")


def without_near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of `docs` (doc_id, text) that stand for their group of linked fingerprints, all columns as they are.

    Of a group one row stays: that with the smallest doc_id, null ids last, ties by the SHA-256 of the text. Rows that repeat
    id and text are one row of a group; which of them stays is open when their other columns differ.
    """
    row, text = free_name(docs, "_row"), free_name(docs, "_text")
    digest = F.sha2(F.encode(whole_text("text"), "UTF-8"), 256)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("text"))
    found = kept(near_duplicates(docs.select(key.alias("doc_id"), "text"), bits, shingle, seed).groupBy("doc_id", "component_id").count())
    names = [F.col("doc_id.id").alias(row), F.col("doc_id.text").alias(text)]
    gone = found.filter("doc_id <> component_id").select(*names)
    left = docs.withColumn(text, digest)
    left = left.join(gone.withColumnRenamed(text, text + "g"), left["doc_id"].eqNullSafe(F.col(row)) & (left[text] == F.col(text + "g")), "left_anti")
    again = found.filter("doc_id = component_id and count > 1").select(*names)
    if not again.isEmpty():
        again = again.withColumnRenamed(text, text + "g")
        known = left["doc_id"].eqNullSafe(F.col(row)) & (left[text] == F.col(text + "g"))
        one = left.join(again, known, "left_semi").withColumn(row, F.row_number().over(Window.partitionBy("doc_id", text).orderBy(text)))
        left = left.join(again, known, "left_anti").unionByName(one.filter(F.col(row) == 1).drop(row))
    return left.drop(text)
