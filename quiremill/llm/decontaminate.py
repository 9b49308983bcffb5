"""Benchmark passages inside converted documents, found although words were changed, dropped or put in.

Texts are word sequences. The CGK random walk embeds a sequence so that few edits become few differing places: step j emits
the current word and moves on or stays by a random bit of (j, word). A window as long as an item begins at every word of
a document; a hash function samples some steps of the walk over it. Items are entered for every place inside them, so one
stretch without an edit is enough for a common key, and every function walks by random bits of its own; together they
reach the target recall. Every candidate is decided by the exact edit distance to its item.

The samples come from the first STEPS steps of a walk. After an edit two walks meet again only by chance: with a fifth of the
words edited, four samples over the whole walk of a window of 10, 50 or 100 words agree in 27, 9 or 3 of 100 tries
(`agreement`), so the target recall would take 15, 46 or 130 functions, where the short walks from every inner place take 5.

Items are the query set: they are taken to the tasks in blocks of bounded size, all documents pass by each block, and
nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_arrow, type_of, whole_text

BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
SHORT = 10
STEPS = 6
SAMPLES = 4
MEMO = 300_000


def n_functions(similarity: float, target_recall: float) -> int:
    """Hash functions for the target recall. A key needs about STEPS / 2 + 1 words without an edit, which a place of an item
    offers with probability similarity ** (STEPS / 2 + 1); an item of SHORT words has at least SHORT - STEPS such places,
    of which one function keeps about half after dropping keys of repeated words."""
    miss = (1 - similarity ** (STEPS / 2 + 1)) ** ((SHORT - STEPS) / 2)
    return max(2, math.ceil(math.log(1 - target_recall) / math.log(miss)))


def words_of(text: str) -> list[str]:
    """Lower-case words without the marks around them."""
    return [w for w in map(_bare, text.lower().split()) if w]


def _bare(raw: str) -> str:
    import re
    return raw if raw.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", raw)


def common_among(holders: Counter, items: int) -> frozenset[str]:
    """Words that more than one in fifty items hold, given in how many each occurs."""
    return frozenset(w for w, n in holders.items() if n > max(1, items // 50))


class _Symbols(dict):
    """Raw word -> number of its bare form among the items' words; 0: not in any item, -1: no word at all."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, raw: str) -> int:
        if not raw:  # the gap between two texts
            return 0
        bare = _bare(raw)
        v = self.known.get(bare, 0) if bare else -1
        if len(self) >= MEMO:
            self.clear()
        if len(raw) <= 64:
            self[raw] = v
        return v


class ItemIndex:
    """The items of one block: their words as symbols and, for each hash function, a sorted list of keys. `common` are the
    words of many items of the whole benchmark, which make poor keys; those of these items if not given."""

    def __init__(self, items: list[tuple], similarity: float, functions: int, seed: int = 11, common: frozenset[str] | None = None):
        import numpy as np

        self.ids = [i for i, _ in items]
        words = [words_of(t or "") for _, t in items]
        known: dict[str, int] = {}
        for ws in words:
            for w in ws:
                known.setdefault(w, len(known) + 1)
        self.symbols = _Symbols(known)
        self.items = [np.array([known[w] for w in ws], np.int64) for ws in words]
        self.limit = [int((1 - similarity) * len(ws) + 1e-9) for ws in words]
        rng = np.random.default_rng(seed)
        n = len(known) + 1
        if common is None:
            common = common_among(Counter(w for ws in words for w in set(ws)), len(items))
        self.rare = np.ones(n, np.int64)
        self.rare[[known[w] for w in common if w in known]] = 0
        self.tables = []
        short = [i for i, x in enumerate(self.items) if 0 < len(x) < SHORT]
        long = [i for i, x in enumerate(self.items) if len(x) >= SHORT]
        for f in range(functions):
            steps = np.sort(np.concatenate([[0], rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False)]))
            walk = (rng.integers(0, 1 << STEPS, n), [int(s) for s in steps], rng.integers(1, 1 << 62, n, dtype=np.uint64))
            if long:
                self.tables.append((walk, *self._enter(long, walk)))
        if short:  # too short for a walk: one of their first words is without an edit
            walk = (np.zeros(n, np.int64), [0], rng.integers(1, 1 << 62, n, dtype=np.uint64))
            entries = [(i, o) for i in short for o in range(min(self.limit[i] + 1, len(self.items[i])))]
            keys = np.array([walk[2][self.items[i][o]] for i, o in entries], np.uint64)
            self.tables.append((walk, *self._sorted(keys, entries)))

    @staticmethod
    def _sorted(keys, entries):
        import numpy as np
        order = np.argsort(keys, kind="stable")
        at = np.array(entries, np.int64).reshape(-1, 2)[order]
        return keys[order], at[:, 0], at[:, 1]

    def _enter(self, which, walk):
        """Keys of the places of every item from which the walk stays inside the item and sees three or more words.
        Keys that hold a word of few items are entered; an item that has hardly any such words is entered by all its keys."""
        import numpy as np
        keys, entries = [], []
        for i in which:
            x = np.concatenate([self.items[i], np.zeros(STEPS, np.int64)])
            places, key, last, rare = self._walk(x, np.arange(len(self.items[i])), walk, rare=self.rare)
            ok = (last < len(self.items[i])) & (last - places >= 2)
            if (ok & (rare > 0)).sum() * 2 >= ok.sum():
                ok &= rare > 0
            keys.append(key[ok])
            entries += [(i, int(o)) for o in places[ok]]
        return self._sorted(np.concatenate(keys), entries)

    @staticmethod
    def _walk(x, places, walk, allowed=None, rare=None):
        """(places, keys, last place read), and with `rare` how many sampled words are. `allowed`: a filter by what the
        first two samples may be."""
        import numpy as np
        bits, steps, code = walk
        at, key = places, code[x[places]]
        count = rare[x[places]] if rare is not None else None
        taken = 1
        for j in range(1, steps[-1] + 1):
            at = at + (bits[x[at]] >> (j - 1) & 1)
            if j in steps:
                key = key * np.uint64(0x9E3779B97F4A7C15) + code[x[at]]
                taken += 1
                if rare is not None:
                    count = count + rare[x[at]]
                if taken == 2 and allowed is not None:
                    ok = allowed[key >> np.uint64(44)]
                    places, at, key = places[ok], at[ok], key[ok]
        return (places, key, at) if rare is None else (places, key, at, count)

    def ready(self):
        """Filters that a scan uses: symbols that begin a key, and the first two samples of the keys."""
        import numpy as np
        self.filters = []
        self.lists = [x.tolist() for x in self.items]
        for walk, keys, item, place in self.tables:
            begins = np.zeros(len(walk[0]), bool)
            begins[[self.items[i][o] for i, o in zip(item, place)]] = True
            allowed = None
            if len(walk[1]) > 1:
                allowed = np.zeros(1 << 20, bool)
                part = (walk[0], walk[1][:2], walk[2])
                for i in set(item.tolist()):
                    x = np.concatenate([self.items[i], np.zeros(STEPS, np.int64)])
                    _, k, _ = self._walk(x, place[item == i], part)
                    allowed[k >> np.uint64(44)] = True
            self.filters.append((begins, allowed))
        return self

    def candidates(self, x, first):
        """(text, item, place in x of the item's first word) rows, sorted without repeats. The text is the one that holds the
        key; the item's first word would stand before it where the text begins inside the item."""
        import numpy as np
        found = []
        for (walk, keys, item, place), (begins, allowed) in zip(self.tables, self.filters):
            p, key, _ = self._walk(x, np.flatnonzero(begins[x]), walk, allowed)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = hi > lo
            p, lo, n = p[hit], lo[hit], (hi - lo)[hit]
            e = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(p, n)
            found.append(np.stack([np.searchsorted(first, at, "right") - 1, item[e], at - place[e]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def matches(self, texts: list[str]):
        """(text number, item number, distance, first word, one past the last word): the best match of every item."""
        import numpy as np
        words, begin = [], []
        for t in texts:
            begin.append(len(words))
            words += t.lower().split()
            words += [""] * (STEPS + 1)
        get = self.symbols.__getitem__
        raw = np.fromiter(map(get, words), np.int64, len(words))
        keep = raw >= 0
        first = (np.cumsum(keep) - keep)[begin] if begin else np.zeros(0, np.int64)
        x = raw[keep]
        ends = np.append(first[1:], len(x)) - STEPS - 1
        best: dict[tuple[int, int], tuple] = {}
        run = None  # text, item, first and last start that are decided together
        for t, item, start in self.candidates(x, first).tolist():
            if run and run[:2] == [t, item] and start <= run[3] + max(self.limit[item], 1):
                run[3] = start
                continue
            if run:
                self._decide(x, first, ends, run, best)
            run = [t, item, start, start]
        if run:
            self._decide(x, first, ends, run, best)
        return [(t, i, *v) for (t, i), v in best.items()]

    def _decide(self, x, first, ends, run, best):
        text, item, lo, hi = run
        want, limit = self.lists[item], self.limit[item]
        a, b = max(lo - limit, int(first[text])), min(hi + len(want) + limit, int(ends[text]))
        if b <= a:
            return
        part = x[a:b].tolist()
        there = set(part)
        if sum([w in there for w in want]) < len(want) - limit:  # too few of its words are there
            return
        found = nearest(want, part, limit)
        if found and ((text, item) not in best or found[0] < best[(text, item)][0]):
            best[(text, item)] = (found[0], a - int(first[text]) + found[1], a - int(first[text]) + found[2])


def nearest(item: list[int], text: list[int], limit: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the stretch of `text` with the least edit distance to the whole item, if within `limit`."""
    n = len(item)
    before = [(i, 0) for i in range(n + 1)]
    best = None
    for e, w in enumerate(text, 1):
        row = [(0, e)]
        for i in range(1, n + 1):
            d, b = before[i - 1]
            d += item[i - 1] != w
            x = before[i]
            if x[0] + 1 < d:
                d, b = x[0] + 1, x[1]
            y = row[i - 1]
            if y[0] + 1 < d:
                d, b = y[0] + 1, y[1]
            row.append((d, b))
        before = row
        if row[n][0] <= limit and (best is None or row[n][0] < best[0]):
            best = (row[n][0], row[n][1], e)
    return best


def common_words(benchmark: DataFrame) -> frozenset[str]:
    """Words that more than one in fifty items of the benchmark hold: at most fifty times the words of an item."""
    n = benchmark.count()

    def work(batch):
        return {"w": [w for t in batch.column(0).to_pylist() for w in set(words_of(t))]}

    words = map_arrow(benchmark.select(whole_text("text").alias("text")), work, "w string")
    return frozenset(r["w"] for r in words.groupBy("w").count().filter(F.col("count") > max(1, n // 50)).toLocalIterator())


def _blocks(benchmark: DataFrame):
    """The items in blocks of bounded number and size."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target_recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, distance int, n_words int, first_word int, end_word int): one row for every document and item of
    which the document holds a stretch of words within (1 - similarity) * n_words edits, with the best stretch (word
    numbers, end excluded).

    `docs` (doc_id, text), `benchmark` (item_id, text). Words are compared in lower case without marks around them.
    Null or empty texts and items without words match nothing; null ids are returned as they are; repeated documents and
    items are reported each. Other columns are not read.
    """
    src = docs.select("doc_id", whole_text("text").alias("text"))
    ddl = (f"doc_id {type_of(docs, 'doc_id')}, item_id {type_of(benchmark, 'item_id')}, distance int, n_words int, "
           "first_word int, end_word int")
    common, out = common_words(benchmark), docs.sparkSession.createDataFrame([], ddl)
    for block in _blocks(benchmark):
        out = out.unionByName(_scan(src, _shared(src, block, similarity, target_recall, common), ddl))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, target_recall: float = 0.99) -> DataFrame:
    """The rows of `docs` whose own text holds no stretch that `contaminated` would report, all columns as they are.

    A row is judged by its text alone: null and repeated ids change nothing, rows with equal texts stay or go together.
    Rows never leave their partition; what is left behind one block of items is written before the next block.
    """
    import pyarrow as pa

    common, left, at = common_words(benchmark), docs, docs.columns.index("text")
    for k, block in enumerate(_blocks(benchmark)):
        index = _shared(docs, block, similarity, target_recall, common)

        def run(batches, index=index):
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    clean = [True] * part.num_rows
                    for t, *_ in index().matches([t or "" for t in part.column(at).to_pylist()]):
                        clean[t] = False
                    yield part.filter(pa.array(clean))

        left = (kept(left) if k else left).mapInArrow(run, docs.schema)
    return left


def _shared(docs: DataFrame, items: list[tuple], similarity: float, target_recall: float, common: frozenset[str]):
    """A function that gives the tasks the index of a broadcast block."""
    shared = docs.sparkSession.sparkContext.broadcast((items, common))
    functions = n_functions(similarity, target_recall)

    def index(made=[]):  # noqa: B006, one for each task
        if not made:
            made.append(ItemIndex(shared.value[0], similarity, functions, common=shared.value[1]).ready())
        return made[0]

    return index


def _scan(src: DataFrame, index, ddl: str) -> DataFrame:
    def work(batch):
        import pyarrow as pa
        items = index()
        found = items.matches(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), "item_id": [items.ids[f[1]] for f in found],
                "distance": [f[2] for f in found], "n_words": [len(items.items[f[1]]) for f in found],
                "first_word": [f[3] for f in found], "end_word": [f[4] for f in found]}

    return map_arrow(src, work, ddl)


def agreement(words: int, similarity: float, samples: int, tries: int = 2000, seed: int = 3) -> float:
    """How often `samples` steps over the whole walk of a window of `words` words emit the same before and after random
    edits up to the limit: the chance that one hash function finds the window."""
    import random
    rnd, hits = random.Random(seed), 0
    for _ in range(tries):
        x = [rnd.randrange(1 << 30) for _ in range(words)]
        y = list(x)
        for _ in range(int((1 - similarity) * words + 1e-9)):
            j, kind = rnd.randrange(len(y)), rnd.random()
            y[j:j + 1] = [rnd.randrange(1 << 30)] if kind < 1 / 3 else [] if kind < 2 / 3 and len(y) > 1 else [y[j], rnd.randrange(1 << 30)]
        bit = {}
        steps = set(rnd.sample(range(2 * words), samples))
        emitted = []
        for z in (x, y):
            at, out = 0, []
            for j in range(2 * words):
                w = z[at] if at < len(z) else -1
                if j in steps:
                    out.append(w)
                at += bit.setdefault((j, w), rnd.random() < 0.5)
            emitted.append(out)
        hits += emitted[0] == emitted[1]
    return hits / tries
