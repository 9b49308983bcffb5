"""Text quality of converted documents: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A word counts as itself (lower case) and as its shape: letters by case, digits, marks as they are, runs cut short; a word
that repeats the one before it has a shape of its own. Features are the hashed 1- and 2-grams of words and 1- to 3-grams
of shapes, each family with relative counts. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_arrow, type_of, whole_text, worker_cache

BITS = 20
MEMO = 300_000
ORDERS = (1, 2, 1, 2, 3)
BLOCK = 100_000
_LOW = 0xFFFFFF


class _Words(dict):
    """Word -> 40 bits of the word's hash and 24 bits of its shape's; emptied when full."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        import xxhash
        s = shape_of(word)
        low = self.shapes.get(s)
        if low is None:
            low = xxhash.xxh64_intdigest(s) & _LOW
            if len(s) <= 8 and len(self.shapes) < MEMO:
                self.shapes[s] = low
        v = xxhash.xxh64_intdigest(word.lower()) & ~_LOW | low
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = v
        return v


def shape_of(word: str) -> str:
    """a: small letters, A: one capital, AA: more, 0: digits; marks stay; no more than three of a kind in a row."""
    import re
    body, mark = (word, "") if word[-1].isalnum() else (word[:-1], word[-1])
    if body.isalpha():  # the usual words
        if body.islower():
            return "a" + mark
        if body[0].isupper() and (len(body) == 1 or body[1:].islower()):
            return ("Aa" if len(body) > 1 else "A") + mark
    shape = "".join(["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word])
    return re.sub(r"(.)\1{2,}", r"\1\1\1", re.sub(r"0+", "0", re.sub(r"a+", "a", re.sub(r"A{2,}", "AA", shape))))


def _grams(words: list[str]):
    """Word hashes, shape hashes, and whether a word repeats the one before it."""
    import numpy as np

    memo = worker_cache("quality words", _Words)
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    w, s = both >> np.uint64(24), both & np.uint64(_LOW)
    same = np.zeros(len(w), bool)
    same[1:] = w[1:] == w[:-1]
    return w, s, same


def _numbers(w, s, same, bits: int):
    """(n, feature numbers) of each family of n-grams; the i-th entry belongs to the gram that begins at the i-th word."""
    import numpy as np

    s = s * np.uint64(2) + same
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    grams = [w * m1, (w[:-1] * m2 ^ w[1:]) * m1, s * m3, (s[:-1] * m2 ^ s[1:]) * m3, ((s[:-2] * m2 ^ s[1:-1]) * m1 ^ s[2:]) * m3]
    for family, g in enumerate(grams):
        g = (g + np.uint64(family)) * m2
        yield ORDERS[family], ((g ^ g >> np.uint64(29)) * m1 >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str, bits: int = BITS):
    """(indices, values): sorted feature numbers of a text and their relative counts, summed over the families."""
    import numpy as np

    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found = [g for _, g in _numbers(*_grams(words), bits) if len(g)]
    index, values = np.concatenate(found), np.concatenate([np.full(len(g), 1.0 / len(g)) for g in found])
    order = np.argsort(index, kind="stable")
    index, values = index[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[first].astype(np.int32), np.add.reduceat(values, first).astype(np.float32)


@dataclass
class Model:
    """Weights of the features and the intercept; a fixed number of floats whatever the training rows."""
    weights: object
    intercept: float
    bits: int

    def scores(self, texts: list[str]):
        """Scores of many texts: the words of a block of texts are hashed and looked up together."""
        import numpy as np

        out, words, ends = [], [], [0]
        for t in texts:
            words += t.split()
            ends.append(len(words))
            if len(words) >= BLOCK:
                out.append(self._block(words, ends))
                words, ends = [], [0]
        out.append(self._block(words, ends))
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -35, 35)))

    def _block(self, words, ends):
        import numpy as np

        counts = np.diff(ends)
        total = np.full(len(counts), self.intercept)
        if not words:
            return total
        text_no = np.repeat(np.arange(len(counts)), counts)
        w, s, same = _grams(words)
        same[np.array(ends[:-1])[counts > 0]] = False
        for n, index in _numbers(w, s, same, self.bits):
            if len(index):
                inside = text_no[:len(index)] == text_no[n - 1:]
                sums = np.bincount(text_no[:len(index)], np.where(inside, self.weights[index], 0.0), len(counts))
                total += sums / np.maximum(counts - n + 1, 1)
        return total


class Ftrl:
    """Follow-the-regularised-leader (proximal) with per-coordinate rates; the last coordinate is the intercept."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        import numpy as np
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index):
        import numpy as np
        z = self.z[index]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index, values, label: int) -> None:
        import numpy as np
        index, values = np.append(index, len(self.z) - 1), np.append(values, 1.0).astype(float)
        w = self.weights(index)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, epochs: int = 4, bits: int = BITS,
        alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """Model from labelled documents: `docs` (doc_id, text), `labels` (doc_id, 0/1 label).

    At most `max_rows` labelled rows are learnt from, those with the smallest hash of doc_id, so one task can pass over
    their features `epochs` times; the whole table is scored by what it learns. Null labels and null ids are not learnt
    from; rows that repeat an id are learnt from repeatedly, but at most `max_rows` rows in all, by the hashes of id and
    text. Without any labelled row every score is 0.5.
    """
    import numpy as np
    import pyarrow as pa

    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna()
             .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y").limit(max_rows))
    texts = docs.select("doc_id", whole_text("text").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select(F.xxhash64(F.col("doc_id").cast("string")).alias("k"), "y", "text",
                                                                    F.xxhash64("text").alias("h"))

    def to_features(batch):
        made = [features(t, bits) for t in batch.column(2).to_pylist()]
        return {"k": batch.column(0), "y": batch.column(1), "h": batch.column(3), "at": pa.array([a for a, _ in made], pa.list_(pa.int32())),
                "v": pa.array([v for _, v in made], pa.list_(pa.float32()))}

    found = map_arrow(rows, to_features, "k long, y int, h long, at array<int>, v array<float>")
    found = found.orderBy("k", "y", "h").limit(max_rows).select("k", "y", "at", "v")  # in one partition

    def learn(batches):
        seen = []
        for b in batches:
            ks, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            ats, vs = b.column(2), b.column(3)
            seen += [(k, y, ats[i].values.to_numpy(), vs[i].values.to_numpy()) for i, (k, y) in enumerate(zip(ks, ys))]
        seen.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        ftrl = Ftrl(1 << bits, alpha, beta, l1, l2)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(seen)):
                ftrl.learn(seen[i][2], seen[i][3], seen[i][1])
        w = ftrl.weights(np.arange((1 << bits) + 1))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])

    w = np.frombuffer(found.coalesce(1).mapInArrow(learn, "w binary").first()["w"], np.float32)
    return Model(w[:-1], float(w[-1]), bits)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double): how likely label 1 is for the whole text of every document, from 0 to 1.

    Only the text is an input. Null or empty texts get the score of the intercept; ids may be null or repeat; other columns
    are not read.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        m = shared.value
        return {"doc_id": batch.column(0), "score": pa.array(m.scores(batch.column(1).to_pylist()))}

    return map_arrow(docs.select("doc_id", whole_text("text").alias("text")), work, f"doc_id {type_of(docs, 'doc_id')}, score double")


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with all its columns and the score of its text as one more; rows never leave their partition."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(texts), pa.float64())],
                                                 [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
