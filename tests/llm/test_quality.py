import zlib

import numpy as np
from common_cases import ROWS, awkward, empty

from quiremill.llm import quality as Q


def test_held_out_accuracy(spark):
    """Learnt from the rows that are not held out, right on those that are; copies of learnt texts are left aside."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = {i for i in label if zlib.crc32(str(i).encode()) % 5 == 0}
    known = spark.createDataFrame([(i, y) for i, y in label.items() if i not in held], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in Q.quality_scores(docs, Q.fit(docs, known)).collect()}
    learnt = {text[i] for i in label if i not in held}
    fresh = [i for i in held if text[i] not in learnt]
    right = np.mean([(score[i] >= 0.3) == bool(label[i]) for i in fresh])
    pos, neg = [score[i] for i in fresh if label[i]], [score[i] for i in fresh if not label[i]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(fresh) > 40 and right > 0.95 and auc > 0.98
    again = {r.doc_id: r.score for r in Q.quality_scores(docs.repartition(5), Q.fit(docs.repartition(3), known)).collect()}
    assert again == score


def test_rows_that_repeat_a_labelled_id_are_bounded(spark):
    """A third of all rows under one labelled id: no more than `max_rows` reach the learner, whatever the layout."""
    rows = [(7 if i % 3 == 0 else i, f"text {i % 90} of the document") for i in range(30_000)]
    known = spark.createDataFrame([(7, 1), (8, 0), (10, 0)], "doc_id long, quality int")
    learnt = []
    for parts in (2, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        m = Q.fit(docs, known, max_rows=50, epochs=1)
        learnt.append(m.weights.tobytes())
    assert learnt[0] == learnt[1]
    assert Q.fit(docs, known, max_rows=10**6, epochs=1).weights.tobytes() != learnt[0]


def test_query(spark):
    """op10 against the dot product of every text's features with the fitted weights, text by text."""
    from quiremill.llm import queries
    folder = "/root/testdata/sf0.001"
    m = queries.quality_model(spark, folder)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op10_quality(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        index, values = Q.features(text[r.doc_id], m.bits)
        score = 1 / (1 + np.exp(-np.clip(m.intercept + float(m.weights[index].astype(float) @ values), -35, 35)))
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_block_gives_the_dot_product_of_the_features():
    rng = np.random.default_rng(1)
    m = Q.Model(rng.normal(size=1 << 10).astype(np.float32), 0.25, 10)
    texts = ["", "a", "a b", "One two, THREE!! 4 4 4", "x " * 300]
    for t, s in zip(texts, m.scores(texts)):
        index, values = Q.features(t, 10)
        assert abs(s - 1 / (1 + np.exp(-(0.25 + float(m.weights[index] @ values))))) < 1e-6
    assert list(m.scores(texts[::-1])) == list(m.scores(texts))[::-1]


def test_ftrl_follows_its_rule():
    f = Q.Ftrl(3, 0.5, 1.0, 0.1, 0.2)
    z, n = np.zeros(4), np.zeros(4)
    for index, values, y in [([0, 2], [1.0, 2.0], 1), ([1], [1.0], 0), ([0, 1], [0.5, 3.0], 1)]:
        f.learn(np.array(index), np.array(values), y)
        x = np.zeros(4)
        x[index], x[3] = values, 1.0
        w = np.where(np.abs(z) <= 0.1, 0, -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.5 + 0.2))
        g = (1 / (1 + np.exp(-w @ x)) - y) * x
        z, n = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w, n + g * g
    assert np.allclose(f.z, z) and np.allclose(f.n, n)


def test_shapes():
    assert [Q.shape_of(w) for w in ("word", "Word", "WORD!!", "a1b22", "&&&&&", "Éa,", "x")] == ["a", "Aa", "AA!!", "a0a0", "&&&", "Aa,", "a"]


def test_awkward_documents(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(docs, none)
    assert {r.score for r in Q.quality_scores(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (1, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    rows = Q.quality_scores(docs, Q.fit(docs, some)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert Q.with_scores(docs, model, "extra").columns == [*docs.columns, "extra"]
    assert Q.quality_scores(empty(spark), model).count() == 0
