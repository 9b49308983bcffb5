"""The pipeline against its stages in plain Python, and the query registry."""

import os

import corpus_pipeline
import public_tokenizers as P
import pytest
import test_bpe
import test_decontaminate
import test_exact_dedup
import test_simhash
from common_cases import awkward, empty

from quiremill.llm import decontaminate, queries

FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in queries.op10_quality(spark, FOLDER).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] == 1}
    assert 0 < len(left) < docs.count()
    exact = test_exact_dedup.plain(list(left.items()))
    left = {i: t for i, t in left.items() if exact[(i, i, next(k[2] for k in exact if k[0] == i), True)]}
    fp = {i: test_simhash.plain_fingerprint(t) for i, t in left.items()}
    comp, least = test_simhash.plain_components(fp.values()), {}
    for i, f in fp.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    left = {i: t for i, t in left.items() if least[comp[fp[i]]] == i}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontaminate.words_of(text)
        return any(len(set(x) & set(words)) * 2 > len(set(x)) and test_decontaminate.distance(x, words) <= int(0.2 * len(x)) for x in items)

    left = {i: t for i, t in left.items() if not leaks(t)}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {i: test_bpe.THEIRS.encode_ordinary(t) for i, t in left.items()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_tables(spark, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    for docs in (awkward(spark), empty(spark)):
        out = fn(spark, docs, FOLDER)
        assert stage == 4 or out.columns == docs.columns
        assert out.count() <= docs.count()


def test_null_and_repeated_ids(spark):
    """Rows are judged by their own texts: a row without an id goes if it holds a passage, one that shares an id with such a row stays."""
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    clean = ["A text of its own that shares no passage with anything else, " + " ".join(f"{c}{i}word" for i in range(60)) for c in "abcdef"]
    rows = [(None, bench, "x1"), (1, bench + " and more of the same", "x2"), (1, clean[0], "k1"), (None, clean[1], "k2"), (None, clean[1], "k2"),
            (2, clean[2], "k3"), (2, clean[3], "k4"), (3, clean[2], "y"), (None, None, "z"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    _, exact, near, benchmark, encode = (f for _, f in corpus_pipeline.STAGES)
    left = exact(spark, docs, FOLDER)
    assert sorted(r.lang for r in left.collect()) == ["k1", "k2", "k3", "k4", "x1", "x2", "z"]
    assert sorted(r.lang for r in benchmark(spark, left, FOLDER).collect()) == ["k1", "k2", "k3", "k4", "z"]
    assert sorted(r.lang for r in benchmark(spark, docs, FOLDER).collect()) == ["k1", "k2", "k2", "k3", "k4", "y", "z", "z"]
    assert sorted(r.lang for r in near(spark, docs, FOLDER).collect() if r.lang[0] in "kyz") == ["k1", "k2", "k3", "k4", "z"]
    kept = near(spark, left, FOLDER)
    assert {r.lang for r in kept.collect()} >= {"k1", "k2", "k3", "k4", "z"}
    assert encode(spark, docs, FOLDER).count() == len(rows)


def test_registry():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered
    names = set(registered())
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(oracle_sql()) <= names
    assert [n.split("_")[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "simhash", "benchmark", "byte"]
    assert os.path.exists(P.path("byte_bpe_50k.tiktoken"))
