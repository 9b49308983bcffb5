from collections import defaultdict

import numpy as np
import pytest
from common_cases import LONG, awkward, empty

from quiremill.llm import repeats as R


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        assert r.n_words == r.end_word - r.first_word
        out[r.doc_id] |= set(range(r.first_word, r.end_word))
    return out


def plain(texts, n):
    """Words of every document that lie in a run of n words that stands in another document too."""
    where, out = defaultdict(list), defaultdict(set)
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            where[tuple(w[i:i + n])].append((d, i))
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                out[d] |= set(range(i, i + n))
    return out


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert covered(R.repeated_passages(docs).collect()) == want and want


@pytest.mark.parametrize("partitions", [1, 9])
def test_a_passage_that_very_many_share(spark, partitions):
    rnd = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rnd.integers(0, 10**9, n)]
    common, other = words(80), words(60)
    rows = []
    for i in range(300):
        parts = words(rnd.integers(0, 40))
        if i % 3 == 0:
            parts += common
        if i % 50 == 1:
            parts += other
        rows.append((i, " ".join(parts + words(rnd.integers(0, 40)))))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = covered(R.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == plain(rows, 50)


def test_length_limit_and_repeats_inside_one_document(spark):
    w = [f"q{i}" for i in range(200)]
    rows = [(1, " ".join(["a", *w[:49], "b"])), (2, " ".join(["c", *w[:49], "d"])), (3, " ".join(w[100:160])), (4, " ".join(["x", *w[100:150], "y"])),
            (5, " ".join(w[60:90] * 4))]
    got = R.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(3, 0, 50, 50), (4, 1, 51, 50)]


def test_minimisers_are_the_same_wherever_a_passage_stands():
    rnd = np.random.default_rng(1)
    p = rnd.integers(0, 2**63, 120).astype(np.uint64)
    for k in (0, 7, 90):
        at, g = R.minimisers(np.concatenate([rnd.integers(0, 2**63, k).astype(np.uint64), p, rnd.integers(0, 2**63, 30).astype(np.uint64)]), 25, 26)
        inside = {(int(a) - k, int(x)) for a, x in zip(at, g) if k + 24 <= a <= k + 120 - 50}
        if k == 0:
            first = {(a, x) for a, x in inside}
        assert {(a, x) for a, x in inside if a >= 24} == {(a, x) for a, x in first if a >= 24}


def test_awkward_documents(spark):
    got = {(r.doc_id, r.first_word, r.end_word) for r in R.repeated_passages(awkward(spark)).collect()}
    n = len(LONG.split())
    assert got == {(6, 0, n), (7, 0, n)}
    assert R.repeated_passages(empty(spark)).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_passages_hidden_by_others_that_share_more_on_one_side(spark, partitions):
    rnd = np.random.default_rng(5)
    words = lambda n: [f"v{x}" for x in rnd.integers(0, 10**9, n)]
    rows = []
    for family in range(12):  # near copies of one stretch, and one document with two of them
        stretch = words(74)
        copies = [[w if rnd.random() > 0.05 else words(1)[0] for w in stretch] for _ in range(40)]
        copies[0] += copies.pop()
        rows += [(100 * family + i, " ".join(c)) for i, c in enumerate(copies)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = covered(R.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == plain(rows, 50)


def test_tables_between_steps_are_compressed_columns(spark):
    from quiremill.llm import repeats
    df = spark.range(1000).selectExpr("id as gram", "id div 10 as doc", "array(cast(id as int), null) as places", "cast(null as binary) as after")
    kept = repeats._written(df)
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect())) and kept.dtypes == df.dtypes
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
