import hashlib
import re
from collections import Counter, defaultdict

import pytest
from common_cases import ROWS, awkward, empty
from pyspark.sql import functions as F

from quiremill.llm import exact_dedup as X


def plain(rows):
    """The rule in plain Python: rows (id, text) -> counter of (id, keep_id, size, kept)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for members in groups.values():
        keep = min((m for m in members if m is not None), default=None)
        done = False
        for m in members:
            out[(m, keep, len(members), m == keep and not done)] += 1
            done = done or m == keep
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


def weak(content):
    """Many texts share such a digest."""
    return F.substring(F.sha2(content, 256), 1, 1)


@pytest.mark.parametrize("digest", [X.sha256_of, weak, lambda c: F.lit("same")])
def test_awkward_documents(spark, digest):
    assert found(X.exact_duplicates(awkward(spark), digest=digest)) == plain(ROWS)


def test_digest_is_that_of_the_normalised_text(spark):
    got = {r.doc_id: r.digest for r in X.exact_duplicates(awkward(spark)).collect()}
    assert got[5] == hashlib.sha256(b"one two three").hexdigest() and got[3] == hashlib.sha256(b" ").hexdigest()


@pytest.mark.parametrize("digest", [X.sha256_of, weak])
def test_a_third_of_all_rows_are_one_text(spark, digest):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(X.exact_duplicates(df, 4, digest)) == plain(rows)


def test_rows_that_stay(spark):
    got = X.without_exact_duplicates(awkward(spark))
    assert got.columns == awkward(spark).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, None), (3, "  \n\t "), (4, "one two three"), (6, ROWS[8][1]), (8, ROWS[10][1]), (9, ROWS[11][1])])


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert found(X.exact_duplicates(df)) == Counter({(None, None, 2, True): 1, (None, None, 2, False): 1, (None, None, 1, True): 1})
    assert sorted(r.text for r in X.without_exact_duplicates(df).collect()) == ["a", "b"]


def test_many_equal_rows_without_an_id(spark):
    """They are neither one task nor one array: each partition sends one of them, and the rows stay where they are."""
    rows = spark.range(0, 300_000, 1, 7).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"),
                                                F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"))
    got = X.exact_duplicates(rows)
    assert got.filter("digest = sha2('hot', 256)").groupBy("keep_id", "group_size", "kept").count().orderBy("kept").collect() == [
        (None, 100_000, False, 99_999), (None, 100_000, True, 1)]
    spread = got.filter("digest = sha2('hot', 256)").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 3
    assert X.without_exact_duplicates(rows).groupBy("text").count().filter("count > 1").isEmpty() and X.without_exact_duplicates(rows).count() == 51
    plan = X.without_exact_duplicates(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_groups_beyond_the_broadcast_bound(spark):
    rows = [(i % 40 or None, f"text {i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (1, 8, 1000):
        assert found(X.exact_duplicates(df, hot=hot)) == plain(rows)


def test_empty(spark):
    assert X.exact_duplicates(empty(spark)).count() == 0 and X.without_exact_duplicates(empty(spark)).count() == 0


def test_no_python_on_the_way(spark):
    plan = X.exact_duplicates(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
