"""The two-level helpers must equal plain windows, whatever the bucket width, with hot and null keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quiremill.functions import ordered


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows, pos = [], 0
    for _ in range(600):
        pos += rnd.choice([0, 1, 1, 5, 40])
        key = rnd.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((key, pos, rnd.randint(0, 10 ** 6), rnd.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, "k string, pos long, tie long, v int").cache()


@pytest.mark.parametrize("width", [1, 7, 100, 1 << 16])
def test_running_sum_max_and_neighbours(data, width):
    w = Window.partitionBy("k").orderBy("pos", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = data.select("*", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"),
                       F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"))
    got = ordered.running(data, ["k"], "pos", {"s": ("sum", F.coalesce("v", F.lit(0))), "m": ("max", F.col("v"))}, ["tie"], width)
    got = ordered.row_number(got, ["k"], "pos", "n", ["tie"], width)
    got = ordered.neighbour(got, ["k"], "pos", "before", F.col("v"), ["tie"], width)
    got = ordered.neighbour(got, ["k"], "pos", "after", F.col("v"), ["tie"], width, ahead=True)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_group_total(data):
    got = ordered.with_group_total(data.filter("k is not null"), ["k"], F.count("*").alias("n"))
    want = {r.k: r["count"] for r in data.groupBy("k").count().collect()}
    assert all(want[r.k] == r.n for r in got.collect())
