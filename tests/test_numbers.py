"""Numbers, column names and colours without limits."""

from pyspark.sql import functions as F

from quiremill.operators import frames as G
from quiremill.operators import tables as T


def test_number_text_carries_the_double(spark):
    cases = {"1,240": "1240", "-0": "0", "+7.50": "7.5", "1.23456789": "1.23456789", "0.12345678901234567890": "0.12345678901234568",
             "123456789012345678901": "123456789012345680000", "1234567890123456789012": "1.2345678901234568e+21", "0.00000012": "1.2e-7",
             "0.000001": "0.000001", "12345678901234567.5": "12345678901234568", "0.0": "0"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: (r.t, r.v) for r in df.select("c", T.number_text(F.col("c")).alias("t"), T.number_value(F.col("c")).alias("v")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert all(v[1] == float(k.replace(",", "")) for k, v in got.items())


def test_column_names_have_no_end(spark):
    def name(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out
    wanted = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 12_356_630, 10**12]
    got = spark.createDataFrame([(n,) for n in wanted], "i long").select("i", T.col_name(F.col("i")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {n: name(n) for n in wanted}


def test_every_pixel_counts(spark):
    px = spark.range(1).select(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.array(F.when(i == 4999, 9).otherwise(0), F.lit(0), F.lit(0)))).alias("px"))
    assert px.select(G.color_count(F.col("px"), 3)).first()[0] == 2
