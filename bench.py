"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run whole into Spark's no-op sink, so nothing is collected and nothing is pruned away. `calibration` is a fixed
job without this library (hash, sort and sum of ten million numbers): seconds of two machines compare by its ratio.
"""

import json
import os
import sys
import time

from quiremill.plans.queries import QUERIES
from quiremill.session import local_session

HEADLINE = ("batch_common_targets unique_names document_text infer_word_spaces running_headers split_paragraphs find_gutter "
            "stitch_tables sheet_markup column_bounds glyph_fallback fonts_needed reuse_results match_replies stall_detect "
            "merge_row_pieces restore_spaces").split()


def calibration(spark) -> float:
    from pyspark.sql import functions as F

    def job():
        n = spark.range(10_000_000).select(F.xxhash64("id").alias("h"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
        n.repartition(8, "h").sortWithinPartitions("h").agg(F.sum(F.length("s")), F.max("h")).collect()
    job()
    t0 = time.time()
    job()
    return round(time.time() - t0, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    fixed = calibration(spark)
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").split("sf")[-1], "cpus": cores, "calibration": fixed}))


if __name__ == "__main__":
    main()
