"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query's figure is the median of five runs, planning included. ``yardstick``
is a fixed job timed alike before and after all others, a scan that hashes
every document, and tells a slower or busier machine from a slower query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from pagemill.plans import all_queries  # noqa: E402

HEADLINE = ["page_links", "clean_url", "item_table", "scoped_items", "main_content", "page_title", "block_scores",
            "text_compact", "rule_extract", "three_stage", "follow_links", "rule_page_join", "insert_if_absent",
            "upsert_merge", "resolve_attempts", "crawl_counts", "json_items", "regex_many", "squeeze_ws",
            "containment_join", "drop_after_marker", "stream_insert_if_absent"]


RUNS = 5


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pagemill-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("pagemill.parse.partitions", cpus).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    jobs = all_queries()
    # start the JVM's code paths and the Python workers before timing
    for name in ("main_content", "insert_if_absent"):
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    def timed(job) -> list[float]:
        runs = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        return sorted(runs)

    def yardstick(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sha2(text, 512) as h").distinct()

    before = timed(yardstick)
    runs = {name: timed(jobs[name]) for name in names}
    after = timed(yardstick)
    seconds = {name: round(median(r), 3) for name, r in runs.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": RUNS,
                      "spread": {name: [round(r[0], 3), round(r[-1], 3)] for name, r in runs.items()},
                      "yardstick": [round(median(before), 3), round(median(after), 3)]}))


if __name__ == "__main__":
    main()
