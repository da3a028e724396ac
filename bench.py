"""Time the headline queries and print one JSON line.

Each query runs once, writing to the no-op sink, so the whole result is computed and nothing is
collected. The session is warmed up by one small query.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "axis_score", "shortlist_floor", "dedup_first_wins", "text_normalisers", "stopword_language",
    "gate_experience", "gate_rollup", "near_dup_collapse", "company_match",
    "final_gate", "repeat_distance", "decision_validate", "detail_merge", "fetch_targets",
    "digest_cards", "robots_allowed", "salary_facts", "work_mode_facts", "overall_bands",
    "run_progress", "tracker_dashboard", "skill_gaps", "salary_long", "shortlist",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("siftline-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from siftline.catalog import QUERIES

    QUERIES["source_counts"](spark, sf).collect()
    times = {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
