"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from codequarry.plans.registry import QUERIES

HEADLINE = ("q01_tool_summary", "q02_rule_severity_pivot", "q03_two_level_rollup", "q05_floor_quantiles", "q06_cumulative_survival", "q10_topk_per_family", "q13_hydrate_composite_key", "q20_asof_checkpoint", "q23_exact_multiplicity_match", "q24_nearest_greedy_match", "q31_rollup_footer", "q35_blame_ratio", "r11_repositories", "r16_tool_stats", "r33_survival_over_time", "h01_checkpoints")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
