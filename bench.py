"""Headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; prints one JSON line. Every query writes all its rows to a sink that drops them."""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = """win_w2_history win_w3_completed_history win_w3_delta_history win_w5_scope_context win_w9_scan_context join_j1_interval_match join_j2_range_join join_j3_as_of join_j6_clean_exclusion
agg_a1_profile agg_a6_identity_dedup agg_a7_leakage agg_a11_session_build agg_a14_episodes agg_a19_shortcut_tokens ses_z1_idle_timeout spl_z10_hash_split smp_z19_round_robin evl_e6_auroc evl_e9_bootstrap txt_r6_bm25""".split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidewell import plans

    found, took = plans.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first compiles
            began = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
