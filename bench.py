"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidegauge.verify.queries import all_queries  # noqa: E402

HEADLINE = [
    "d1_tick_counters", "d3_ip_stats", "d4_flow_stats", "d5_flow_count", "d7_ip_entropy", "d8_topk_share",
    "d7_d9_cumulative", "c1_apply_blacklist", "c2_apply_blacklist_asof", "c4_match_signatures", "e3_baseline_prior",
    "e7_adapt_profile", "e9_syn_excess", "e10_packet_verdict", "e13_cumulate", "e15_cooldown", "e16_rate_limit",
    "f1_top_sources", "score_ticks", "score_ticks_cumulative", "h1_h19_flow_features", "h_flow_features_true",
    "j1_prepare_flows", "j2_balance", "j3_split", "j5_scale_pop", "j6_random_forest", "j9_predict", "d15_weighted_scores",
    "k1_stream_ticks", "k3_stream_baseline", "k5_stream_cooldown", "l1_status_snapshot",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, seconds = all_queries(), {}
    # The first query would carry the time to load and compile what all of them need.
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
