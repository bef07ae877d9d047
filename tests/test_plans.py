"""Plans that must hold at any size."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from helpers import packets
from tidegauge.operators import lists, traffic
from tidegauge.plans import spread
from tidegauge.verify import queries as registered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = ["d1_tick_counters", "d3_ip_stats", "d3_ip_stats_cumulative", "d5_flow_count", "d7_ip_entropy", "e1_counter_rates",
         "e3_baseline_prior", "e7_adapt_profile", "e9_syn_excess", "e10_packet_verdict", "e13_cumulate", "e16_rate_limit",
         "f1_top_sources", "h1_h19_flow_features", "h20_source_windows", "h_flow_features_true", "j1_prepare_flows",
         "j3_split", "score_ticks"]


@pytest.mark.parametrize("name", BATCH)
def test_no_global_window_no_python_no_cross_join(spark, name):
    text = plan(registered.all_queries()[name](spark, SF))
    assert not re.search(r"Python|MapInPandas|ArrowEval", text)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    # A window node prints its functions, its partition keys and its order: the keys must not be empty.
    for line in text.splitlines():
        if re.search(r"[-+:] *Window \[", line):
            assert not re.search(r"\], \[\], \[", line), line


def test_scan_reads_only_what_is_used(spark):
    text = plan(traffic.tick_counters(registered.A.packets(spark, SF), 60))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "props" not in scan and "user_id" in scan


def test_top_lists_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registered.f1_top_sources(spark, SF))
    assert "TakeOrderedAndProject" in plan(registered.f1_top_sources_all(spark, SF).sort(F.desc("packets")).limit(5))


def test_partial_sums_before_the_shuffle(spark):
    text = plan(registered.d1_tick_counters(spark, SF))
    assert "partial_count" in text


def test_list_join_by_size(spark):
    df = packets(spark, [{"src": i % 3} for i in range(30)])
    bl = spark.range(2).select(F.lit("a").alias("link_id"), F.col("id").alias("src_ip"))
    short = spread.sized_join(df, bl, lists.KEY, ["ts", "seq"], "left_anti")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        long = spread.sized_join(df, bl, lists.KEY, ["ts", "seq"], "left_anti", max_rows=1)
        assert "BroadcastHashJoin" in plan(short) and "SortMergeJoin" in plan(long)
        assert sorted(r.seq for r in short.collect()) == sorted(r.seq for r in long.collect()) == list(range(2, 30, 3))
        spans = spark.createDataFrame([("a", 1, 5, 9)], "link_id string, src_ip long, lo long, hi long")
        timed = df.withColumn("us", F.col("seq"))
        for limit in (10, 0):
            got = spread.sized_join(timed, spans, lists.KEY, ["ts", "seq"], "left", ("us", "lo", "hi"), limit)
            assert got.count() == 30 and [r.seq for r in got.filter("lo IS NOT NULL").collect()] == [7]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salting_spreads_a_hot_key(spark):
    df = spread.with_salt(packets(spark, [{"src": 1} for _ in range(800)]), ["ts", "seq"])
    sizes = [r["count"] for r in df.groupBy("__salt").count().collect()]
    assert len(sizes) == spread.SALTS and max(sizes) < 120


def test_intermediate_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/settled-*"))
    assert spread.settle(spark.range(5)).count() == 5
    assert len(set(glob.glob(f"{folder}/settled-*")) - before) == 1
