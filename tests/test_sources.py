from pyspark.sql import functions as F

from helpers import at, packets
from tidegauge.operators import ranking, status
from tidegauge.sources import tables


def test_default_profile(spark, tmp_path):
    row = tables.read_profile(spark, str(tmp_path / "none")).first()
    assert (row.tcp_ratio, row.udp_ratio, row.icmp_ratio, row.is_learned) == (0.85, 0.10, 0.05, False)
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert tables.read_profile(spark, str(bad)).first().is_learned is False


def test_profile_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 3.0, True)], "link_id string, avg_pps double, is_learned boolean")
    tables.write_profile(df, str(tmp_path / "p"))
    row = tables.read_profile(spark, str(tmp_path / "p")).first()
    assert (row.link_id, row.avg_pps, row.is_learned, row.tcp_ratio) == ("a", 3.0, True, 0.85)


def test_a_learned_profile_survives(spark, tmp_path):
    """Every column of a real profile, and a record that cannot be read beside it."""
    from tidegauge.operators import ordered
    from tidegauge.schemas import PROFILE
    rates = spark.createDataFrame([("a", at(i), float(i), 2.0 * i, 10, 0.5, 0.3, 0.2) for i in range(20)],
                                  "link_id string, tick_start timestamp, pps double, bps double, proto_packets long, "
                                  "tcp_ratio double, udp_ratio double, icmp_ratio double")
    learned = ordered.learn_profile(rates, 10.0)
    tables.write_profile(learned, str(tmp_path / "p"))
    (tmp_path / "p" / "part-bad.json").write_text("{not json\n")
    want, got = learned.first(), tables.read_profile(spark, str(tmp_path / "p")).collect()
    assert len(got) == 1 and set(learned.columns) <= {"link_id", *PROFILE.fieldNames()}
    assert all(got[0][c] == want[c] for c in learned.columns) and got[0].unique_ips_per_minute == 0.0


def test_all_blocked_sources_are_counted(spark):
    rows = spark.range(12_000).selectExpr("'a' AS link_id", "id AS src_ip", "timestamp '2024-01-01' AS added_at",
                                          "cast(null AS timestamp) AS removed_at")
    assert status.active_blocks(rows).count() == 12_000


def test_alerts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(at(i), "ddos_attack", "high", f"m{i}", (["r"], {"pps": 1.5}, 2.0, 1.0)) for i in range(12)],
                               tables.ALERTS)
    path = str(tmp_path / "alerts")
    tables.write_alerts(df.filter(F.col("timestamp") < at(6)), path)
    tables.write_alerts(df.filter(F.col("timestamp") >= at(10)), path)
    back = tables.read_alerts(spark, path)
    assert back.count() == 8
    recent = ranking.recent_alerts(back, 3).collect()
    assert [r.message for r in recent] == ["m11", "m10", "m5"] and recent[0].details.metrics == {"pps": 1.5}
    assert {(r.type, r.alerts) for r in ranking.alert_rollup(back).collect()} == {("ddos_attack", 8)}


def test_packets_and_counters(spark, tmp_path):
    packets(spark, [{"src": 1}, {"src": 2}]).write.parquet(str(tmp_path / "p"))
    assert tables.read_packets(spark, str(tmp_path / "p")).filter("src_ip = 2").count() == 1
    spark.createDataFrame([("a", 0, at(0), 5)], "link_id string, cpu int, ts timestamp, packets long").write.parquet(
        str(tmp_path / "c"))
    row = tables.read_counters(spark, str(tmp_path / "c")).first()
    assert (row.packets, row.bytes, row.udp_packets) == (5, 0, 0)


def test_metric_text(spark):
    df = spark.createDataFrame([("a", 5, 700, 12.5)], "link_id string, packets long, bytes long, cpu_percent double")
    rows = tables.to_metric_rows(df)
    assert rows.count() == 8
    text = tables.metric_text(rows).first().text
    assert text.startswith("# HELP ddos_total_packets Total packets processed\n# TYPE ddos_total_packets counter\n"
                           "ddos_total_packets 5\n")
    assert "\nddos_cpu_percent 12.5\n" in text and text.endswith("ddos_uptime_seconds 0") and text.count("\n") == 23


def test_episodes(spark):
    df = spark.createDataFrame([("a", at(t), t < 1000, 50.0 + t) for t in (0, 10, 20, 100, 105, 2000)],
                               "link_id string, tick_start timestamp, is_anomaly boolean, score double")
    got = status.attack_episodes(df, 30).orderBy("episode").collect()
    assert [(r.ticks, r.max_score) for r in got] == [(3, 70), (2, 155)]


def test_flow_files_say_what_was_left_out(spark, tmp_path):
    from tidegauge.sources.flows import flow_files, read_labelled_flows
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text(' Flow Duration, Label\n1,BENIGN\n"2",Syn\n Flow Duration, Label\n\n')
    (tmp_path / "deep" / "b.csv").write_text("Label,SYN Flag Count\nSyn,9\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("\n1,2\n")
    (tmp_path / "e e.csv").write_text("x,y\n1,2\n")
    (tmp_path / "note.txt").write_text("no flow file\n")
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in flow_files(spark, str(tmp_path)).collect()}
    assert reasons == {"a.csv": None, "b.csv": None, "c.csv": "empty", "d.csv": "no header", "e%20e.csv": "no label"}
    rows = read_labelled_flows(spark, str(tmp_path))
    assert rows.columns == ["Flow Duration", "Label", "SYN Flag Count", "source_file"]
    assert sorted((r[0] or "", r[1], r[2] or "") for r in rows.collect()) == [("", "Syn", "9"), ("1", "BENIGN", ""), ("2", "Syn", "")]
    assert read_labelled_flows(spark, str(tmp_path), max_files=1).count() == 2


def test_flow_files_of_several_sources_are_written_by_several_tasks(spark, tmp_path):
    from tidegauge.sources.flows import flow_files
    from tidegauge.verify import queries
    n = F.col("id")
    (spark.range(700).select(n.alias("l_orderkey"), n.alias("l_partkey"), n.alias("l_suppkey"), (n % 7 + 1).alias("l_linenumber"),
                             (n % 50 + 1.0).alias("l_quantity"), (n + 0.5).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
                             F.lit(0.1).alias("l_tax"), F.lit("N").alias("l_returnflag")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc = spark.sparkContext
    sc.setJobGroup("flow files", "")
    try:
        folder = queries._flow_folder(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("flow files") for s in tracker.getJobInfo(j).stageIds]
    # The table is one file, so only what is dealt out by source has more than one task.
    assert max(s.numTasks for s in stages if s) == 4
    read = flow_files(spark, folder).filter("reason is null").selectExpr("regexp_extract(file, 'source_file=(\\\\w+)', 1) as f")
    assert sorted(r.f for r in read.collect()) == [f"file{i}" for i in range(1, 8)]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
