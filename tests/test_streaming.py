"""A stream in several micro-batches gives what the batch operators give for the ticks that have closed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import at, packets
from tidegauge.config import TICK, DetectionConfig, FeatureConfig
from tidegauge.operators import features, ordered, traffic
from tidegauge.plans import detection
from tidegauge.sources.tables import read_alerts, stream_packets
from tidegauge.streaming import jobs, processors

CFG = DetectionConfig(scope=TICK, tick_seconds=10.0, attack_pps=3.0, alert_pps=1.5, baseline_samples=12,
                      min_entropy=1.0, block_packets=5, cooldown_seconds=25.0)
N = 40


def rows(seed=6):
    rng, out = random.Random(seed), []
    for tick in range(N):
        heavy = 40 if tick % 9 == 5 else 8
        for _ in range(rng.randrange(4, heavy)):
            out.append({"t": tick * 10 + rng.random() * 9.9, "src": 1 if rng.random() < 0.6 else rng.randrange(2, 9),
                        "proto": rng.choice([6, 6, 6, 17, 1]), "flags": rng.choice([0, 2, 16]), "size": rng.randrange(60, 900)})
    out.sort(key=lambda r: r["t"])
    return out


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Packets in time order in three files, and a late sentinel packet that closes the last window."""
    data, folder = rows(), str(tmp_path_factory.mktemp("packets"))
    df = packets(spark, data)
    step = len(data) // 3 + 1
    for k in range(3):
        (df.filter(F.col("seq").between(k * step, (k + 1) * step - 1)).coalesce(1)
         .write.mode("append").parquet(folder))
    packets(spark, [{"t": N * 10 + 5, "src": 99, "seq": 10_000}]).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def source(spark, folder):
    return stream_packets(spark, folder, files_per_trigger=1)


def run(spark, df, tmp_path, mode="append"):
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")), q


def same(a, b, columns):
    def plain(df):
        kinds = dict(df.dtypes)
        return sorted(str(tuple(r)) for r in df.select(
            *[F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]).collect())
    assert plain(a) == plain(b)


def test_ticks_and_sources(spark, fixture, tmp_path):
    df, folder = fixture
    got, q = run(spark, jobs.stream_ticks(source(spark, folder), 10.0), tmp_path / "a")
    assert len(q.recentProgress) >= 3
    same(got, traffic.tick_counters(df, 10.0), ["tick_start", *traffic.COUNTERS])
    got, _ = run(spark, jobs.stream_ip_stats(source(spark, folder), 10.0), tmp_path / "b")
    same(got, traffic.ip_stats(df, 10.0), ["tick_start", "src_ip", "packets", "bytes", "syn_count", "udp_count"])


def test_running_source_totals(spark, fixture, tmp_path):
    df, folder = fixture
    q = (jobs.stream_ip_stats(source(spark, folder), None).writeStream.format("memory").queryName("totals")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("totals").filter("src_ip <> 99")
    same(got, traffic.ip_stats(df), ["src_ip", "packets", "bytes", "syn_count"])


def test_baseline(spark, fixture, tmp_path):
    df, folder = fixture
    got, _ = run(spark, processors.stream_baseline(jobs.stream_rates(source(spark, folder), 10.0), 12), tmp_path)
    rates = ordered.tick_rates(traffic.protocol_ratios(traffic.tick_counters(df, 10.0)))
    want = ordered.baseline(rates, 12)
    same(got.withColumn("samples", F.col("samples")), want.withColumn("samples", F.col("history")),
         ["tick_start", "samples", "mean_pps", "std_pps", "pps_sigma", "change_rate"])


def test_scores(spark, fixture, tmp_path):
    df, folder = fixture
    jobs.stream_scores(source(spark, folder), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"),
                       CFG).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = detection.score_table(detection.tick_table(traffic.source_ticks(df, 10.0), CFG), CFG)
    same(got.withColumn("reasons", F.concat_ws("|", "reasons")), want.withColumn("reasons", F.concat_ws("|", "reasons")),
         ["tick_start", "n", "score", "is_anomaly", "pps_sigma", "change_rate", "ip_entropy", "reasons"])
    with pytest.raises(ValueError):
        jobs.score_batch(None, DetectionConfig(), None, 0)


def test_cooldown(spark, tmp_path):
    rng = random.Random(7)
    times = sorted(rng.uniform(0, 3000) for _ in range(400))
    df = spark.createDataFrame([("a", rng.choice("xy"), at(t), i) for i, t in enumerate(times)],
                               "link_id string, type string, timestamp timestamp, seq long")
    for k in range(2):
        df.filter(F.col("seq").between(k * 200, k * 200 + 199)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, _ = run(spark, processors.stream_cooldown(stream, 60), tmp_path)
    same(got, ordered.cooldown(df, 60), ["type", "seq"])


def test_profile(spark, fixture, tmp_path):
    df, folder = fixture
    got, _ = run(spark, processors.stream_profile(jobs.stream_rates(source(spark, folder), 10.0), 120.0), tmp_path)
    rates = ordered.tick_rates(traffic.protocol_ratios(traffic.tick_counters(df, 10.0)))
    profile = ordered.learn_profile(rates, 120.0)
    later = ordered.adapt_profile(rates, profile, 120.0)
    assert got.count() == later.count() + 1
    same(got.join(later.select("tick_start"), "tick_start", "left_semi"), later,
         ["tick_start", "avg_pps", "peak_pps", "avg_bps", "peak_bps"])
    jobs.profile_sink(processors.stream_profile(jobs.stream_rates(source(spark, folder), 10.0), 120.0),
                      str(tmp_path / "profiles"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "profiles")).filter("is_learned").count() > 0


def test_features(spark, fixture, tmp_path):
    df, folder = fixture
    cfg = FeatureConfig(window_samples=7)
    jobs.stream_features(source(spark, folder), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), 10.0,
                         cfg=cfg).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    ticks = (traffic.source_ticks(df, 10.0).groupBy("link_id", "tick_start")
             .agg(*[F.sum(f"all_{c}").alias(c) for c in ("packets", "bytes", "tcp_packets", *features.FLAG_COUNTERS)])
             .withColumn("tick_seconds", F.lit(10.0)))
    want = features.flow_features(ticks, cfg)
    same(got, want, ["tick_start", "Flow Duration", "Total Fwd Packets", "Fwd Packet Length Std", "Packet Length Variance",
                     "Flow IAT Mean", "SYN Flag Count", "Flow Bytes/s"])


def test_closed_loop_blocks_sources(spark, fixture, tmp_path):
    df, folder = fixture
    jobs.run_closed_loop(source(spark, folder), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"),
                         CFG).awaitTermination()
    alerts = read_alerts(spark, str(tmp_path / "out" / "alerts")).orderBy("timestamp").collect()
    assert alerts and all((b.timestamp - a.timestamp).total_seconds() >= 25 for a, b in zip(alerts, alerts[1:]))
    scores = spark.read.parquet(str(tmp_path / "out" / "scores"))
    # Source 1 is listed after the first alert it tops and is dropped from the next batch on.
    assert scores.agg(F.sum("dropped_packets")).first()[0] > 0
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state" / "blacklist").iterdir() if "=" in p.name)
    listed = spark.read.parquet(str(tmp_path / "state" / "blacklist" / f"batch={last}")).collect()
    assert 1 in {r.src_ip for r in listed}


def test_a_batch_can_run_again(spark, fixture, tmp_path):
    df, _ = fixture
    state = jobs.scoring_state(spark, str(tmp_path / "state"))
    sources = traffic.source_ticks(df, 10.0)
    first = jobs.score_batch(state, CFG, sources, 0).select("tick_start", "score").collect()
    again = jobs.score_batch(state, CFG, sources, 0).select("tick_start", "score").collect()
    assert sorted(first) == sorted(again)


def test_sliding_sessions_and_late_rows(spark, fixture, tmp_path):
    df, folder = fixture
    got, _ = run(spark, jobs.sliding_counters(source(spark, folder), 30.0, 10.0), tmp_path / "s")
    whole = got.filter((F.col("window_start") >= at(0)) & (F.col("window_start") <= at(N * 10 - 30)))
    total = df.filter(F.col("ts").between(at(100), at(129.999999))).count()
    assert whole.count() == N - 2
    assert whole.filter(F.col("window_start") == at(100)).first().packets == total

    late = str(tmp_path / "late")
    for part in ([{"t": 100}], [{"t": 200}], [{"t": 1}, {"t": 2}], [{"t": 300}]):
        packets(spark, part).coalesce(1).write.mode("append").parquet(late)
    got, q = run(spark, jobs.stream_ticks(source(spark, late), 10.0), tmp_path / "l")
    assert jobs.late_count(q) >= 1 and got.filter(F.col("tick_start") == at(0)).count() == 0

    hot = spark.createDataFrame([("a", at(t), True, 60.0) for t in (0, 10, 20, 200, 900)],
                                "link_id string, tick_start timestamp, is_anomaly boolean, score double")
    hot.coalesce(1).write.parquet(str(tmp_path / "hot"))
    stream = spark.readStream.schema(hot.schema).parquet(str(tmp_path / "hot"))
    got, _ = run(spark, jobs.stream_episodes(stream, "60 seconds"), tmp_path / "e")
    assert sorted(r.ticks for r in got.collect()) == [1, 3]


def test_alert_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", at(0), "x")], "link_id string, timestamp timestamp, type string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.alert_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [r["type"] for r in lines] == ["x"]
