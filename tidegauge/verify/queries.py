"""One query per operator over the driver's tables. Times are given as epoch microseconds, floats to 6 places."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidegauge import adapters as A
from tidegauge.config import TICK, DetectionConfig, FeatureConfig, TrainingConfig
from tidegauge.functions import columns as C
from tidegauge.operators import evaluate, features, learn, lists, models, ordered, ranking, rules, status, traffic
from tidegauge.plans import detection
from tidegauge.plans.spread import numbered, settle, shared_folder
from tidegauge.schemas import COUNTER_SNAPSHOTS, COUNTERS, FEATURES, FLAG_COUNTERS, PACKETS
from tidegauge.sources.flows import flow_files, read_labelled_flows, sample_per_group, union_flows
from tidegauge.sources.tables import (
    load_model, read_alerts, read_counters, read_packets, read_profile, save_model, to_metric_rows, write_alerts, write_profile,
)
from tidegauge.streaming import bounded, jobs, processors

TICK_SECONDS = 21_600.0
PER_TICK = {"tick_seconds": TICK_SECONDS, "attack_pps": 52 / TICK_SECONDS, "alert_pps": 45 / TICK_SECONDS,
            "change_rate": 1.5, "normal_tcp": 0.5, "normal_udp": 0.25, "normal_icmp": 0.25,
            "protocol_deviation": 0.1, "min_entropy": 4.6, "top_share": 0.5, "syn_heavy": 2, "syn_limit": 5,
            "block_packets": 3, "learning_seconds": 7 * 86_400.0, "baseline_samples": 40}
CFG = DetectionConfig(scope=TICK, **PER_TICK)
CFG_CUM = DetectionConfig(**PER_TICK)


def _out(df, *columns, rounded=True, **made):
    """Select, with timestamps as microseconds and doubles rounded."""
    cols = [F.col(f"`{c}`").alias(c) for c in columns] + [c.alias(n) for n, c in made.items()]
    df = df.select(*cols)
    final = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "timestamp":
            final.append(F.unix_micros(c).alias(f.name + "_us"))
        elif kind == "double" and rounded and f.name != "Flow Duration":
            final.append(F.round(c, 6).alias(f.name))
        else:
            final.append(c)
    return df.select(*final)


def _admitted(spark, sf):
    return traffic.admit(A.packets(spark, sf))


def _sources(spark, sf):
    return traffic.ip_stats(_admitted(spark, sf), TICK_SECONDS)


def _verdicts(spark, sf):
    return traffic.packet_verdict(_admitted(spark, sf), A.blacklist(spark, sf), CFG.syn_limit)


def _ticks(spark, sf, cfg=CFG):
    return detection.tick_table(traffic.source_ticks(_admitted(spark, sf), TICK_SECONDS), cfg)


# -- B: scalar functions ---------------------------------------------------------------------------

def b1_admission(spark, sf):
    return (A.packets(spark, sf).groupBy(C.admission().alias("admission"))
            .agg(F.count(F.lit(1)).alias("packets")))


def b2_protocol_class(spark, sf):
    return (A.packets(spark, sf).groupBy(C.protocol_class().alias("protocol_class"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")))


def b3_is_syn(spark, sf):
    return _out(A.packets(spark, sf), "seq", syn=C.is_syn())


def b4_flow_ports(spark, sf):
    return _out(_admitted(spark, sf), "seq", "src_port", "dst_port", "tcp_flags")


def b5_ip_text(spark, sf):
    address = F.col("src_ip") * 65537 + 167_772_160
    df = A.packets(spark, sf).withColumn("address", address)
    return _out(df, "seq", ip=C.ip_to_string("address"), back=C.ip_to_long(C.ip_to_string("address")))


def b6_norm_label(spark, sf):
    df = A.labelled_flows(spark, sf)
    return df.groupBy(F.upper(C.norm_label()).alias("label")).agg(F.count(F.lit(1)).alias("flows"))


def b7_encode_binary(spark, sf):
    return (A.labelled_flows(spark, sf).groupBy("label", C.encode_binary().alias("code"))
            .agg(F.count(F.lit(1)).alias("flows")))


def b9_decode_label(spark, sf):
    df = A.labelled_flows(spark, sf).withColumn("code", C.encode_binary())
    return (df.groupBy(C.decode_binary("code").alias("name"), C.decode_label_id(C.label_id()).alias("known"))
            .agg(F.count(F.lit(1)).alias("flows")))


def b10_label_id(spark, sf):
    return (A.labelled_flows(spark, sf).groupBy("label", C.label_id().alias("label_id"))
            .agg(F.count(F.lit(1)).alias("flows")))


def b11_to_number(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit("x"))).otherwise(F.col("value").cast("string"))
    return _out(A.read(spark, sf, "events").withColumn("text", text), "event_id", number=C.to_number("text"))


def _odd_values(spark, sf):
    """Values with NaN, infinities and extremes mixed in."""
    i, v = F.col("event_id"), F.col("value")
    odd = (F.when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).when(i % 17 == 0, float("-inf"))
           .when(i % 19 == 0, v * 1e12).otherwise(v))
    return A.read(spark, sf, "events").withColumn("x", odd)


def b12_clean_number(spark, sf):
    return _out(_odd_values(spark, sf), "event_id", cleaned=C.clean_number("x"))


def b13_nan_to_num(spark, sf):
    return _out(_odd_values(spark, sf), "event_id", cleaned=C.nan_to_num("x"))


def b15_ratio(spark, sf):
    df = A.read(spark, sf, "events").withColumn("d", F.col("event_id") % 5)
    return _out(df, "event_id", ratio=C.ratio("value", "d"))


def b18_severity(spark, sf):
    df = A.read(spark, sf, "events").withColumn("score", (F.col("event_id") % 101).cast("double"))
    return (df.groupBy(C.severity().alias("severity"), C.severity4().alias("severity4"))
            .agg(F.count(F.lit(1)).alias("rows")))


def b19_human_units(spark, sf):
    df = A.read(spark, sf, "orders").withColumn("n", F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 40 + 1)))
    return _out(df, "o_orderkey", count_text=C.human_count("n"), bytes_text=C.human_bytes("n"))


def b20_intensity_band(spark, sf):
    df = A.read(spark, sf, "orders").withColumn("pps", F.col("o_totalprice") * (F.col("o_orderkey") % 40))
    return df.groupBy(C.intensity_band("pps").alias("band")).agg(F.count(F.lit(1)).alias("rows"))


def b21_baseline_status(spark, sf):
    df = ordered.baseline(_ticks(spark, sf), CFG.baseline_samples)
    return df.groupBy("link_id", C.baseline_status("samples").alias("status")).agg(F.count(F.lit(1)).alias("ticks"))


def b24_gbps_band(spark, sf):
    df = A.read(spark, sf, "orders").withColumn("gbps", (F.col("o_orderkey") % 1000).cast("double"))
    return df.groupBy(C.gbps_band("gbps").alias("band")).agg(F.count(F.lit(1)).alias("rows"))


# -- C, G: lists -----------------------------------------------------------------------------------

def c1_apply_blacklist(spark, sf):
    kept = lists.apply_blacklist(_admitted(spark, sf), A.blacklist(spark, sf))
    dropped = lists.blacklisted_packets(_admitted(spark, sf), A.blacklist(spark, sf))
    return (kept.select("seq", F.lit(False).alias("listed"))
            .unionByName(dropped.select("seq", F.lit(True).alias("listed"))))


def c2_apply_blacklist_asof(spark, sf):
    return _out(lists.apply_blacklist_asof(_admitted(spark, sf), A.blacklist(spark, sf)), "seq")


def c4_match_signatures(spark, sf):
    return lists.match_signatures(_admitted(spark, sf), A.signatures(spark))


def g3_blacklist_add(spark, sf):
    new = (_sources(spark, sf).filter(F.col("packets") > 3)
           .select("link_id", "src_ip", F.col("tick_start").alias("added_at")))
    return _out(lists.blacklist_add(A.blacklist(spark, sf), new), "link_id", "src_ip", "added_at", "removed_at")


def g4_blacklist_remove(spark, sf):
    gone = (_sources(spark, sf).filter(F.col("packets") == 1)
            .groupBy("link_id", "src_ip").agg(F.max("tick_start").alias("removed_at")))
    return _out(lists.blacklist_remove(A.blacklist(spark, sf), gone), "link_id", "src_ip", "added_at", "removed_at")


def g5_blacklist_active(spark, sf):
    return _out(lists.blacklist_active(A.blacklist(spark, sf), "2024-01-25 00:00:00"), "link_id", "src_ip")


# -- D: aggregations -------------------------------------------------------------------------------

def d1_tick_counters(spark, sf):
    df = traffic.tick_counters(_verdicts(spark, sf), TICK_SECONDS)
    return _out(df, "link_id", "tick_start", *traffic.COUNTERS)


def d2_merge_counters(spark, sf):
    return _out(traffic.merge_counters(A.counters(spark, sf)), "link_id", "ts", "packets", "bytes", "tcp_packets",
                "udp_packets", "icmp_packets")


def d3_ip_stats(spark, sf):
    return _out(traffic.ip_stats(_verdicts(spark, sf)), "link_id", "src_ip", "packets", "bytes", "last_seen",
                "syn_count", "udp_count")


def d3_ip_stats_cumulative(spark, sf):
    return _out(traffic.ip_stats(_verdicts(spark, sf), TICK_SECONDS, "cumulative"), "link_id", "tick_start", "src_ip",
                "packets", "bytes", "syn_count", "udp_count")


def d4_flow_stats(spark, sf):
    return _out(traffic.flow_stats(_admitted(spark, sf)), "link_id", "src_ip", "dst_ip", "src_port", "dst_port",
                "protocol", "packets", "bytes", "first_seen", "last_seen", "flags")


def d5_flow_count(spark, sf):
    return traffic.flow_count(_admitted(spark, sf))


def d6_unique_ips(spark, sf):
    return _out(traffic.unique_ips_per_minute(_admitted(spark, sf)), "link_id", "minute_start", "unique_ips")


def d6_mean_unique_ips(spark, sf):
    return _out(traffic.mean_unique_ips(_admitted(spark, sf)), "link_id", "unique_ips_per_minute")


def d7_ip_entropy(spark, sf):
    return _out(traffic.ip_entropy(_sources(spark, sf)), "link_id", "tick_start", "ip_entropy")


def d8_topk_share(spark, sf):
    return _out(traffic.topk_share(_sources(spark, sf)), "link_id", "tick_start", "top_ratio")


def d9_syn_heavy(spark, sf):
    return _out(traffic.syn_heavy(_sources(spark, sf), 2), "link_id", "tick_start", "syn_heavy")


def d7_d9_cumulative(spark, sf):
    df = traffic.cumulative_concentration(_sources(spark, sf), 10, 10)
    return _out(df, "link_id", "tick_start", "sources", "ip_entropy", "top_ratio", "syn_heavy")


def d10_protocol_ratios(spark, sf):
    df = traffic.protocol_ratios(traffic.tick_counters(_admitted(spark, sf), TICK_SECONDS))
    return _out(df, "link_id", "tick_start", "tcp_ratio", "udp_ratio", "icmp_ratio")


def d18_throughput(spark, sf):
    df = traffic.tick_counters(_admitted(spark, sf), TICK_SECONDS).withColumn("seconds", F.col("tick_seconds"))
    return _out(traffic.throughput(df, "seconds", ["link_id"]), "link_id", "packets", "bytes", "pps", "mbps")


# -- E: along time ---------------------------------------------------------------------------------

def e1_counter_rates(spark, sf):
    df = ordered.counter_rates(traffic.merge_counters(A.counters(spark, sf)))
    return _out(df, "link_id", "ts", "seconds", "pps", "bps")


def e1_counter_rates_since(spark, sf):
    df = ordered.counter_rates(traffic.merge_counters(A.counters(spark, sf)), "2023-12-31 18:00:00")
    return _out(df, "link_id", "ts", "seconds", "pps", "bps")


def e2_tick_rates(spark, sf):
    df = ordered.tick_rates(traffic.tick_counters(_admitted(spark, sf), TICK_SECONDS))
    return _out(df, "link_id", "tick_start", "pps", "bps")


_BASE = ["history", "samples", "mean_pps", "std_pps", "mean_bps", "std_bps", "mean_tcp_ratio", "mean_udp_ratio",
         "mean_icmp_ratio", "pps_sigma", "change_rate"]


def e3_baseline_prior(spark, sf):
    return _out(ordered.baseline(_ticks(spark, sf), 40, "prior", chunk=50), "link_id", "tick_start", *_BASE)


def e3_baseline_inclusive(spark, sf):
    return _out(ordered.baseline(_ticks(spark, sf), 40, "inclusive", chunk=7), "link_id", "tick_start", *_BASE)


def c3_attach_baseline(spark, sf):
    ticks = settle(_ticks(spark, sf))
    base = ordered.baseline(ticks, 40).filter(F.col("n") % 8 == 0)
    stored = base.select("link_id", (F.col("tick_start") + F.expr("interval 3 hours")).alias("valid_from"), "mean_pps",
                         "std_pps", "history")
    df = ordered.attach_baseline(ticks, stored)
    return _out(df, "link_id", "tick_start", "valid_from", "mean_pps", "std_pps", "history")


def e9_syn_excess(spark, sf):
    return _out(traffic.syn_excess(_admitted(spark, sf), CFG.syn_limit), "seq", "syn_dropped")


def e10_packet_verdict(spark, sf):
    return _out(_verdicts(spark, sf), "seq", "blacklisted", "verdict")


def e11_inter_arrival(spark, sf):
    df = traffic.tick_counters(_admitted(spark, sf), 600.0)
    return _out(ordered.inter_arrival(df), "link_id", "tick_start", "iat_ms")


def e13_cumulate(spark, sf):
    df = ordered.cumulate(traffic.tick_counters(_admitted(spark, sf), TICK_SECONDS), ["packets", "bytes", "tcp_packets"])
    return _out(df, "link_id", "tick_start", "cum_packets", "cum_bytes", "cum_tcp_packets")


def e14_host_summary(spark, sf):
    return _out(ordered.host_summary(A.host_metrics(spark, sf)), "link_id", "avg_cpu_percent", "avg_memory_percent",
                "current_memory_mb", "samples")


def e15_cooldown(spark, sf):
    df = ordered.cooldown(A.alert_candidates(spark, sf), 3600.0, ts="ts", chunk_seconds=86_400.0)
    return _out(df, "link_id", "type", "seq", "ts")


def e16_rate_limit(spark, sf):
    df = _admitted(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return _out(traffic.rate_limit(df, 1), "seq", "over_limit")


# -- F: top lists ----------------------------------------------------------------------------------

def f1_top_sources(spark, sf):
    df = ranking.top_sources(traffic.ip_stats(_admitted(spark, sf)), 20)
    return _out(df, "link_id", "src_ip", "packets", "rank")


def f1_top_sources_all(spark, sf):
    return _out(ranking.top_sources(traffic.ip_stats(_admitted(spark, sf)), 100, per_link=False), "link_id", "src_ip",
                "packets")


def f2_top_flows(spark, sf):
    flows = traffic.flow_stats(_admitted(spark, sf).withColumn("src_port", F.lit(0)))
    return _out(ranking.top_flows(flows, 20), "link_id", "src_ip", "dst_ip", "dst_port", "protocol", "packets", "rank")


# -- I: scoring ------------------------------------------------------------------------------------

_SCORE = ["link_id", "tick_start", "score", "is_anomaly", "pps", "pps_sigma", "change_rate", "tcp_ratio", "udp_ratio",
          "icmp_ratio", "ip_entropy", "top_ratio", "syn_heavy"]


def _score_out(df):
    return _out(df, *_SCORE, reasons=F.concat_ws("|", "reasons"))


def score_ticks(spark, sf):
    return _score_out(detection.score_packets(A.packets(spark, sf), CFG, A.blacklist(spark, sf)))


def score_ticks_cumulative(spark, sf):
    return _score_out(detection.score_packets(A.packets(spark, sf), CFG_CUM, A.blacklist(spark, sf)))


def _scored(spark, sf):
    return detection.score_packets(A.packets(spark, sf), CFG)


def i13_alerts(spark, sf):
    return _alerts_out(rules.to_alerts(_scored(spark, sf), CFG))


def _alerts_out(df):
    return _out(df, "link_id", "timestamp", "type", "severity", "message",
                reasons=F.size("details.reasons").cast("long"), metrics=F.size("details.metrics").cast("long"),
                current_pps=F.col("details.current_pps"), baseline_pps=F.col("details.baseline_pps"))


def e15_kept_alerts(spark, sf):
    kept = ordered.cooldown(rules.to_alerts(_scored(spark, sf), CFG), 86_400.0)
    return _out(kept, "link_id", "timestamp", "severity")


def f3_block_candidates(spark, sf):
    scores = settle(_scored(spark, sf))
    kept, found = detection.respond(scores, _sources(spark, sf), CFG)
    return _out(found, "link_id", "tick_start", "src_ip", "packets", "rank")


def f3_block_candidates_since(spark, sf):
    kept = settle(ordered.cooldown(rules.to_alerts(settle(_scored(spark, sf)), CFG), CFG.cooldown_seconds))
    found = ranking.block_candidates_since(_sources(spark, sf), kept, CFG.block_top, 40)
    return _out(found, "link_id", "tick_start", "src_ip", "packets", "rank")


def f4_recent_alerts(spark, sf):
    df = ranking.recent_alerts(rules.to_alerts(_scored(spark, sf), CFG), 10)
    return _out(df, "link_id", "timestamp", "severity")


def d20_alert_rollup(spark, sf):
    df = ranking.alert_rollup(rules.to_alerts(_scored(spark, sf), CFG), 86_400)
    return _out(df, "span_start", "type", "severity", "alerts")


def i11_combine_scores(spark, sf):
    scores = _scored(spark, sf)
    ml = scores.filter(F.col("n") % 5 != 0).select(
        "link_id", "tick_start", (F.col("n") % 3 == 0).alias("is_attack"),
        (50 + F.col("packets") * 7 % 51).cast("double").alias("confidence"),
        F.lit(0.5).alias("attack_probability"), F.lit("SYN_Flood").alias("attack_type"))
    df = rules.combine_scores(settle(scores), ml, cfg=CFG)
    return _out(df, "link_id", "tick_start", "score", "is_anomaly", "ml_prediction", "ml_confidence", "attack_type",
                "detection_source", reasons=F.size("reasons").cast("long"), metrics=F.size("metrics").cast("long"))


def i14_decision_matrix(spark, sf):
    i = F.col("event_id")
    df = A.read(spark, sf, "events").select(
        (i % 101).alias("s"), (i % 97 + 4).alias("m"), (i % 89).alias("c"))
    return (df.groupBy(rules.decision_matrix("s", "m", "c").alias("decision")).agg(F.count(F.lit(1)).alias("rows")))


def d17_scoring_tally(spark, sf):
    scores = settle(_scored(spark, sf))
    ml = scores.filter(F.col("n") % 5 != 0).select(
        "link_id", "tick_start", (F.col("n") % 3 == 0).alias("is_attack"), F.lit(80.0).alias("confidence"),
        F.lit(0.5).alias("attack_probability"), F.lit("SYN_Flood").alias("attack_type"))
    return rules.scoring_tally(rules.combine_scores(scores, ml, cfg=CFG))


# -- profile ---------------------------------------------------------------------------------------

def _rates(spark, sf, seconds=TICK_SECONDS):
    return ordered.tick_rates(traffic.protocol_ratios(traffic.tick_counters(_admitted(spark, sf), seconds)))


_PROFILE = ["avg_pps", "peak_pps", "avg_bps", "peak_bps", "tcp_ratio", "udp_ratio", "icmp_ratio", "learning_samples"]


def d11_learn_profile(spark, sf):
    return _out(ordered.learn_profile(_rates(spark, sf), CFG.learning_seconds), "link_id", *_PROFILE)


def a8_a9_profile(spark, sf):
    """A learned profile that was written and read again."""
    path = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    write_profile(ordered.learn_profile(_rates(spark, sf), CFG.learning_seconds), path)
    return _out(read_profile(spark, path), "link_id", *_PROFILE, "learn_start")


def a10_a11_alerts(spark, sf):
    """Alerts appended in two writes and read again."""
    path = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    alerts = settle(rules.to_alerts(_scored(spark, sf), CFG))
    early = F.col("timestamp") < F.lit("2024-01-15").cast("timestamp")
    write_alerts(alerts.filter(early), path)
    write_alerts(alerts.filter(~early), path)
    return _alerts_out(read_alerts(spark, path))


def d21_relearn_profile(spark, sf):
    df = ordered.learn_profile(_rates(spark, sf), CFG.learning_seconds, "2024-01-15 03:00:00")
    return _out(df, "link_id", *_PROFILE, "learn_start")


def e7_adapt_profile(spark, sf):
    rates = settle(_rates(spark, sf))
    profile = ordered.learn_profile(rates, CFG.learning_seconds)
    df = ordered.adapt_profile(rates, profile, CFG.learning_seconds)
    return _out(df, "link_id", "tick_start", "avg_pps", "avg_bps", "peak_pps", "peak_bps")


def e7_current_profile(spark, sf):
    rates = settle(_rates(spark, sf))
    profile = ordered.learn_profile(rates, CFG.learning_seconds)
    df = ordered.current_profile(rates, profile, CFG.learning_seconds)
    return _out(df, "link_id", "avg_pps", "avg_bps", "peak_pps", "peak_bps", "last_updated")


def a13_metric_rows(spark, sf):
    totals = _rates(spark, sf).groupBy("link_id").agg(
        *[F.sum(c).alias(c) for c in ("packets", "bytes", "dropped_packets", "tcp_packets", "udp_packets")])
    host = (ordered.host_summary(A.host_metrics(spark, sf))
            .select("link_id", F.col("avg_cpu_percent").alias("cpu_percent"),
                    F.col("avg_memory_percent").alias("memory_percent")))
    up = status.uptime(_rates(spark, sf))
    rows = to_metric_rows(totals.join(host, "link_id").join(up, "link_id"))
    return _out(rows, "link_id", "name", "type", "help", "value")


# -- H: features -----------------------------------------------------------------------------------

FEATURE_WINDOW = FeatureConfig(window_samples=40)


def _feature_ticks(spark, sf):
    sources = traffic.source_ticks(_admitted(spark, sf), TICK_SECONDS)
    cols = ["packets", "bytes", "tcp_packets", *FLAG_COUNTERS]
    return (sources.groupBy("link_id", "tick_start").agg(*[F.sum(f"all_{c}").alias(c) for c in cols])
            .withColumn("tick_seconds", F.lit(TICK_SECONDS)))


def b16_split_fwd_bwd(spark, sf):
    frame = features.feature_frame(_feature_ticks(spark, sf), FEATURE_WINDOW)
    return _out(frame, "link_id", "tick_start", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")


def e12_feature_frame(spark, sf):
    frame = features.feature_frame(_feature_ticks(spark, sf), FEATURE_WINDOW, chunk=50)
    return _out(frame, "link_id", "tick_start", "bf_max", "bf_min", "bf_mean", "bf_std", "iat_mean", "window_samples")


def h1_h19_flow_features(spark, sf):
    df = features.flow_features(settle(_feature_ticks(spark, sf)), FEATURE_WINDOW, chunk=50)
    return _out(df, "link_id", "tick_start", *FEATURES)


def h1_h19_flow_features_default(spark, sf):
    df = features.flow_features(settle(_feature_ticks(spark, sf)))
    return _out(df, "link_id", "tick_start", *FEATURES)


def h20_source_windows(spark, sf):
    df = features.source_windows(_sources(spark, sf), 10, chunk=12)
    return _out(df, "link_id", "tick_start", "src_ip", "window_packets", "window_bytes", "window_ticks", "first_seen")


def h20_flow_counts(spark, sf):
    return _out(features.flow_counts(_sources(spark, sf)), "link_id", "tick_start", "flow_count")


def h21_feature_summary(spark, sf):
    frame = features.feature_frame(settle(_feature_ticks(spark, sf)), FEATURE_WINDOW)
    df = features.feature_summary(frame, features.flow_counts(_sources(spark, sf)))
    return _out(df, "link_id", "tick_start", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes",
                "total_bwd_bytes", "window_samples", "unique_flows", "Flow Bytes/s", "Flow Packets/s",
                "SYN Flag Count", "ACK Flag Count")


def h22_feature_epochs(spark, sf):
    resets = (A.read(spark, sf, "events").filter(F.col("user_id") < 2)
              .select(A._link(), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("reset_at")).distinct())
    df = features.mark_epochs(_feature_ticks(spark, sf), resets)
    out = features.flow_features(settle(df), FEATURE_WINDOW, keys=["link_id", "epoch_id"])
    return _out(out, "link_id", "epoch_id", "tick_start", "Flow Duration", "Total Fwd Packets", "SYN Flag Count",
                "Flow IAT Mean")


def h_flow_features_true(spark, sf):
    df = features.flow_features_true(_admitted(spark, sf).withColumn("src_port", F.lit(0)))
    return _out(df, "link_id", "low_ip", "low_port", "high_ip", "high_port", "protocol", "Flow Duration",
                "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Packet Length Mean",
                "Packet Length Std", "SYN Flag Count", "Fwd PSH Flags",
                flow_iat_max=F.round("Flow IAT Max", 3), fwd_iat_total=F.round("Fwd IAT Total", 3))


# -- D12-D19: prediction scores --------------------------------------------------------------------

def d12_label_counts(spark, sf):
    return evaluate.label_counts(A.labelled_flows(spark, sf))


def d13_confusion(spark, sf):
    return evaluate.confusion(A.predictions(spark, sf))


def d13_confusion_matrix(spark, sf):
    return (evaluate.confusion_matrix(A.predictions(spark, sf), [0, 1])
            .withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"}))


def d14_accuracy(spark, sf):
    return _out(evaluate.accuracy(A.predictions(spark, sf)), "accuracy")


def d15_weighted_scores(spark, sf):
    return _out(evaluate.weighted_scores(A.predictions(spark, sf)), "precision", "recall", "f1")


def d16_class_report(spark, sf):
    return _out(evaluate.class_report(A.predictions(spark, sf)), "class", "precision", "recall", "f1", "support")


def d19_binary_rates(spark, sf):
    return _out(evaluate.binary_rates(A.predictions(spark, sf)), "tpr", "tnr", "fpr", "precision", "f1")


# -- J: learning -----------------------------------------------------------------------------------

def _prepared(spark, sf):
    return learn.prepare_flows(A.labelled_flows(spark, sf))


def _flow_columns():
    return ["Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
            "Total Length of Bwd Packets", "Flow Bytes/s", "SYN Flag Count", "ACK Flag Count"]


def _flow_folder(spark, sf):
    """The labelled flows as files: four with all columns, three without one, and three that cannot be used."""
    folder, df = _work(spark), A.labelled_flows(spark, sf)
    padded = df.select(*[F.col(f"`{c}`").alias(f" {c}" if c != "source_file" else c) for c in df.columns])
    some = F.col("source_file") < "file5"
    # A source is one file, so one task writes it, but no two sources need the same one. Files that are open side by side need no sort.
    open_files, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set(open_files, "64")
    try:
        for name, rows in (("a", padded.filter(some)), ("b", padded.filter(~some).drop(" ACK Flag Count"))):
            rows.repartition("source_file").write.option("header", True).partitionBy("source_file").csv(f"{folder}/flows/{name}")
    finally:
        spark.conf.set(open_files, before)
    spark.createDataFrame([], "label string").coalesce(1).write.csv(f"{folder}/flows/empty")
    spark.createDataFrame([("1", "2")], "x string, y string").coalesce(1).write.option("header", True).csv(f"{folder}/flows/unlabelled")
    return f"{folder}/flows"


def a3_labelled_flows(spark, sf):
    """Flow files with different headers read in one scan: rows, and sums of two columns, one of which not all have."""
    df = read_labelled_flows(spark, _flow_folder(spark, sf))
    number = {c: F.col(f"`{c}`").cast("double") for c in ("SYN Flag Count", "ACK Flag Count")}
    return (df.groupBy(F.btrim("label").alias("label"), F.regexp_extract("source_file", "source_file=(\\w+)", 1).alias("file"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(number["SYN Flag Count"]).alias("syns"), F.sum(number["ACK Flag Count"]).alias("acks")))


def a5_capped_files(spark, sf):
    """The first three files in the order of their names, of those that are not empty."""
    df = read_labelled_flows(spark, _flow_folder(spark, sf), max_files=3)
    return df.groupBy(F.regexp_extract("source_file", "source_file=(\\w+)", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def a7_left_out_files(spark, sf):
    """Why files were left out, and how many were read."""
    files = flow_files(spark, _flow_folder(spark, sf))
    return files.groupBy(F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def a1_packets_source(spark, sf):
    """Packets written as a table and read with the source's schema."""
    folder = f"{_work(spark)}/packets"
    A.packets(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in PACKETS]).write.parquet(folder)
    df = read_packets(spark, folder)
    return df.groupBy("link_id", "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"),
                                                 F.count_distinct("src_ip").alias("sources"), F.count_if("l4_ok").alias("complete"))


def a2_counters_source(spark, sf):
    """Counters of which one link's files lack a column; what is missing counts as 0."""
    folder, df = f"{_work(spark)}/counters", A.counters(spark, sf)
    kept = [F.col(f.name).cast(f.dataType) for f in COUNTER_SNAPSHOTS if f.name in df.columns]
    df.select(*kept).filter("link_id = 'link0'").write.parquet(f"{folder}/a")
    df.select(*kept).filter("link_id = 'link1'").drop("icmp_packets").write.parquet(f"{folder}/b")
    out = read_counters(spark, f"{folder}/*")
    return out.groupBy("link_id", "cpu").agg(F.sum("packets").alias("packets"), F.sum("tcp_packets").alias("tcp_packets"),
                                             F.sum("icmp_packets").alias("icmp_packets"), F.sum("dropped_packets").alias("dropped_packets"))


def a12_saved_model(spark, sf):
    """What is known of a model that was saved and loaded, and the rows its root was fitted on."""
    model, path, _, _ = _model(spark, sf, TREE)
    _, meta = load_model(spark, path.rsplit("/", 1)[0])
    nodes, kind = models.tree_nodes(spark, path)
    return nodes.filter("node = 0").select(F.lit(meta["model_type"]).alias("model_type"), F.lit(kind).alias("kind"),
                                           F.lit(len(model.stages)).alias("stages"), "rows")


def a4_trimmed_columns(spark, sf):
    files = flow_files(spark, _flow_folder(spark, sf)).filter("reason is null")
    return files.select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("files"))


def a6_sample_per_group(spark, sf):
    df = sample_per_group(A.labelled_flows(spark, sf), "source_file", 500)
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


def b8_encode_multiclass(spark, sf):
    df, encoder = learn.encode_multiclass(A.labelled_flows(spark, sf))
    named = learn.decode_multiclass(df, encoder)
    return named.groupBy("label", "code", "name").agg(F.count(F.lit(1)).alias("rows"))


def b17_attack_type(spark, sf):
    df = (A.labelled_flows(spark, sf).withColumn("Flow Packets/s", F.col("Total Fwd Packets") * 300)
          .withColumn("Flow Bytes/s", F.col("`Flow Bytes/s`") * 100))
    kind = C.infer_attack_type(is_attack=~C.is_benign("label"))
    return df.groupBy(kind.alias("attack_type")).agg(F.count(F.lit(1)).alias("flows"))


def f6_shuffle(spark, sf):
    """The rows in their shuffled order. Positions are found in buckets of the same hash that the order goes by."""
    key = ["label", "source_file", "syns", "acks"]
    flows = A.labelled_flows(spark, sf).select("label", "source_file", F.col("SYN Flag Count").cast("long").alias("syns"),
                                               F.col("ACK Flag Count").cast("long").alias("acks"))
    df = ranking.shuffle_rows(flows.withColumn("one", F.lit(1)), 42, key).withColumn("h", ranking.shuffle_key(key, 42))
    return numbered(df, ["one"], ["h", *key], F.substring("h", 1, 3), "position").drop("one", "h")


def g1_union_flows(spark, sf):
    flows = A.labelled_flows(spark, sf)
    df = union_flows([flows, flows.drop("ACK Flag Count")])
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count("ACK Flag Count").alias("acks"))


def g6_dedupe_flows(spark, sf):
    return learn.dedupe_flows(A.labelled_flows(spark, sf).select("Flow Duration", "SYN Flag Count", "label"))


def j1_prepare_flows(spark, sf):
    odd = (F.when(F.col("SYN Flag Count") % 7 == 0, float("inf")).when(F.col("SYN Flag Count") % 11 == 0, float("nan"))
           .otherwise(F.col("`Flow Bytes/s`")))
    df = A.labelled_flows(spark, sf).withColumn("Flow Bytes/s", odd)
    df = df.withColumnsRenamed({"label": " Label", "SYN Flag Count": " SYN Flag Count"})
    return _out(learn.prepare_flows(df), *_flow_columns(), "label", "source_file", rounded=False)


def j2_balance(spark, sf):
    return (learn.balance(_prepared(spark, sf), 0.3).groupBy("label").agg(F.count(F.lit(1)).alias("rows")))


def j3_split(spark, sf):
    return (learn.split(_prepared(spark, sf)).groupBy("label", "split").agg(F.count(F.lit(1)).alias("rows")))


def j4_split(spark, sf):
    return (learn.split(_prepared(spark, sf), (0.7, 0.15, 0.15)).groupBy("label", "split")
            .agg(F.count(F.lit(1)).alias("rows")))


def j5_scale_pop(spark, sf):
    return _out(learn.scale_pop(_prepared(spark, sf), _flow_columns()), *_flow_columns(), "label")


def j8_class_weights(spark, sf):
    df = A.labelled_flows(spark, sf).withColumn("code", C.encode_binary())
    return _out(learn.class_weights(df, "code"), "code", "rows", "weight")


#: The timed queries fit a small forest, as in earlier rounds; all others use the forest of the default size (100 trees, depth 15).
SMALL = TrainingConfig(num_trees=10, max_depth=5, samples_per_file=None)
FOREST = TrainingConfig(samples_per_file=None)
BOOSTED = TrainingConfig("gradient_boosting", max_depth=5, samples_per_file=None)
TREE = TrainingConfig("tree", max_depth=10, samples_per_file=None)
_models = {}


def _model(spark, sf, cfg=FOREST):
    """A model that was saved and loaded again, its folder, the metrics of its training, and the split rows.

    It is fitted and loaded once a session: several queries look at the same model.
    """
    key = (spark.sparkContext.applicationId, sf, repr(cfg))
    if key not in _models:
        parts = settle(learn.split(_prepared(spark, sf)))
        rows = {s: parts.filter(F.col("split") == s) for s in learn.SPLITS}
        fitted, metrics = learn.train(rows["train"], cfg, rows["val"])
        folder = _work(spark)
        metrics = settle(metrics)
        save_model(spark, fitted, {"model_type": cfg.model_type}, folder)
        del fitted  # the driver need not hold two of them
        _models[key] = load_model(spark, folder)[0], f"{folder}/model", metrics, parts
    return _models[key]


def j6_random_forest(spark, sf):
    return _model(spark, sf, SMALL)[2]


def j7_gradient_boosting(spark, sf):
    return _model(spark, sf, BOOSTED)[2]


def j17_decision_tree(spark, sf):
    return _model(spark, sf, TREE)[2]


def _walked(spark, sf, cfg):
    """Rows per part and label on which a walk down the node table and the reloaded model say the same."""
    model, path, _, parts = _model(spark, sf, cfg)
    both = model.transform(models.predict_by_nodes(parts, path))
    apart = F.array_max(F.transform(F.arrays_zip(vector_to_array("probability").alias("p"), F.col("node_probability").alias("q")),
                                    lambda z: F.abs(z["p"] - z["q"])))
    return both.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") == F.col("node_prediction")).alias("same_prediction"),
        F.count_if(apart < 1e-9).alias("same_probability"))


def j6_forest_nodes(spark, sf):
    return _walked(spark, sf, FOREST)


def j7_boosting_nodes(spark, sf):
    return _walked(spark, sf, BOOSTED)


def j17_tree_nodes(spark, sf):
    return _walked(spark, sf, TREE)


def j17_tree_leaves(spark, sf):
    """The training rows, sent down the tree by joins, reach every leaf as often as it was fitted on."""
    _, path, _, parts = _model(spark, sf, TREE)
    leaves = models.leaf_counts(parts.filter("split = 'train'"), path)
    return leaves.agg(F.sum("reached").alias("rows"), F.count_if(F.col("reached") != F.col("rows")).alias("leaves_apart"))


def j12_metrics_nodes(spark, sf):
    """Metrics of the forest by its nodes against those of its training, and on the held-out rows against MLlib's."""
    model, path, trained, parts = _model(spark, sf)
    val, test = (learn._binary(parts.filter(F.col("split") == s)) for s in ("val", "test"))
    names = ["accuracy", "precision", "recall", "f1"]

    def long(df, kind):
        return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(kind)) for n in names])).alias("m")).select("m.*")
    pairs = [("val", models.metrics_by_nodes(val, path), trained), ("test", models.metrics_by_nodes(test, path), learn.model_metrics(model, test))]
    out = None
    for part, left, right in pairs:
        one = long(left, "a").join(long(right, "b"), "metric").select(
            F.lit(part).alias("part"), "metric", (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


def j9_predict(spark, sf):
    model, _, _, parts = _model(spark, sf, SMALL)
    df = learn.predict(model, parts.filter("split = 'test'"))
    return df.groupBy("label", "is_attack", "attack_type").agg(F.count(F.lit(1)).alias("rows"))


def j9_predict_nodes(spark, sf):
    """Attack, probability and confidence of the operator against the node table, on the test rows."""
    model, path, _, parts = _model(spark, sf)
    test = models.predict_by_nodes(parts.filter("split = 'test'"), path)
    return _same_verdicts(learn.predict(model, test, keep=["label", "node_probability", "node_prediction"]))


def _same_verdicts(df):
    p = F.col("node_probability")
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("is_attack") == (F.col("node_prediction") == 1)).alias("same_verdict"),
        F.count_if(F.abs(F.col("attack_probability") - F.get(p, F.lit(1))) < 1e-9).alias("same_probability"),
        F.count_if(F.abs(F.col("confidence") - 100 * F.array_max(p)) < 1e-7).alias("same_confidence"),
        F.count_if((F.col("attack_type") == "BENIGN") == ~F.col("is_attack")).alias("typed"))


def j11_predict_untrained(spark, sf):
    df = learn.predict(None, A.labelled_flows(spark, sf))
    return df.groupBy("is_attack", "attack_type", "confidence").agg(F.count(F.lit(1)).alias("rows"))


def j14_train_job(spark, sf):
    _, _, tables = learn.train_job(spark, A.labelled_flows(spark, sf), TREE)
    return tables["test_report"]


def j14_train_job_parts(spark, sf):
    """What a training job reports on: the rows of its test part by true class, and how often their verdicts are counted."""
    _, meta, tables = learn.train_job(spark, A.labelled_flows(spark, sf), TREE)
    seen = tables["test_confusion"].groupBy("label").agg(F.sum("rows").alias("rows"))
    return seen.select(F.col("label").cast("int").alias("code"), "rows", F.lit(len(meta["features"])).alias("features"))


def j15_model_info(spark, sf):
    model, _, _, _ = _model(spark, sf)
    return learn.model_info(spark, model, {"model_type": FOREST.model_type}).select("is_trained", "model_type", "features", "trees")


def hybrid_scores(spark, sf):
    """A forest trained on the labelled flows judges the ticks next to the rules."""
    df = detection.hybrid_scores(A.packets(spark, sf), _model(spark, sf)[0], CFG)
    return _out(df, "link_id", "tick_start", "score", "is_anomaly", "ml_prediction", "ml_confidence", "attack_type",
                "detection_source")


def i12_rules_alone(spark, sf):
    df = detection.hybrid_scores(A.packets(spark, sf), None, CFG)
    return _out(df, "link_id", "tick_start", "score", "is_anomaly", "ml_confidence", "attack_type", "detection_source")


def f5_feature_importance(spark, sf):
    return learn.feature_importance(spark, _model(spark, sf)[0], 10)


def f5_importance_nodes(spark, sf):
    """Importances added up from the node table against those of the model, for every feature, of forest and boosted model."""
    out = None
    for cfg in (FOREST, BOOSTED, TREE):
        model, path, _, _ = _model(spark, sf, cfg)
        known = learn.feature_importance(spark, model, 1000)
        own = models.importance_by_nodes(spark, path).withColumnRenamed("importance", "own")
        one = known.join(own, "feature", "left").select(
            F.lit(cfg.model_type).alias("model"), "feature", (F.abs(F.col("importance") - F.coalesce("own", F.lit(0.0))) < 1e-9).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


def j16_select_by_anova(spark, sf):
    names = learn.select_by_anova(_prepared(spark, sf), 3)
    return spark.createDataFrame([(n,) for n in names], "feature string")


def j16_anova(spark, sf):
    """F values of all 64 features of the ticks, over ticks with a new peak in the last hours or without."""
    df = features.flow_features(_feature_ticks(spark, sf), FEATURE_WINDOW)
    df = df.withColumn("class", (F.unix_micros("tick_start") / (TICK_SECONDS * 1_000_000)).cast("long") % 3)
    return _out(learn.anova(df, FEATURES, "class"), "feature", "f")


def j16_anova_flows(spark, sf):
    return _out(learn.anova(_prepared(spark, sf), _flow_columns()), "feature", "f")


def j18_folds(spark, sf):
    df = learn.with_folds(learn._binary(_prepared(spark, sf)))
    return df.groupBy(F.col("code").cast("int").alias("code"), "fold").agg(F.count(F.lit(1)).alias("rows"))


def j18_cross_validate(spark, sf):
    return learn.cross_validate(_prepared(spark, sf), TrainingConfig("tree", max_depth=5))[1]


def j19_mine_signatures(spark, sf):
    df = A.labelled_flows(spark, sf).withColumn(
        "attack_type", F.when(C.is_benign("label"), "BENIGN").otherwise(C.norm_label("label")))
    df = df.withColumn("confidence", F.col("ACK Flag Count") * 2)
    out = learn.mine_signatures(df, ["Total Fwd Packets", "SYN Flag Count"], extremes=True)
    return _out(out, "attack_type", "matched", "false_rate", "keep", low_0=F.get("low", F.lit(0)),
                high_1=F.get("high", F.lit(1)))


def j19_quantile_signatures(spark, sf):
    """The default bounds: the shares of 5 % and 95 %."""
    df = A.labelled_flows(spark, sf).withColumn(
        "attack_type", F.when(C.is_benign("label"), "BENIGN").otherwise(C.norm_label("label")))
    df = df.withColumn("confidence", F.col("ACK Flag Count") * 2)
    out = learn.mine_signatures(df, ["Total Fwd Packets", "Total Length of Fwd Packets", "SYN Flag Count"], min_match=0.7, max_false=0.9)
    return _out(out, "attack_type", "matched", "false_rate", "keep", low_0=F.get("low", F.lit(0)), high_0=F.get("high", F.lit(0)),
                low_1=F.get("low", F.lit(1)), high_1=F.get("high", F.lit(1)), high_2=F.get("high", F.lit(2)))


def j10_predict_batch(spark, sf):
    model, path, _, parts = _model(spark, sf)
    return _same_verdicts(learn.predict_batch(model, models.predict_by_nodes(parts.filter("split = 'val'"), path)))


def j20_apply_rules(spark, sf):
    df = (A.labelled_flows(spark, sf)
          .withColumn("Total Fwd Packets", F.col("Total Fwd Packets") * 10)
          .withColumn("Down/Up Ratio", F.col("Total Backward Packets") / F.col("Total Fwd Packets") * 5)
          .withColumn("Flow Packets/s", F.col("SYN Flag Count"))
          .withColumn("Packet Length Variance", F.col("ACK Flag Count")))
    return (learn.apply_rules(df).groupBy(F.concat_ws(",", "matched_rules").alias("matched_rules"))
            .agg(F.count(F.lit(1)).alias("flows")))


def j21_token_bucket(spark, sf):
    state = F.when(F.col("src_ip") % 3 == 0, "attack").when(F.col("src_ip") % 3 == 1, "anomaly").otherwise("benign")
    df = _admitted(spark, sf).withColumn("ts", F.date_trunc("day", "ts")).withColumn("state", state)
    return _out(learn.token_bucket(df, rates={"benign": 3, "anomaly": 2, "attack": 1}), "seq", "shaped")


# -- L: status -------------------------------------------------------------------------------------

def _based(spark, sf):
    return ordered.baseline(settle(_ticks(spark, sf)), CFG.baseline_samples)


def l2_baseline_info(spark, sf):
    return _out(status.baseline_info(_based(spark, sf)), "link_id", "mean_pps", "std_pps", "mean_bps", "std_bps",
                "mean_tcp_ratio", "mean_udp_ratio", "mean_icmp_ratio", "samples", "last_updated")


def l4_status_lines(spark, sf):
    return _out(status.status_lines(_based(spark, sf)), "link_id", "tick_start", "line")


def l5_uptime(spark, sf):
    return _out(status.uptime(_ticks(spark, sf)), "link_id", "uptime_seconds")


def k13_attack_episodes(spark, sf):
    df = status.attack_episodes(_scored(spark, sf), 86_400.0)
    return _out(df, "link_id", "episode", "started", "ended", "ticks", "max_score")


def l1_status_snapshot(spark, sf):
    scores = settle(_scored(spark, sf))
    alerts = rules.to_alerts(scores, CFG)
    rates = settle(_rates(spark, sf))
    profile = ordered.learn_profile(rates, CFG.learning_seconds)
    df = status.status_snapshot(scores, traffic.ip_stats(_admitted(spark, sf)), A.blacklist(spark, sf), alerts, profile,
                                "2024-01-25 00:00:00", cfg=CFG)

    def joined(c, field):
        return F.concat_ws(",", F.transform(c, lambda x: x[field].cast("string")))
    return _out(df, "link_id", "as_of", "current_pps", "current_bps", packets=F.col("statistics.packets"),
                mean_pps=F.col("baseline.mean_pps"), avg_pps=F.col("profile.avg_pps"),
                blocked=F.col("blocked"), alerts=F.size("recent_alerts").cast("long"),
                top=joined("top_sources", "src_ip"), severities=joined("recent_alerts", "severity"))


def l3_ml_stats(spark, sf):
    scores = settle(_scored(spark, sf))
    ml = scores.select("link_id", "tick_start", (F.col("n") % 2 == 0).alias("is_attack"), F.lit(80.0).alias("confidence"),
                       F.lit(0.5).alias("attack_probability"), F.lit("SYN_Flood").alias("attack_type"))
    return status.ml_stats(rules.combine_scores(scores, ml, cfg=CFG))


# -- K: streams ------------------------------------------------------------------------------------

def _work(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(spark, df, mode="append"):
    """Run a stream over everything there is and read its result."""
    folder = _work(spark)
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _streamed_packets(spark, sf):
    processors.use_rocksdb(spark)
    return traffic.admit(A.packets_of(A.stream_events(spark, sf)))


def k1_stream_ticks(spark, sf):
    df = _run(spark, jobs.stream_ticks(_streamed_packets(spark, sf), TICK_SECONDS))
    return _out(df, "link_id", "tick_start", *COUNTERS)


def k2_stream_ip_stats(spark, sf):
    df = _run(spark, jobs.stream_ip_stats(_streamed_packets(spark, sf), TICK_SECONDS))
    return _out(df, "link_id", "tick_start", "src_ip", "packets", "bytes", "syn_count", "udp_count")


def k3_stream_baseline(spark, sf):
    rates = jobs.stream_rates(_streamed_packets(spark, sf), TICK_SECONDS)
    df = _run(spark, processors.stream_baseline(rates, 40))
    return _out(df, "link_id", "tick_start", "samples", "mean_pps", "std_pps", "pps_sigma", "change_rate")


def k4_stream_scores(spark, sf):
    folder = _work(spark)
    jobs.stream_scores(_replayed_packets(spark, sf, folder), f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint",
                       CFG).awaitTermination()
    return _score_out(spark.read.parquet(f"{folder}/out"))


def k5_stream_cooldown(spark, sf):
    processors.use_rocksdb(spark)
    df = processors.stream_cooldown(A.alert_candidates_of(A.stream_events(spark, sf)), 3600.0, "ts")
    return _out(_run(spark, df), "link_id", "type", "seq", "timestamp")


#: Replayed streams take the month in five batches of six days.
SLICES = ("2024-01-01 00:00:00", 6 * 86_400, 5)


def _replayed_packets(spark, sf, folder):
    """The packets in several micro-batches, in time order."""
    processors.use_rocksdb(spark)
    events = A.read(spark, sf, "events")
    return traffic.admit(A.packets_of(jobs.replay(events, f"{folder}/in", jobs.time_slices("ts", *SLICES))))


def k3_baseline_batches(spark, sf):
    rates = jobs.stream_rates(_replayed_packets(spark, sf, _work(spark)), TICK_SECONDS)
    df = _run(spark, processors.stream_baseline(rates, 40))
    return _out(df, "link_id", "tick_start", "samples", "mean_pps", "std_pps", "pps_sigma", "change_rate")


def _replayed_alerts(spark, sf, folder):
    processors.use_rocksdb(spark)
    return A.alert_candidates_of(jobs.replay(A.read(spark, sf, "events"), f"{folder}/in", jobs.time_slices("ts", *SLICES)))


def k5_cooldown_batches(spark, sf):
    df = processors.stream_cooldown(_replayed_alerts(spark, sf, _work(spark)), 3600.0, "ts")
    return _out(_run(spark, df), "link_id", "type", "seq", "timestamp")


def k11_alert_sink(spark, sf):
    """Alerts appended batch by batch and read again."""
    folder = _work(spark)
    df = _replayed_alerts(spark, sf, folder).select(
        F.col("ts").alias("timestamp"), "type", F.lit("medium").alias("severity"), F.concat("link_id", F.lit(" "), "seq").alias("message"))
    jobs.alert_sink(df, f"{folder}/alerts", f"{folder}/checkpoint").awaitTermination()
    return _out(read_alerts(spark, f"{folder}/alerts"), "timestamp", "type", "severity", "message")


def _closed_loop(spark, sf):
    folder = _work(spark)
    q = jobs.run_closed_loop(_replayed_packets(spark, sf, folder), f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint", CFG)
    q.awaitTermination()
    return folder


def k6_closed_loop(spark, sf):
    """The alerts of a loop over five batches: what one batch's alerts block is dropped from the next batch on."""
    folder = _closed_loop(spark, sf)
    return _out(read_alerts(spark, f"{folder}/out/alerts"), "timestamp", "type", "severity", "message")


def k6_loop_ticks(spark, sf):
    """The ticks of the loop as it saw them: what was dropped, and the score of what was left."""
    folder = _closed_loop(spark, sf)
    df = spark.read.option("mergeSchema", False).parquet(f"{folder}/out/scores")
    return _out(df, "link_id", "tick_start", "packets", "dropped_packets", "dropped_bytes", "passed_packets", "sources",
                "ip_entropy", "top_ratio", "syn_heavy", "score", "is_anomaly", reasons=F.array_join("reasons", "|"))


def k7_stream_profile(spark, sf):
    rates = jobs.stream_rates(_replayed_packets(spark, sf, _work(spark)), TICK_SECONDS)
    df = _run(spark, processors.stream_profile(rates, CFG.learning_seconds))
    return _out(df, "link_id", "tick_start", "avg_pps", "peak_pps", "avg_bps", "peak_bps", "learning_samples")


def k8_stream_features(spark, sf):
    folder = _work(spark)
    jobs.stream_features(_replayed_packets(spark, sf, folder), f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint",
                         TICK_SECONDS, cfg=FEATURE_WINDOW).awaitTermination()
    return _out(spark.read.parquet(f"{folder}/out"), "link_id", "tick_start", *FEATURES)


def k2_running_totals(spark, sf):
    """The last totals of every source over five batches; a silence of a day begins them anew."""
    folder = _work(spark)
    df = bounded.stream_totals(_replayed_packets(spark, sf, folder), "0 seconds", 86_400.0)
    jobs.totals_sink(df, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return jobs.read_totals(spark, f"{folder}/out").select(*bounded.TOTALS.names)


#: Small tables, so that entries are evicted: ten entries in each of four shards, a day of silence.
TABLE = {"capacity": 40, "idle_seconds": 86_400.0, "shards": 4}


def k9_bounded_table(spark, sf):
    return bounded.bounded_table(_admitted(spark, sf), ["src_ip"], **TABLE)


def k9_stream_bounded_table(spark, sf):
    """Entries as they end, over five batches."""
    folder = _work(spark)
    df = bounded.stream_bounded_table(_replayed_packets(spark, sf, folder), ["src_ip"], "0 seconds", **TABLE)
    return _run(spark, df)


def _delayed_packets(spark, sf, folder):
    """Twelve slices of two and a half days, in which every fiftieth packet comes two slices late."""
    events = A.read(spark, sf, "events")
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(SLICES[0])))) / (216_000 * 1_000_000))
    at = F.least(F.greatest(at, F.lit(0)) + F.when(F.col("event_id") % 50 == 7, 2).otherwise(0), F.lit(11))
    return A.packets_of(jobs.replay(events, f"{folder}/in", [at == k for k in range(12)]))


def k14_late_packets(spark, sf):
    """What a delay of six hours leaves out, per batch of arrival."""
    folder = _work(spark)
    jobs.late_packets(_delayed_packets(spark, sf, folder), f"{folder}/late", f"{folder}/state", f"{folder}/checkpoint",
                      TICK_SECONDS, 21_600.0).awaitTermination()
    return spark.read.parquet(f"{folder}/late").select(F.col("batch").cast("long").alias("batch"), "link_id", "seq", "bytes")


def k10_profile_restart(spark, sf):
    """The profile after a run of one slice, one of two and one of the rest, each going on from what the last one wrote."""
    processors.use_rocksdb(spark)
    folder, last = _work(spark), None
    events, slices = A.read(spark, sf, "events"), jobs.time_slices("ts", *SLICES)
    for run, part in enumerate((slices[:1], slices[:3], slices)):
        done = None if last is None else last.agg(F.max("tick_start")).first()[0]
        # What had not closed when the run stopped comes again.
        rest = events if done is None else events.filter(
            F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(F.lit(done)) + int(TICK_SECONDS * 1_000_000))
        packets = traffic.admit(A.packets_of(jobs.replay(rest, f"{folder}/in{run}", part)))
        profiles = processors.stream_profile(jobs.stream_rates(packets, TICK_SECONDS), CFG.learning_seconds, initial=last, every_tick=True)
        jobs.profile_sink(profiles, f"{folder}/profiles/run={run}", f"{folder}/checkpoint{run}").awaitTermination()
        last = settle(jobs.read_profiles(spark, f"{folder}/profiles"))
    return _out(last, "link_id", "tick_start", "avg_pps", "peak_pps", "avg_bps", "peak_bps", "learning_samples", "is_learned")


def k12_sliding_counters(spark, sf):
    df = _run(spark, jobs.sliding_counters(_streamed_packets(spark, sf), 86_400.0, TICK_SECONDS))
    return _out(df, "link_id", "window_start", "packets", "bytes")


def k13_stream_episodes(spark, sf):
    """Sessions of error events per link."""
    processors.use_rocksdb(spark)
    df = (A.alert_candidates_of(A.stream_events(spark, sf))
          .select("link_id", F.col("ts").alias("tick_start"), (F.col("type") == "error").alias("is_anomaly"),
                  F.lit(50.0).alias("score")))
    out = _run(spark, jobs.stream_episodes(df, "1 hour"))
    return _out(out, "link_id", "started", "closed", "ticks")


def all_queries():
    own = {n: f for n, f in globals().items() if not n.startswith("_") and n != "all_queries"}
    return {n: f for n, f in own.items() if callable(f) and getattr(f, "__module__", "") == __name__}
