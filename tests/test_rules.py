import pytest
from pyspark.sql import functions as F

from helpers import at, ticks
from tidegauge.config import CUMULATIVE, TICK, DetectionConfig
from tidegauge.operators import ordered, rules, traffic
from tidegauge.plans import detection
from tidegauge.plans.spread import day_bucket, running


def scored(spark, counts, scope):
    df = ticks(spark, counts)
    if scope == CUMULATIVE:
        df = running(df, ["link_id"], ["tick_start"], day_bucket("tick_start"),
                     sums={f"cum_{c}": c for c in detection.MIX})
        df = traffic.protocol_ratios(df, "cum_")
    else:
        df = traffic.protocol_ratios(df)
    out = detection.score_table(ordered.tick_rates(df), DetectionConfig(scope=scope))
    return out.orderBy("tick_start").collect()


CALM = [(1000, 850, 100, 50)] * 15


def test_flood_of_a_million(spark):
    got = scored(spark, CALM + [(1_000_000, 850_000, 100_000, 50_000)], CUMULATIVE)
    assert got[0].score == 0 and not got[0].is_anomaly and got[0].reasons == [] and got[0].metrics == {}
    assert got[-1].score == 70 and got[-1].is_anomaly and len(got[-1].reasons) == 2
    assert "pps_sigma" not in got[-1].metrics and "ip_entropy" not in got[-1].metrics
    assert got[-1].reasons[0] == "Very high packet rate: 1000000 pps (threshold: 2000)"


def test_udp_flood_by_scope(spark):
    flood = CALM + [(10_000, 1000, 9000, 0)]
    assert scored(spark, flood, CUMULATIVE)[-1].score == 85
    assert scored(spark, flood, TICK)[-1].score == 100


def test_score_from_logged_metrics(spark):
    row = [("a", at(0), 5, 0.0, 0.0, -0.5066, None, 22, 0.5455, 0.4545, 0.0, 5, 1.9966, 1.0, 0)]
    df = spark.createDataFrame(row, "link_id string, tick_start timestamp, n int, pps double, bps double, pps_sigma double, "
                                    "change_rate double, proto_packets long, tcp_ratio double, udp_ratio double, "
                                    "icmp_ratio double, sources long, ip_entropy double, top_ratio double, syn_heavy long")
    got = rules.score_ticks(df).first()
    assert got.score == 60 and got.reasons == [
        "Abnormal TCP ratio: 0.55 (expected: 0.85)", "High UDP ratio: 0.45 (normal: 0.10) - possible UDP flood",
        "Low source IP entropy: 2.00 (threshold: 3.0) - concentrated sources",
        "Traffic concentrated in few IPs: top 10 = 100.0%"]
    alert = rules.to_alerts(rules.score_ticks(df).withColumn("mean_pps", F.lit(None).cast("double"))).first()
    assert alert.severity == "medium" and alert.message == "DDoS attack detected (score: 60.0)"
    assert alert.details.baseline_pps == 0


def test_more_rules_never_lower_the_score(spark):
    counts = [(n * 300 % 4000, n * 7 % 50, n * 11 % 90, n % 5) for n in range(1, 40)]
    df = ordered.baseline(ordered.tick_rates(traffic.protocol_ratios(ticks(spark, counts))))
    last = None
    for k in range(1, len(rules.RULES) + 1):
        got = [r.score for r in rules.score_ticks(df, rules=rules.RULES[:k]).orderBy("tick_start").collect()]
        assert last is None or all(a <= b for a, b in zip(last, got))
        last = got


MERGES = [
    (0, True, 85, True, "ml", 25.5), (50, True, 70, True, "hybrid", 71), (70, False, 99, True, "statistical", 70),
    (0, True, 70, True, "ml", 21), (45, True, 60, True, "hybrid", 63), (50, False, 90, True, "statistical", 50),
    (60, False, 50, True, "hybrid", 60), (30, True, 60, False, "statistical", 48), (90, True, 90, True, "ml", 100),
    (49, False, 99, False, "statistical", 49),
]


def test_merge_table(spark):
    stat = spark.createDataFrame([("a", at(i), float(s), s >= 50, ["r"], {"pps": 1.0}) for i, (s, *_) in enumerate(MERGES)],
                                 "link_id string, tick_start timestamp, score double, is_anomaly boolean, reasons array<string>, "
                                 "metrics map<string,double>")
    # 60 with a benign prediction is 'hybrid' only if it is not already a rule verdict of 70 or more.
    ml = spark.createDataFrame([("a", at(i), m, float(c), 0.5, "SYN_Flood") for i, (_, m, c, *_) in enumerate(MERGES)],
                               "link_id string, tick_start timestamp, is_attack boolean, confidence double, "
                               "attack_probability double, attack_type string")
    got = rules.combine_scores(stat, ml).orderBy("tick_start").collect()
    for r, (s, m, c, verdict, source, score) in zip(got, MERGES):
        assert (r.is_anomaly, r.detection_source) == (verdict, source), (s, m, c)
        assert r.score == pytest.approx(score)
        assert r.attack_type == ("SYN_Flood" if m else "BENIGN") and len(r.reasons) == 1 + m
    alone = rules.combine_scores(stat, ml.limit(0)).orderBy("tick_start").collect()
    assert [(r.score, r.is_anomaly, r.detection_source) for r in alone] == [(s, s >= 50, "statistical") for s, *_ in MERGES]
    assert rules.combine_scores(stat, None).first().attack_type == "UNKNOWN"


def test_config_is_checked():
    with pytest.raises(ValueError):
        DetectionConfig(scope="ever")
    with pytest.raises(ValueError):
        DetectionConfig(frame="next")
