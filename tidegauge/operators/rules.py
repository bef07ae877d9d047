"""The additive rule score, its merge with a classifier's verdict, and alert rows."""

from pyspark.sql import DataFrame, functions as F

from tidegauge.config import DetectionConfig, RulePoints
from tidegauge.functions import columns as C
from tidegauge.plans.spread import key_join

POINTS = RulePoints()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _when(cond, points, text):
    hit = F.coalesce(cond, F.lit(False))
    return F.when(hit, points).otherwise(0), F.when(hit, text)


# Each rule gives (points, reason); reason is null when the rule is silent. The wordings are fixed values.

def rule_rate(cfg: DetectionConfig, p: RulePoints = POINTS):
    """I1"""
    pps = F.col("pps")
    attack, alert = pps > cfg.attack_pps, pps > cfg.alert_pps
    shown = C.fixed(pps, 0)
    points = F.when(attack, p.attack_rate).when(alert, p.alert_rate).otherwise(0)
    reason = (F.when(attack, _text("Very high packet rate: ", shown, f" pps (threshold: {cfg.attack_pps:g})"))
              .when(alert, _text("High packet rate: ", shown, f" pps (threshold: {cfg.alert_pps:g})")))
    return points, reason


def rule_deviation(cfg, p=POINTS):
    """Also fires on drops."""
    return _when(F.abs("pps_sigma") > cfg.sigma, p.deviation,
                 _text("Packet rate deviation: ", C.fixed("pps_sigma", 1), " sigma from baseline"))


def rule_change(cfg, p=POINTS):
    """I3"""
    return _when(F.col("change_rate") > cfg.change_rate, p.change,
                 _text("Rapid traffic increase: ", C.fixed("change_rate", 1), "x"))


def rule_tcp(cfg, p=POINTS):
    """I4"""
    far = F.abs(F.col("tcp_ratio") - cfg.normal_tcp) > cfg.protocol_deviation
    return _when((F.col("proto_packets") > 0) & far, p.tcp_mix,
                 _text("Abnormal TCP ratio: ", C.fixed("tcp_ratio", 2), f" (expected: {cfg.normal_tcp:.2f})"))


def rule_udp(cfg, p=POINTS):
    """I5"""
    high = F.col("udp_ratio") > cfg.normal_udp + cfg.protocol_deviation
    return _when((F.col("proto_packets") > 0) & high, p.udp_mix,
                 _text("High UDP ratio: ", C.fixed("udp_ratio", 2),
                       f" (normal: {cfg.normal_udp:.2f}) - possible UDP flood"))


def rule_icmp(cfg, p=POINTS):
    """I6"""
    high = F.col("icmp_ratio") > cfg.normal_icmp + cfg.protocol_deviation
    return _when((F.col("proto_packets") > 0) & high, p.icmp_mix,
                 _text("High ICMP ratio: ", C.fixed("icmp_ratio", 2),
                       f" (normal: {cfg.normal_icmp:.2f}) - possible ICMP flood"))


def rule_entropy(cfg, p=POINTS):
    """Only where sources are known."""
    low = (F.col("sources") > 0) & (F.col("ip_entropy") < cfg.min_entropy)
    return _when(low, p.entropy, _text("Low source IP entropy: ", C.fixed("ip_entropy", 2),
                                       f" (threshold: {float(cfg.min_entropy)}) - concentrated sources"))


def rule_top_share(cfg, p=POINTS):
    """I8"""
    high = (F.col("sources") > 0) & (F.col("top_ratio") > cfg.top_share)
    return _when(high, p.top_share, _text(f"Traffic concentrated in few IPs: top {cfg.top_k} = ",
                                          C.fixed(F.col("top_ratio") * 100, 1), "%"))


def rule_syn(cfg, p=POINTS):
    """I9"""
    return _when(F.col("syn_heavy") > 0, p.syn,
                 _text("Detected ", F.col("syn_heavy").cast("string"),
                       " IPs with excessive SYN packets - possible SYN flood"))


RULES = (rule_rate, rule_deviation, rule_change, rule_tcp, rule_udp, rule_icmp, rule_entropy, rule_top_share,
         rule_syn)

_METRICS = (("pps", "pps", None), ("bps", "bps", None), ("pps_sigma", "pps_sigma", None),
            ("change_rate", "change_rate", None), ("tcp_ratio", "tcp_ratio", "proto_packets"),
            ("udp_ratio", "udp_ratio", "proto_packets"), ("icmp_ratio", "icmp_ratio", "proto_packets"),
            ("ip_entropy", "ip_entropy", "sources"), ("top10_ratio", "top_ratio", "sources"))


def score_ticks(ticks: DataFrame, cfg: DetectionConfig = DetectionConfig(), points: RulePoints = POINTS,
                rules=RULES) -> DataFrame:
    """Adds ``score``, ``is_anomaly``, ``reasons`` and ``metrics`` to ticks with rates, baseline and shares.

    A link's first tick (``n`` = 1) has nothing to compare with: score 0 and no reasons. One projection, no shuffle.
    """
    parts = [rule(cfg, points) for rule in rules]
    started = F.col("n") > 1
    score = F.lit(0)
    for pts, _ in parts:
        score = score + pts
    metrics = F.create_map(*[x for name, c, known in _METRICS for x in (
        F.lit(name), (F.col(c) if known is None else F.when(F.col(known) > 0, F.col(c))).cast("double"))])
    no_text = F.array().cast("array<string>")
    none = F.create_map().cast("map<string,double>")
    return (ticks
            .withColumn("score", F.when(started, score.cast("double")).otherwise(0.0))
            .withColumn("is_anomaly", F.col("score") >= cfg.anomaly_score)
            .withColumn("reasons", F.when(started, F.array_compact(F.array(*[r for _, r in parts])))
                        .otherwise(no_text))
            .withColumn("metrics", F.when(started, F.map_filter(metrics, lambda k, v: v.isNotNull()))
                        .otherwise(none)))


def combine_scores(scores: DataFrame, predictions: DataFrame | None, keys=("link_id", "tick_start"),
                   cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Merge with predictions (``is_attack``, ``confidence`` 0-100, ``attack_probability``, ``attack_type``).

    Ticks without a prediction keep the rule verdict. The first matching case decides.
    """
    if predictions is None:
        return (scores.withColumn("ml_prediction", F.lit(None).cast("boolean")).withColumn("ml_confidence", F.lit(0.0))
                .withColumn("attack_type", F.lit("UNKNOWN")).withColumn("detection_source", F.lit("statistical")))
    ml = predictions.select(*keys, F.col("is_attack").alias("__ml"), F.col("confidence").alias("__conf"),
                            F.col("attack_probability").alias("__prob"), F.col("attack_type").alias("__type"))
    df = key_join(scores, ml, list(keys), "left")
    attack, conf = F.col("__ml"), F.col("__conf")
    stat, combined = F.col("is_anomaly"), F.col("__combined")
    df = df.withColumn("__combined", F.col("score") + F.when(attack, conf * (cfg.ml_weight / 100)).otherwise(0.0))
    known = F.col("__ml").isNotNull()
    cases = [(attack & (conf >= cfg.ml_sure), True, "ml"),
             (stat & attack, True, "hybrid"),
             (stat & (F.col("score") >= cfg.stat_sure), True, "statistical"),
             (attack & (conf >= cfg.ml_likely), True, "ml"),
             (combined >= cfg.hybrid_score, True, "hybrid")]
    verdict, source = F.when(~known, stat), F.when(~known, "statistical")
    for cond, v, s in cases:
        verdict, source = verdict.when(cond, v), source.when(cond, s)
    said = _text("ML detected ", F.col("__type"), " (confidence: ", C.fixed(conf, 1), "%)")
    extra = F.map_from_arrays(F.array(F.lit("ml_confidence"), F.lit("ml_attack_prob")),
                              F.array(conf.cast("double"), F.col("__prob").cast("double")))
    df = df.withColumns({
        "detection_source": source.otherwise("statistical"),
        "__verdict": verdict.otherwise(stat),
        "reasons": F.when(attack, F.concat("reasons", F.array(said))).otherwise(F.col("reasons")),
        "metrics": F.when(known, F.map_concat("metrics", extra)).otherwise(F.col("metrics")),
        "attack_type": F.when(~known, "UNKNOWN").when(attack, F.col("__type")).otherwise("BENIGN"),
        "ml_prediction": attack,
        "ml_confidence": F.coalesce(conf, F.lit(0.0)),
    })
    return (df.withColumn("score", F.when(known, F.least(combined, F.lit(100.0))).otherwise(F.col("score")))
            .withColumn("is_anomaly", F.col("__verdict"))
            .drop("__ml", "__conf", "__prob", "__type", "__combined", "__verdict"))


def decision_matrix(stat_score="score", ml_confidence="ml_confidence", combined="combined"):
    """The documented four-way decision; differs from the merge above and is kept for comparison."""
    stat, ml = C._c(stat_score) >= 70, C._c(ml_confidence) >= 85
    return (F.when(stat & ml, "HIGH CONFIDENCE ATTACK").when(stat | ml, "MEDIUM CONFIDENCE")
            .when(C._c(combined) >= 60, "PROBABLE ATTACK").otherwise("BENIGN"))


def to_alerts(scores: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """One alert candidate per anomalous tick; ``cooldown`` thins them out."""
    return scores.filter("is_anomaly").select(
        "link_id", F.col("tick_start").alias("timestamp"), F.lit("ddos_attack").alias("type"),
        C.severity("score", cfg.high_severity).alias("severity"), C.alert_message("score").alias("message"),
        F.struct("reasons", "metrics", F.col("pps").cast("double").alias("current_pps"),
                 F.coalesce("mean_pps", F.lit(0.0)).alias("baseline_pps")).alias("details"))


def scoring_tally(scores: DataFrame) -> DataFrame:
    """Predictions made and attacks found per link."""
    return scores.groupBy("link_id").agg(
        F.count("ml_prediction").alias("ml_predictions"),
        F.count_if(F.col("ml_prediction")).alias("ml_attacks"), F.count_if(F.col("is_anomaly")).alias("anomalies"))
