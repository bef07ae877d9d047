"""The detection plan: packets to scored ticks, kept alerts and block candidates."""

from pyspark.sql import DataFrame, functions as F

from tidegauge.config import TICK, DetectionConfig, FeatureConfig
from tidegauge.operators import features, learn, lists, ordered, ranking, rules, traffic
from tidegauge.plans.spread import day_bucket, key_join, running, settle
from tidegauge.schemas import COUNTERS, FLAG_COUNTERS

KEYS = ["link_id", "tick_start"]
MIX = ["tcp_packets", "udp_packets", "icmp_packets"]


def tick_table(sources: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Per tick, from per-tick source rows: counters, flag counts, rates, protocol shares and source concentration.

    Shares and concentration follow ``cfg.scope``; counters and rates are always those of the tick.
    """
    carry = [f"all_{c}" for c in COUNTERS + FLAG_COUNTERS]
    if cfg.scope == TICK:
        ticks = traffic.concentration(sources, KEYS, cfg.top_k, cfg.syn_heavy, carry)
        ticks = ticks.withColumnsRenamed({c: c[4:] for c in carry})
        ticks = traffic.protocol_ratios(ticks)
    else:
        ticks = (sources.groupBy(*KEYS).agg(*[F.sum(c).alias(c[4:]) for c in carry]))
        known = traffic.cumulative_concentration(
            sources.select(*KEYS, "src_ip", "packets", "syn_count").filter(F.col("packets") > 0),
            cfg.top_k, cfg.syn_heavy)
        ticks = key_join(ticks, known, KEYS, "left")
        # A tick that adds no tracked source keeps the shares of the tick before it.
        ticks = carry_forward(ticks, ["sources", "source_packets", "top_packets", "syn_heavy", "ip_entropy",
                                      "top_ratio"])
        ticks = running(ticks, ["link_id"], ["tick_start"], day_bucket("tick_start"),
                        sums={f"cum_{c}": c for c in MIX})
        ticks = traffic.protocol_ratios(ticks, "cum_").drop(*[f"cum_{c}" for c in MIX])
    return ordered.tick_rates(ticks.withColumn("tick_seconds", F.lit(float(cfg.tick_seconds))))


def carry_forward(ticks: DataFrame, columns) -> DataFrame:
    """Fill missing values from the last tick of the link that has them, days in parallel; 0 before the first."""
    filled = F.when(F.col(columns[0]).isNotNull(), F.struct("tick_start", *columns))
    # The struct starts with the time, so its running maximum is the latest one.
    out = running(ticks.withColumn("__v", filled), ["link_id"], ["tick_start"], day_bucket("tick_start"),
                  maxs={"__last": "__v"})
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"__last.{c}", F.lit(0).cast(ticks.schema[c].dataType)))
    return out.drop("__v", "__last")


def score_table(ticks: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Ticks with baseline, score, reasons and metrics."""
    numbered = ordered.number_ticks(ticks)
    based = ordered.baseline(numbered, cfg.baseline_samples, cfg.frame, cfg.min_samples)
    return rules.score_ticks(based, cfg)


def score_packets(packets: DataFrame, cfg: DetectionConfig = DetectionConfig(),
                  blacklist: DataFrame | None = None) -> DataFrame:
    """Which ticks on which link look like an attack, and why.

    Packets are read once and reduced to source rows per tick; the ticks made from them are written once, because
    numbering, baseline and scoring pass over them several times.
    """
    seen = traffic.packet_verdict(traffic.admit(packets), blacklist, cfg.syn_limit)
    sources = traffic.source_ticks(seen, cfg.tick_seconds)
    if cfg.scope != TICK:
        sources = settle(sources)
    return score_table(settle(tick_table(sources, cfg)), cfg)


def hybrid_scores(packets: DataFrame, model, cfg: DetectionConfig = DetectionConfig(), blacklist: DataFrame | None = None,
                  feature_cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Rule scores merged with a classifier's verdict on the features of the same ticks; rules alone without a model."""
    seen = traffic.packet_verdict(traffic.admit(packets), blacklist, cfg.syn_limit)
    sources = traffic.source_ticks(seen, cfg.tick_seconds)
    if cfg.scope != TICK:
        sources = settle(sources)
    ticks = settle(tick_table(sources, cfg))
    scores = score_table(ticks, cfg)
    if model is None:
        return rules.combine_scores(scores, None, cfg=cfg)
    predictions = learn.predict(model, features.flow_features(ticks, feature_cfg), keep=KEYS)
    return rules.combine_scores(scores, predictions, cfg=cfg)


def respond(scores: DataFrame, sources: DataFrame, cfg: DetectionConfig = DetectionConfig()):
    """Kept alerts, and the sources (per-tick rows) to block because of them."""
    kept = settle(ordered.cooldown(rules.to_alerts(scores, cfg), cfg.cooldown_seconds))
    return kept, ranking.block_candidates(sources, kept, cfg.block_top, cfg.block_packets)


def new_entries(candidates: DataFrame, tick_seconds: float) -> DataFrame:
    """Block-list entries for candidates, in force from the end of the tick they were found in."""
    end = F.col("tick_start") + F.make_dt_interval(secs=F.lit(float(tick_seconds)).cast("decimal(18,6)"))
    return candidates.select("link_id", "src_ip", end.alias("added_at"))


def extend_blacklist(blacklist: DataFrame, candidates: DataFrame, tick_seconds: float) -> DataFrame:
    return lists.blacklist_add(blacklist, new_entries(candidates, tick_seconds))
