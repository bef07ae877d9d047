"""Status views per link."""

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.config import DetectionConfig
from tidegauge.functions import columns as C
from tidegauge.operators import lists
from tidegauge.plans.spread import day_bucket, key_join, previous, running

LINK = ["link_id"]
BASELINE = ["mean_pps", "std_pps", "mean_bps", "std_bps", "mean_tcp_ratio", "mean_udp_ratio", "mean_icmp_ratio"]


def _latest(df, columns, name, time="tick_start"):
    return df.groupBy(*LINK).agg(F.max_by(F.struct(*columns), time).alias(name))


def _bounded_list(df, columns, order, n, name):
    """The first n rows of each link as an array; rows beyond n are cut off before the shuffle."""
    w = Window.partitionBy(*LINK).orderBy(*order)
    top = df.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n)
    return top.groupBy(*LINK).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("__i", F.struct(*columns).alias("row")))), lambda x: x["row"]).alias(name))


def baseline_info(based: DataFrame) -> DataFrame:
    """L2: the baseline as of each link's last tick; zeros before there are enough samples."""
    fields = [F.coalesce(c, F.lit(0.0)).alias(c) for c in BASELINE if c in based.columns]
    fields += [F.coalesce("samples", F.lit(0)).alias("samples"), F.col("tick_start").alias("last_updated")]
    return _latest(based, fields, "baseline").select(*LINK, "baseline.*")


def uptime(ticks: DataFrame) -> DataFrame:
    """Seconds from a link's first to its last tick."""
    return ticks.groupBy(*LINK).agg(
        C.seconds_between(F.min("tick_start"), F.max("tick_start")).alias("uptime_seconds"))


def status_lines(based: DataFrame, every: int = 10) -> DataFrame:
    """L4: a line for every n-th tick: rate, baseline, sources and packets dropped so far."""
    df = running(based, LINK, ["tick_start"], day_bucket("tick_start"), sums={"dropped": "dropped_packets"})
    line = F.concat(F.lit("Status: "), C.fixed("pps", 0), F.lit(" pps | Baseline: "),
                    C.fixed(F.coalesce("mean_pps", F.lit(0.0)), 0), F.lit(" pps | IPs: "),
                    F.col("sources").cast("string"), F.lit(" | Drop rate: "), F.col("dropped").cast("string"))
    return df.filter(F.col("n") % every == 0).select(*LINK, "tick_start", "n", line.alias("line"))


def ml_stats(scores: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Predictions and attacks found per link, next to the model's description."""
    tally = scores.groupBy(*LINK).agg(
        F.count("ml_prediction").alias("total_ml_predictions"),
        F.count_if(F.col("ml_prediction")).alias("ml_attacks_detected"))
    if info is None:
        return tally.withColumn("ml_enabled", F.lit(False))
    row = info.first()  # one row about one model
    return tally.select("*", F.lit(True).alias("ml_enabled"), F.lit(row.model_type).alias("model_type"),
                        F.lit(row.training_date).alias("training_date"), F.lit(row.accuracy).alias("model_accuracy"))


def attack_episodes(scores: DataFrame, gap_seconds: float) -> DataFrame:
    """K13 for tables: runs of anomalous ticks less than ``gap_seconds`` apart. Days are worked on in parallel."""
    hot = scores.filter("is_anomaly").select(*LINK, "tick_start", "score")
    df = previous(hot, LINK, ["tick_start"], day_bucket("tick_start"), ["tick_start"])
    gap = C.seconds_between("prev_tick_start", "tick_start")
    new = F.when(gap.isNull() | (gap >= gap_seconds), 1).otherwise(0)
    df = running(df.withColumn("__new", new), LINK, ["tick_start"], day_bucket("tick_start"),
                 sums={"episode": "__new"})
    return df.groupBy(*LINK, "episode").agg(
        F.min("tick_start").alias("started"), F.max("tick_start").alias("ended"),
        F.count(F.lit(1)).alias("ticks"), F.max("score").alias("max_score"))


def active_blocks(blacklist: DataFrame, at=None) -> DataFrame:
    """The block list as it stands at a time, or now: every entry, newest first per link."""
    active = blacklist.filter(F.col("removed_at").isNull()) if at is None else lists.blacklist_active(blacklist, at)
    return active.select(*LINK, "src_ip", "added_at").orderBy(*LINK, F.desc("added_at"), "src_ip")


def status_snapshot(scores: DataFrame, sources: DataFrame, blacklist: DataFrame, alerts: DataFrame,
                    profile: DataFrame, at=None, importance: DataFrame | None = None,
                    cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """L1: one row per link: totals, rates, baseline, profile, active block list, recent alerts, top sources, ML tally.

    ``blocked`` counts the active block list, which has no bound; ``active_blocks`` gives it as a table. The other lists
    are top lists: ten alerts, ten sources, ten importances.
    """
    from tidegauge.schemas import COUNTERS
    totals = scores.groupBy(*LINK).agg(
        F.struct(*[F.sum(c).alias(c) for c in COUNTERS]).alias("statistics"), F.max("tick_start").alias("as_of"),
        F.count("ml_prediction").alias("ml_predictions") if "ml_prediction" in scores.columns
        else F.lit(0).cast("long").alias("ml_predictions"),
        F.count_if(F.col("ml_prediction")).alias("ml_attacks") if "ml_prediction" in scores.columns
        else F.lit(0).cast("long").alias("ml_attacks"))
    now = _latest(scores, [F.col("pps").alias("current_pps"), F.col("bps").alias("current_bps")], "__now")
    base = _latest(scores, [*[c for c in BASELINE if c in scores.columns], "samples"], "baseline")
    prof = profile.select(*LINK, F.struct(*[c for c in profile.columns if c not in LINK]).alias("profile"))
    blocked = active_blocks(blacklist, at).groupBy(*LINK).agg(F.count(F.lit(1)).alias("blocked"))
    recent = _bounded_list(alerts, ["timestamp", "severity", "message"], [F.desc("timestamp")], 10, "recent_alerts")
    top = _bounded_list(sources, ["src_ip", "packets", "bytes"], [F.desc("packets"), "src_ip"], 10, "top_sources")
    out = totals
    for part in (now, base, prof, blocked, recent, top):
        out = key_join(out, part, LINK, "left")
    out = out.withColumn("blocked", F.coalesce("blocked", F.lit(0).cast("long")))
    for name in ("recent_alerts", "top_sources"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    out = out.select(*[c for c in out.columns if c != "__now"], "__now.*")
    if importance is not None:
        best = importance.limit(10).collect()  # ten rows
        out = out.withColumn("feature_importance", F.create_map(*[F.lit(x) for r in best for x in r]))
    return out
