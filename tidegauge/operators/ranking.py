"""Top lists, recent rows and block candidates."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.plans.spread import day_bucket, running, small_join


def top_sources(sources: DataFrame, k: int = 10, per_link: bool = True) -> DataFrame:
    """sources with the most packets; ties go to the smaller address.

    Filtering a row number lets every task cut its part to k rows before the shuffle.
    """
    return _top(sources, k, per_link, ["src_ip"])


def top_flows(flows: DataFrame, k: int = 10, per_link: bool = True) -> DataFrame:
    """F2"""
    return _top(flows, k, per_link, ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"])


def _top(df, k, per_link, tie):
    if not per_link:
        return df.orderBy(F.desc("packets"), *tie).limit(k)
    w = Window.partitionBy("link_id").orderBy(F.desc("packets"), *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def block_candidates(sources: DataFrame, alerts: DataFrame, top: int = 5, more_than: int = 10_000) -> DataFrame:
    """of the top sources of every tick with a kept alert, those above the packet threshold."""
    alerted = alerts.select("link_id", F.col("timestamp").alias("tick_start")).distinct()
    w = Window.partitionBy("link_id", "tick_start").orderBy(F.desc("packets"), "src_ip")
    busy = small_join(sources.filter(F.col("packets") > more_than), alerted, ["link_id", "tick_start"], "left_semi")
    # All sources above the threshold rank before all others, so the filter may come first.
    return busy.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def block_candidates_since(sources: DataFrame, alerts: DataFrame, top: int = 5, more_than: int = 10_000) -> DataFrame:
    """F3 on totals since the start: of the top sources so far at every tick with a kept alert, those above the threshold.

    ``sources`` are per-tick rows. A tick that adds no source has the top of the tick before it.
    """
    from tidegauge.operators.traffic import cumulative_members
    members = cumulative_members(sources.filter("packets > 0"), top).select(
        "link_id", "tick_start", F.lit(0).alias("kind"), F.struct("tick_start", "top_sources", "top_totals").alias("m"))
    alerted = alerts.select("link_id", F.col("timestamp").alias("tick_start"), F.lit(1).alias("kind")).distinct()
    along = running(members.unionByName(alerted, allowMissingColumns=True), ["link_id"], ["tick_start", "kind"],
                    day_bucket("tick_start"), maxs={"last": "m"})
    found = along.filter("kind = 1").select(
        "link_id", "tick_start", F.posexplode(F.arrays_zip("last.top_sources", "last.top_totals")).alias("at", "s"))
    return found.select("link_id", "tick_start", F.col("s.top_sources").alias("src_ip"), F.col("s.top_totals").alias("packets"),
                        (F.col("at") + 1).alias("rank")).filter(F.col("packets") > more_than)


def recent_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    """F4"""
    return alerts.orderBy(F.desc("timestamp"), *[c for c in ("link_id", "type") if c in alerts.columns]).limit(n)


def alert_rollup(alerts: DataFrame, seconds: int = 3600) -> DataFrame:
    """Alerts per time span, type and severity."""
    from tidegauge.functions.columns import tick_start
    return (alerts.groupBy(tick_start("timestamp", seconds).alias("span_start"), "type", "severity")
            .agg(F.count(F.lit(1)).alias("alerts")))


def shuffle_rows(df: DataFrame, seed: int = 42, key=None) -> DataFrame:
    """rows in a random order that depends only on their content and the seed (range-partitioned sort)."""
    key = key or df.columns
    return df.orderBy(shuffle_key(key, seed), *[F.col(f"`{c}`") for c in key])


def shuffle_key(key, seed: int = 42) -> Column:
    """MD5 of the values as text and the seed; a null has no text but keeps its place."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))
