"""Streaming forms of the operators: windowed counters, scoring in micro-batches, the closed loop, and sinks.

Ticks are event-time windows. A window is emitted once the watermark has passed its end, with all its groups in the same
micro-batch, so micro-batch code sees whole ticks and can call the batch operators. What must outlive a batch (the last
ticks of a link, the block list) is written per batch number below a state folder; a batch that is run again reads the
state of the batch before it and writes the same result once more.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.config import TICK, DetectionConfig, FeatureConfig
from tidegauge.functions import columns as C
from tidegauge.operators import features as feat, lists, ordered, ranking, rules, traffic
from tidegauge.plans import detection
from tidegauge.plans.spread import key_join
from tidegauge.schemas import BLACKLIST, COUNTERS, FLAG_COUNTERS
from tidegauge.sources.tables import TIMES


def _seconds(s) -> str:
    return f"{int(round(s * 1_000_000))} microseconds"


def windowed(packets: DataFrame, tick_seconds: float, delay: str = "0 seconds", slide: float | None = None) -> DataFrame:
    """Packets with a watermark and their event-time window as ``w``."""
    win = F.window("ts", _seconds(tick_seconds), _seconds(slide)) if slide else F.window("ts", _seconds(tick_seconds))
    return packets.withWatermark("ts", delay).withColumn("w", win)


def stream_ticks(packets: DataFrame, tick_seconds: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """K1: the counters of every closed tick."""
    df = windowed(packets, tick_seconds, delay)
    return (df.groupBy("link_id", "w").agg(*traffic._counter_aggs(df))
            .withColumn("tick_start", F.col("w.start")).withColumn("tick_seconds", F.lit(float(tick_seconds))).drop("w"))


def stream_rates(packets: DataFrame, tick_seconds: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """Closed ticks with rates and protocol shares, the input of the baseline and profile processors."""
    return ordered.tick_rates(traffic.protocol_ratios(stream_ticks(packets, tick_seconds, delay)))


def stream_ip_stats(packets: DataFrame, tick_seconds: float | None = 1.0, delay: str = "0 seconds") -> DataFrame:
    """K2: per-source counts of every closed tick; with ``tick_seconds=None`` running totals (update mode).

    Running totals keep one state row per source for good; bound them with the state TTL of the session or prefer ticks.
    """
    if tick_seconds is None:
        return packets.groupBy("link_id", "src_ip").agg(*traffic._source_aggs())
    df = windowed(packets, tick_seconds, delay)
    return (df.groupBy("link_id", "w", "src_ip").agg(*traffic._source_aggs())
            .withColumn("tick_start", F.col("w.start")).drop("w"))


def stream_source_ticks(packets: DataFrame, tick_seconds: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """Per-source rows of every closed tick with all counters, the input of the micro-batch jobs below."""
    df = windowed(packets, tick_seconds, delay)
    counters = [a.alias(f"all_{n}") for a, n in zip(traffic._counter_aggs(df), COUNTERS)]
    flags = [F.count_if(C.has_flag(f)).alias(f"all_{f}_packets") for f in C.FLAG_BITS]
    return (df.groupBy("link_id", "w", "src_ip").agg(*traffic._source_aggs(), *counters, *flags)
            .withColumn("tick_start", F.col("w.start")).drop("w"))


def sliding_counters(packets: DataFrame, length: float = 10.0, slide: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """Counters over overlapping windows."""
    df = windowed(packets, length, delay, slide)
    return (df.groupBy("link_id", "w").agg(*traffic._counter_aggs(df))
            .withColumn("window_start", F.col("w.start")).drop("w"))


def stream_episodes(scores: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Runs of anomalous ticks. A session still open at the end of the input is not emitted."""
    return (scores.filter("is_anomaly").withWatermark("tick_start", delay)
            .groupBy("link_id", F.session_window("tick_start", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("ticks"), F.max("score").alias("max_score"))
            .select("link_id", F.col("s.start").alias("started"), F.col("s.end").alias("closed"), "ticks", "max_score"))


def late_count(query) -> int:
    """Rows a query has dropped because they came after the watermark, in the reports that Spark still has.

    A lower bound: Spark keeps the last 100 reports, and behind a partial aggregation a row is a group of packets.
    ``late_packets`` gives them all.
    """
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for p in query.recentProgress for op in p["stateOperators"])


def replay(df: DataFrame, folder: str, slices, files: int = 1) -> DataFrame:
    """A stream that takes a table in as many micro-batches as ``slices`` (Columns that pick rows) has members, in order.

    Every slice is written as ``files`` files, one slice after the other, since a file source reads old files first; a
    slice with fewer rows than files would share its batch with the next one.
    """
    for rows in slices:
        df.filter(rows).repartition(files).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def time_slices(ts: str, start: str, seconds: int, count: int):
    """Conditions of ``count`` spans of equal length from ``start`` on; the first takes all before, the last all after."""
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit(start)))) / (seconds * 1_000_000))
    place = F.least(F.greatest(at, F.lit(0)), F.lit(count - 1))
    return [place == k for k in range(count)]


# -- micro-batch jobs ------------------------------------------------------------------------------

class BatchState:
    """Small tables carried from batch to batch, one folder per batch number."""

    def __init__(self, spark, path, schemas):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _folder(self, name, batch):
        return f"{self.path}/{name}/batch={batch}"

    def before(self, name, batch):
        """The table as the batch before left it; empty before the first."""
        if batch == 0:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(self._folder(name, batch - 1))

    def write(self, name, batch, df):
        df.write.mode("overwrite").parquet(self._folder(name, batch))
        return self.spark.read.schema(df.schema).parquet(self._folder(name, batch))

    def latest(self, name, batch):
        return self.spark.read.parquet(self._folder(name, batch))


_RATES = ("link_id string, tick_start timestamp, pps double, bps double, tcp_ratio double, udp_ratio double, "
          "icmp_ratio double, n long")


def _last_ticks(ticks, n):
    w = Window.partitionBy("link_id").orderBy(F.desc("tick_start"))
    return ticks.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n).drop("__i")


def score_batch(state: BatchState, cfg: DetectionConfig, sources: DataFrame, batch: int) -> DataFrame:
    """K4: scores the closed ticks of one batch against the link's last ticks. The batch's ticks are written once."""
    if cfg.scope != TICK:
        raise ValueError("streams score with scope='tick'; cumulative shares need a state row per source for ever")
    ticks = state.write("ticks", batch, detection.tick_table(sources, cfg))
    past = state.before("history", batch)
    start = past.groupBy("link_id").agg(F.max("n").alias("__n"))
    numbered = key_join(ordered.number_ticks(ticks), start, ["link_id"], "left")
    numbered = numbered.withColumn("n", F.col("n") + F.coalesce("__n", F.lit(0))).drop("__n").withColumn("__new", F.lit(True))
    both = numbered.unionByName(past.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    both = state.write("window", batch, both)
    names = [c.split()[0] for c in _RATES.split(", ")]
    state.write("history", batch, _last_ticks(both.select(*names), cfg.baseline_samples))
    based = ordered.baseline(both, cfg.baseline_samples, cfg.frame, cfg.min_samples)
    return rules.score_ticks(based.filter("__new").drop("__new"), cfg)


def scoring_state(spark, path) -> BatchState:
    return BatchState(spark, path, {"history": _RATES, "blacklist": BLACKLIST,
                                    "kept": "link_id string, type string, timestamp timestamp"})


def _start(stream, work, checkpoint, trigger):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(work)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_scores(packets: DataFrame, out: str, state_path: str, checkpoint: str,
                  cfg: DetectionConfig = DetectionConfig(scope=TICK), delay: str = "0 seconds", trigger=None):
    """K4: scored ticks, one folder per batch below ``out``. Returns the running query."""
    state = scoring_state(packets.sparkSession, state_path)

    def work(sources, batch):
        score_batch(state, cfg, sources, batch).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return _start(stream_source_ticks(packets, cfg.tick_seconds, delay), work, checkpoint, trigger)


def block_sources(sources: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Per-tick source rows under a block list: a listed source's packets count as dropped and are not tracked.

    Entries begin at the end of a tick, so a tick is blocked as a whole or not at all.
    """
    marked = lists.listed_at(sources.withColumn("ts", F.col("tick_start")).withColumn("seq", F.col("src_ip")), blacklist)
    hit = F.col("blacklisted")
    changed = {c: F.when(hit, F.lit(0).cast("long")).otherwise(F.col(c)) for c in
               ("packets", "bytes", "syn_count", "udp_count", "all_passed_packets", "all_passed_bytes")}
    changed["all_dropped_packets"] = F.when(hit, F.col("all_packets")).otherwise(F.col("all_dropped_packets"))
    changed["all_dropped_bytes"] = F.when(hit, F.col("all_bytes")).otherwise(F.col("all_dropped_bytes"))
    return marked.withColumns(changed).drop("ts", "seq", "blacklisted")


def run_closed_loop(packets: DataFrame, out: str, state_path: str, checkpoint: str,
                    cfg: DetectionConfig = DetectionConfig(scope=TICK), blacklist: DataFrame | None = None,
                    delay: str = "0 seconds", trigger=None):
    """K6: score, keep alerts, block their top sources; blocked sources are dropped from the next batch on.

    Writes ``scores`` and ``alerts`` below ``out`` and the block list to the state folder. Returns the running query.
    """
    spark = packets.sparkSession
    state = scoring_state(spark, state_path)

    def work(sources, batch):
        listed = state.before("blacklist", batch)
        if batch == 0 and blacklist is not None:
            listed = blacklist.select("link_id", "src_ip", "added_at", "removed_at")
        seen = state.write("sources", batch, block_sources(sources, listed))
        scores = score_batch(state, cfg, seen, batch)
        scores.write.mode("overwrite").parquet(f"{out}/scores/batch={batch}")
        scored = spark.read.schema(scores.schema).parquet(f"{out}/scores/batch={batch}")
        before = state.before("kept", batch)
        # The last kept alerts come first in time and are kept again, so the new ones are judged against them.
        fresh = rules.to_alerts(scored, cfg)
        times = fresh.select("link_id", "type", "timestamp").unionByName(before)
        kept = state.write("kept_all", batch, ordered.cooldown(times, cfg.cooldown_seconds))
        last = kept.groupBy("link_id", "type").agg(F.max("timestamp").alias("timestamp"))
        state.write("kept", batch, last)
        new = key_join(key_join(fresh, kept, ["link_id", "type", "timestamp"], "left_semi"),
                       before, ["link_id", "type", "timestamp"], "left_anti")
        new.write.mode("overwrite").option("timestampFormat", TIMES).json(f"{out}/alerts/batch={batch}")
        found = ranking.block_candidates(seen, new, cfg.block_top, cfg.block_packets)
        state.write("blacklist", batch, detection.extend_blacklist(listed, found, cfg.tick_seconds))
    return _start(stream_source_ticks(packets, cfg.tick_seconds, delay), work, checkpoint, trigger)


_TICK_COLUMNS = ["link_id", "tick_start", "tick_seconds", "packets", "bytes", "tcp_packets", *FLAG_COUNTERS]


def feature_batch(state: BatchState, sources: DataFrame, tick_seconds: float, batch: int,
                  cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """K8: features of the batch's closed ticks, over a window that reaches back into earlier batches."""
    ticks = (sources.groupBy("link_id", "tick_start")
             .agg(*[F.sum(f"all_{c}").alias(c) for c in _TICK_COLUMNS[3:]])
             .withColumn("tick_seconds", F.lit(float(tick_seconds))).withColumn("new", F.lit(True)))
    past = state.before("feature_ticks", batch).withColumn("new", F.lit(False))
    both = state.write("feature_input", batch, ticks.select(*_TICK_COLUMNS, "new").unionByName(past.select(*_TICK_COLUMNS, "new")))
    carry = state.before("feature_carry", batch)
    frame = feat.feature_frame(both, cfg, carry=carry)
    kept = state.write("feature_ticks", batch, _last_ticks(both.select(*_TICK_COLUMNS), cfg.window_samples))
    # What the next batch no longer sees: totals so far, less those of the ticks it does see.
    def totals(df):
        return df.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"), F.min("tick_start").alias("first"),
                                         *[F.sum(c).alias(c) for c in feat.TOTALS])
    here, stay = totals(both), totals(kept)
    stay = stay.select("link_id", F.col("n").alias("s_n"), *[F.col(c).alias(f"s_{c}") for c in feat.TOTALS])
    left = key_join(key_join(here, stay, ["link_id"]), carry, ["link_id"], "left")
    zero = F.lit(0)
    state.write("feature_carry", batch, left.select(
        "link_id", (F.coalesce("n_before", zero) + F.col("n") - F.col("s_n")).alias("n_before"),
        F.least("epoch_before", "first").alias("epoch_before"),
        *[(F.coalesce(f"{c}_before", zero) + F.col(c) - F.col(f"s_{c}")).alias(f"{c}_before") for c in feat.TOTALS]))
    return feat.flow_features(None, cfg, frame=frame.filter("new"))


def feature_state(spark, path) -> BatchState:
    ticks = ("link_id string, tick_start timestamp, tick_seconds double, packets long, bytes long, tcp_packets long, "
             + ", ".join(f"{c} long" for c in FLAG_COUNTERS))
    carry = "link_id string, n_before long, epoch_before timestamp, " + ", ".join(f"{c}_before long" for c in feat.TOTALS)
    return BatchState(spark, path, {"feature_ticks": ticks, "feature_carry": carry})


def stream_features(packets: DataFrame, out: str, state_path: str, checkpoint: str, tick_seconds: float = 1.0,
                    model=None, cfg: FeatureConfig = FeatureConfig(), delay: str = "0 seconds", trigger=None):
    """K8: features of every closed tick, with the model's prediction if there is one."""
    from tidegauge.operators.learn import predict
    state = feature_state(packets.sparkSession, state_path)

    def work(sources, batch):
        rows = feature_batch(state, sources, tick_seconds, batch, cfg)
        (predict(model, rows) if model is not None else rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return _start(stream_source_ticks(packets, tick_seconds, delay), work, checkpoint, trigger)


def late_packets(packets: DataFrame, out: str, state_path: str, checkpoint: str, tick_seconds: float, delay_seconds: float,
                 trigger=None):
    """The packets that come when their tick is already closed, which ticks with this ``delay`` leave out.

    They are found before any aggregation, by the watermark that the batches before them have reached (to the millisecond,
    as Spark's), and written to one folder per batch below ``out``; a batch that runs again writes the same rows. So the
    table is whole over any number of batches. Returns the running query.
    """
    state = BatchState(packets.sparkSession, state_path, {"seen": "at_us long"})
    tick, delay = int(round(tick_seconds * 1_000_000)), int(round(delay_seconds * 1_000_000))

    def work(rows, batch):
        before = state.before("seen", batch)
        mark = before.agg(F.max("at_us")).first()[0]
        end = (F.floor(F.unix_micros("ts") / tick) + 1) * tick
        late = rows.filter(end <= F.lit(mark)) if mark is not None else rows.limit(0)
        late.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        reached = F.floor(F.max(F.unix_micros("ts")) / 1000) * 1000 - delay
        state.write("seen", batch, rows.agg(reached.alias("at_us")).unionByName(before).agg(F.max("at_us").alias("at_us")))
    return _start(packets, work, checkpoint, trigger)


# -- sinks -----------------------------------------------------------------------------------------

def profile_sink(profiles: DataFrame, path: str, checkpoint: str, trigger=None):
    """After every batch, the latest profile of each link that changed, as JSON."""
    def work(batch_df, batch):
        cols = [c for c in batch_df.columns if c != "link_id"]
        latest = batch_df.groupBy("link_id").agg(F.max_by(F.struct(*cols), "tick_start").alias("p"))
        latest.select("link_id", "p.*").write.mode("overwrite").option("timestampFormat", TIMES).json(f"{path}/batch={batch}")
    return _start(profiles, work, checkpoint, trigger)


def read_profiles(spark, path: str) -> DataFrame:
    """The latest profile of each link that any run and batch below ``path`` has written; the start of the next run."""
    from tidegauge.streaming.processors import PROFILE_OUT
    rows = spark.read.schema(PROFILE_OUT).option("recursiveFileLookup", True).option("timestampFormat", TIMES).json(path)
    cols = [c for c in rows.columns if c != "link_id"]
    return rows.groupBy("link_id").agg(F.max_by(F.struct(*cols), "tick_start").alias("p")).select("link_id", "p.*")


def totals_sink(totals: DataFrame, path: str, checkpoint: str, trigger=None):
    """K2: the totals that a batch has changed, one folder per batch; a batch that runs again writes the same rows."""
    def work(batch_df, batch):
        batch_df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    writer = totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(work)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_totals(spark, path: str) -> DataFrame:
    """K2: the last totals of every source that ``totals_sink`` has written."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in ("link_id", "src_ip", "batch")]
    return rows.groupBy("link_id", "src_ip").agg(F.max_by(F.struct(*cols), "batch").alias("t")).select("link_id", "src_ip", "t.*")


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, trigger=None):
    """Alerts appended as JSON lines, exactly once with the checkpoint."""
    return (alerts.writeStream.format("json").outputMode("append").option("timestampFormat", TIMES).option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
