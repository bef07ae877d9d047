"""State kept per key in a stream. Each processor applies the same rule as its batch operator."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import (
    BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State beyond memory, kept on local disk and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(rows, by):
    frames = [r for r in rows if not r.empty]
    return pd.concat(frames).sort_values(by, kind="stable") if frames else None


class Baseline(StatefulProcessor):
    """K3: the last ``samples`` rates of a link; gives the moments of the samples before each tick."""

    def __init__(self, samples=300, min_samples=10, ttl_ms=None):
        self.samples, self.min_samples, self.ttl_ms = samples, min_samples, ttl_ms

    def init(self, handle):
        schema = StructType([StructField(f"v{i}", DoubleType()) for i in range(5)])
        self.history = handle.getListState("history", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        ticks = _sorted(rows, "tick_start")
        if ticks is None:
            return
        cols = ["pps", "bps", "tcp_ratio", "udp_ratio", "icmp_ratio"]
        past = [tuple(r) for r in self.history.get()] if self.history.exists() else []
        seen = pd.DataFrame(past, columns=cols, dtype=float)
        all_rows = pd.concat([seen, ticks[cols].astype(float)], ignore_index=True)
        # Moments of the samples before each row.
        w = all_rows.shift(1).rolling(self.samples, min_periods=self.min_samples)
        mean, std = w.mean(), w.std(ddof=0)
        count = all_rows["pps"].shift(1).rolling(self.samples, min_periods=1).count()
        new = slice(len(seen), None)
        before = all_rows["pps"].shift(1)
        out = pd.DataFrame({
            "link_id": key[0], "tick_start": ticks["tick_start"].to_numpy(), "pps": all_rows["pps"][new].to_numpy(),
            "samples": count[new].fillna(0).astype("int64").to_numpy(),
            "mean_pps": mean["pps"][new].to_numpy(), "std_pps": std["pps"][new].to_numpy(),
            "mean_bps": mean["bps"][new].to_numpy(), "std_bps": std["bps"][new].to_numpy(),
            "prev_pps": before[new].to_numpy()})
        self.history.put([tuple(map(float, r)) for r in all_rows.tail(self.samples).itertuples(index=False)])
        yield out.astype(object).where(out.notna(), None)

    def close(self):
        pass


BASELINE_OUT = StructType([
    StructField("link_id", StringType()), StructField("tick_start", TimestampType()), StructField("pps", DoubleType()),
    StructField("samples", LongType()), StructField("mean_pps", DoubleType()), StructField("std_pps", DoubleType()),
    StructField("mean_bps", DoubleType()), StructField("std_bps", DoubleType()), StructField("prev_pps", DoubleType())])


def stream_baseline(ticks: DataFrame, samples: int = 300, min_samples: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """K3. ``ticks`` has pps, bps and the protocol shares; behind a windowed aggregation ticks arrive when they close."""
    out = ticks.groupBy("link_id").transformWithStateInPandas(
        Baseline(samples, min_samples, ttl_ms), BASELINE_OUT, "append", "ProcessingTime" if ttl_ms else "None")
    ready = F.col("samples") >= min_samples
    return (out.withColumn("pps_sigma", F.when(ready & (F.col("std_pps") > 0),
                                               (F.col("pps") - F.col("mean_pps")) / F.col("std_pps")))
            .withColumn("change_rate", F.when(F.col("prev_pps") > 0, F.col("pps") / F.col("prev_pps"))))


class Cooldown(StatefulProcessor):
    """K5: time of the last kept alert of a (link, type)."""

    def __init__(self, seconds=60.0, ttl_ms=None):
        self.gap, self.ttl_ms = int(round(seconds * 1_000_000)), ttl_ms

    def init(self, handle):
        self.last = handle.getValueState("last", StructType([StructField("t", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        alerts = _sorted(rows, ["t", "seq"])
        if alerts is None:
            return
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for i, t in enumerate(alerts["t"].tolist()):
            if last is None or t - last >= self.gap:
                keep.append(i)
                last = t
        self.last.update((last,))
        kept = alerts.iloc[keep]
        yield pd.DataFrame({"link_id": key[0], "type": key[1], "t": kept["t"].to_numpy(), "seq": kept["seq"].to_numpy()})

    def close(self):
        pass


def stream_cooldown(alerts: DataFrame, seconds: float = 60.0, ts: str = "timestamp", ttl_ms: int | None = None) -> DataFrame:
    """K5: the alerts that are kept, as (link_id, type, timestamp, seq)."""
    seq = F.col("seq") if "seq" in alerts.columns else F.lit(0).cast("long")
    out = (alerts.select("link_id", "type", F.unix_micros(ts).alias("t"), seq.alias("seq"))
           .groupBy("link_id", "type").transformWithStateInPandas(
               Cooldown(seconds, ttl_ms), StructType([StructField("link_id", StringType()), StructField("type", StringType()),
                                                      StructField("t", LongType()), StructField("seq", LongType())]),
               "append", "ProcessingTime" if ttl_ms else "None"))
    return out.select("link_id", "type", F.timestamp_micros("t").alias("timestamp"), "seq")


_PROFILE_STATE = StructType(
    [StructField(n, DoubleType()) for n in ("avg_pps", "peak_pps", "avg_bps", "peak_bps", "tcp", "udp", "icmp")]
    + [StructField("start", LongType()), StructField("samples", LongType()), StructField("learned", BooleanType())])

PROFILE_OUT = StructType(
    [StructField("link_id", StringType()), StructField("tick_start", TimestampType())]
    + [StructField(n, DoubleType()) for n in ("avg_pps", "peak_pps", "avg_bps", "peak_bps", "tcp_ratio", "udp_ratio",
                                              "icmp_ratio")]
    + [StructField("learning_samples", LongType()), StructField("is_learned", BooleanType()), StructField("start_us", LongType()),
       StructField("sum_pps", DoubleType()), StructField("sum_bps", DoubleType())])


class Profile(StatefulProcessor):
    """K7: learns over the first ``seconds`` of event time, then follows with an exponential average.

    While learning the state holds sums; the tick that ends the period turns them into means and is not used itself.
    With ``every_tick`` there is a row while learning, too, from which a later run can go on.
    """

    def __init__(self, seconds=3600.0, alpha=0.05, ttl_ms=None, every_tick=False):
        self.period, self.alpha, self.ttl_ms, self.every_tick = int(seconds * 1_000_000), alpha, ttl_ms, every_tick

    def init(self, handle):
        self.state = handle.getValueState("profile", _PROFILE_STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues):
        """Goes on from the row that an earlier run wrote last."""
        r = initialState.iloc[0]
        learned = bool(r.is_learned)
        sums = (r.avg_pps, r.avg_bps) if learned else (r.sum_pps, r.sum_bps)
        self.state.update((float(sums[0]), float(r.peak_pps), float(sums[1]), float(r.peak_bps), float(r.tcp_ratio),
                           float(r.udp_ratio), float(r.icmp_ratio), int(r.start_us), int(r.learning_samples), learned))

    def handleInputRows(self, key, rows, timerValues):
        ticks = _sorted(rows, "tick_start")
        if ticks is None:
            return
        a = self.alpha
        s = list(self.state.get()) if self.state.exists() else [0.0, 0.0, 0.0, 0.0, 0.85, 0.10, 0.05, None, 0, False]
        out = []
        for r in ticks.itertuples(index=False):
            t = int(r.t)
            if s[7] is None:
                s[7] = t
            if not s[9] and t - s[7] < self.period:
                s[0], s[2] = s[0] + r.pps, s[2] + r.bps
                s[1], s[3] = max(s[1], r.pps), max(s[3], r.bps)
                if r.proto_packets > 0:
                    s[4:7] = [r.tcp_ratio, r.udp_ratio, r.icmp_ratio]
                else:
                    s[4:7] = [0.85, 0.10, 0.05]
                s[8] += 1
            elif not s[9]:
                s[0], s[2], s[9] = s[0] / s[8], s[2] / s[8], True
            else:
                s[0], s[2] = (1 - a) * s[0] + a * r.pps, (1 - a) * s[2] + a * r.bps
                s[1], s[3] = max(s[1], r.pps), max(s[3], r.bps)
            if s[9]:
                out.append((key[0], r.tick_start, *s[:7], s[8], True, s[7], None, None))
            elif self.every_tick:
                out.append((key[0], r.tick_start, s[0] / s[8], s[1], s[2] / s[8], *s[3:7], s[8], False, s[7], s[0], s[2]))
        self.state.update(tuple(s))
        yield pd.DataFrame(out, columns=[f.name for f in PROFILE_OUT])

    def close(self):
        pass


def stream_profile(rates: DataFrame, seconds: float = 3600.0, alpha: float = 0.05, ttl_ms: int | None = None,
                   initial: DataFrame | None = None, every_tick: bool = False) -> DataFrame:
    """K7: the profile after each tick from the end of the learning period on, or after every tick.

    ``initial`` has the last row of each link from an earlier run (``read_profiles``), which was made with ``every_tick``.
    """
    return (rates.withColumn("t", F.unix_micros("tick_start"))
            .groupBy("link_id").transformWithStateInPandas(
                Profile(seconds, alpha, ttl_ms, every_tick), PROFILE_OUT, "append", "ProcessingTime" if ttl_ms else "None",
                initialState=initial.groupBy("link_id") if initial is not None else None))
