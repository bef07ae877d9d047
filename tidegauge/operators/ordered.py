"""Operators along time: rates, trailing baselines, running totals, exponential averages, alert cooldown.

Input is per tick (or per snapshot, or per alert candidate); every operator spreads a link over chunks of its time line
(see ``plans.spread``), so one long link is as parallel as many short ones.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions import columns as C
from tidegauge.plans.spread import (
    day_bucket, key_join, numbered, owned, previous, running, runs, settle, small_join, with_halo,
)

LINK = ["link_id"]
CHUNK = 8192


def counter_rates(counters: DataFrame, start=None) -> DataFrame:
    """Packets and bytes per second between cumulative snapshots; snapshots without time passed are skipped.

    The first snapshot has no predecessor: its rates are null, or with ``start`` (Column or timestamp text, when the
    counters began) its totals over the time since then.
    """
    df = previous(counters, LINK, ["ts"], day_bucket("ts"), ["ts", "packets", "bytes"])
    if start is None:
        since, p0, b0 = F.col("prev_ts"), F.col("prev_packets"), F.col("prev_bytes")
    else:
        start = F.to_timestamp(F.lit(start)) if isinstance(start, str) else start
        since = F.coalesce("prev_ts", start)
        p0, b0 = F.coalesce("prev_packets", F.lit(0)), F.coalesce("prev_bytes", F.lit(0))
    df = df.withColumn("seconds", C.seconds_between(since, "ts"))
    return (df.filter(F.col("seconds").isNull() | (F.col("seconds") > 0))
            .withColumn("pps", (F.col("packets") - p0) / F.col("seconds"))
            .withColumn("bps", (F.col("bytes") - b0) / F.col("seconds"))
            .drop("prev_ts", "prev_packets", "prev_bytes"))


def tick_rates(ticks: DataFrame) -> DataFrame:
    """E2"""
    return (ticks.withColumn("pps", F.col("packets") / F.col("tick_seconds"))
            .withColumn("bps", F.col("bytes") / F.col("tick_seconds")))


def cumulate(ticks: DataFrame, columns, prefix="cum_") -> DataFrame:
    """Running totals since the first tick."""
    return running(ticks, LINK, ["tick_start"], day_bucket("tick_start"),
                   sums={f"{prefix}{c}": c for c in columns})


def number_ticks(ticks: DataFrame) -> DataFrame:
    """Adds ``n``, the tick's 1-based number on its link."""
    return numbered(ticks, LINK, ["tick_start"], day_bucket("tick_start"))


def baseline(rates: DataFrame, samples: int = 300, frame: str = "prior", min_samples: int = 10,
             chunk: int = CHUNK) -> DataFrame:
    """Trailing means and population deviations of pps and bps, mean protocol shares, z-score, change rate.

    ``frame='prior'`` looks at the ticks before the current one, ``'inclusive'`` counts the current one as well.
    Baseline columns are null below ``min_samples``.
    """
    rates = rates if "n" in rates.columns else number_ticks(rates)
    work = with_halo(rates, "n", chunk, samples)
    order = Window.partitionBy(*LINK, "__chunk").orderBy("n")
    w = order.rowsBetween(-samples, -1) if frame == "prior" else order.rowsBetween(-(samples - 1), 0)
    count = F.count(F.lit(1)).over(w)
    aggs = {"mean_pps": F.avg("pps"), "std_pps": F.stddev_pop("pps"),
            "mean_bps": F.avg("bps"), "std_bps": F.stddev_pop("bps")}
    for r in ("tcp_ratio", "udp_ratio", "icmp_ratio"):
        if r in rates.columns:
            aggs[f"mean_{r}"] = F.avg(r)
    work = work.select("*", F.lag("pps", 1).over(order).alias("prev_pps"), count.alias("history"),
                       *[a.over(w).alias(f"__{name}") for name, a in aggs.items()])
    ready = F.col("history") >= min_samples
    work = work.select(
        *[c for c in work.columns if c not in {f"__{n}" for n in aggs}],
        *[F.when(ready, F.col(f"__{n}")).alias(n) for n in aggs],
        F.when(ready, F.col("history")).alias("samples"))
    sigma = F.when(F.col("std_pps") > 0, (F.col("pps") - F.col("mean_pps")) / F.col("std_pps"))
    change = F.when(F.col("prev_pps") > 0, F.col("pps") / F.col("prev_pps"))
    return owned(work.withColumn("pps_sigma", sigma).withColumn("change_rate", change))


def attach_baseline(ticks: DataFrame, stored: DataFrame) -> DataFrame:
    """C3 for a stored baseline: adds to each tick the columns of the link's latest row of ``stored`` (``valid_from``) at
    or before it.

    Stored rows are put among the ticks; the latest one so far is a running maximum of (time, values).
    """
    values = [c for c in stored.columns if c not in ("link_id", "valid_from")]
    marks = stored.select("link_id", F.col("valid_from").alias("tick_start"), F.struct("valid_from", *values).alias("__s"),
                          F.lit(0).alias("__kind"))
    both = ticks.withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    out = running(both, LINK, ["tick_start", "__kind"], day_bucket("tick_start"), maxs={"__now": "__s"})
    return out.filter("__kind = 1").select(*ticks.columns, "__now.valid_from", *[f"__now.{c}" for c in values])


def inter_arrival(ticks: DataFrame) -> DataFrame:
    """Milliseconds since the tick before, null on the first."""
    df = previous(ticks, LINK, ["tick_start"], day_bucket("tick_start"), ["tick_start"])
    return (df.withColumn("iat_ms", C.seconds_between("prev_tick_start", "tick_start") * 1000)
            .drop("prev_tick_start"))


# -- long-term profile -----------------------------------------------------------------------------

def learning_phases(rates: DataFrame, seconds: float = 3600.0, since=None) -> DataFrame:
    """Adds ``learn_start`` and ``phase``: 'learn' within the learning period of the link, 'boundary' for the tick that
    ends it, 'follow' after that. A link's start is a running minimum, so nothing is joined."""
    if since is not None:
        since = F.to_timestamp(F.lit(since)) if isinstance(since, str) else since
        rates = rates.filter(F.col("tick_start") >= since)
    df = running(rates, LINK, ["tick_start"], day_bucket("tick_start"), mins={"learn_start": "tick_start"})
    df = previous(df, LINK, ["tick_start"], day_bucket("tick_start"), ["tick_start"])
    learning = C.seconds_between("learn_start", "tick_start") < seconds
    boundary = C.seconds_between("learn_start", "prev_tick_start") < seconds
    return (df.withColumn("phase", F.when(learning, "learn").when(boundary, "boundary").otherwise("follow"))
            .drop("prev_tick_start"))


def learn_profile(rates: DataFrame, seconds: float = 3600.0, since=None) -> DataFrame:
    """Mean and peak rates over the learning period of each link.

    The period starts with the link's first tick, or with the first at or after ``since`` (relearning). Protocol shares
    are those of the period's last tick that has any, else the defaults.
    """
    period = learning_phases(rates, seconds, since).filter("phase = 'learn'")
    last = F.max_by(F.struct("proto_packets", "tcp_ratio", "udp_ratio", "icmp_ratio"), "tick_start")
    out = period.groupBy(*LINK).agg(
        F.avg("pps").alias("avg_pps"), F.max("pps").alias("peak_pps"),
        F.avg("bps").alias("avg_bps"), F.max("bps").alias("peak_bps"),
        last.alias("__l"), F.count(F.lit(1)).alias("learning_samples"),
        F.min("learn_start").alias("learn_start"), F.max("tick_start").alias("last_updated"))

    def share(name, default):
        return F.when(F.col("__l.proto_packets") > 0, F.col(f"__l.{name}")).otherwise(default).alias(name)

    return out.select(
        *LINK, "avg_pps", "peak_pps", "avg_bps", "peak_bps", share("tcp_ratio", 0.85), share("udp_ratio", 0.10),
        share("icmp_ratio", 0.05), "learning_samples", "learn_start", "last_updated", F.lit(True).alias("is_learned"))


def after_learning(rates: DataFrame, seconds: float = 3600.0, since=None, keep_boundary: bool = False) -> DataFrame:
    """Ticks that update a learned profile.

    The tick that ends the learning period only triggers the computation and is used for neither; ``keep_boundary``
    keeps it.
    """
    used = ["follow", "boundary"] if keep_boundary else ["follow"]
    return learning_phases(rates, seconds, since).filter(F.col("phase").isin(used)).drop("phase", "learn_start")


def ema(ticks: DataFrame, columns, seeds: DataFrame, alpha: float = 0.05, chunk: int | None = None) -> DataFrame:
    """Exponential averages y = (1-alpha)*y + alpha*x, started from the link's seed; adds ``ema_<column>``.

    ``seeds`` has one row per link with ``seed_<column>``; without a row the seed is 0. What a chunk of ticks does to the
    average is a factor and a sum, y -> factor*y + sum. These are found per chunk and composed along the link, so every
    chunk starts from the exact average before it, at any length. Inside a chunk the average is a running sum of
    x * (1-alpha)^-i times (1-alpha)^i; chunks are short enough for that factor to stay within range.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be above 0 and at most 1, not {alpha}")
    if alpha == 1:
        return ticks.withColumns({f"ema_{c}": F.col(c).cast("double") for c in columns})
    keep = 1.0 - alpha
    size = max(min(chunk or CHUNK, int(-200 / math.log10(keep))), 1)
    power = F.pow(F.lit(keep), F.col("__i"))
    work = numbered(ticks, LINK, ["tick_start"], day_bucket("tick_start"), "__n")
    work = work.withColumn("__chunk", F.floor((F.col("__n") - 1) / F.lit(size)).cast("long"))
    work = work.withColumn("__i", (F.col("__n") - F.col("__chunk") * size).cast("double")).withColumns(
        {f"__x_{c}": F.col(c) * alpha / power for c in columns})
    steps = work.groupBy(*LINK, "__chunk").agg(F.min(power).alias("__factor"),
                                               *[F.sum(f"__x_{c}").alias(f"__x_{c}") for c in columns])
    step = F.struct("__chunk", "__factor", *[(F.col(f"__x_{c}") * F.col("__factor")).alias(c) for c in columns])
    along = steps.groupBy(*LINK).agg(F.array_sort(F.collect_list(step)).alias("__steps"))
    along = small_join(along, seeds.select(*LINK, *[F.coalesce(f"seed_{c}", F.lit(0.0)).alias(f"seed_{c}") for c in columns]), LINK, "left")
    first = F.struct(*[F.coalesce(f"seed_{c}", F.lit(0.0)).cast("double").alias(c) for c in columns])
    # The averages before each chunk: one more than there are chunks, the last is not needed.
    starts = F.aggregate("__steps", F.array(first), lambda done, s: F.concat(done, F.array(F.struct(*[
        (s["__factor"] * F.element_at(done, -1)[c] + s[c]).alias(c) for c in columns]))))
    starts = along.select(*LINK, F.posexplode(starts).alias("__at", "__start"))
    starts = starts.select(*LINK, F.col("__at").cast("long").alias("__chunk"), "__start")
    so_far = Window.partitionBy(*LINK, "__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = key_join(work, starts, [*LINK, "__chunk"], "left")
    for c in columns:
        work = work.withColumn(f"ema_{c}", (F.col(f"__start.{c}") + F.sum(f"__x_{c}").over(so_far)) * power)
    return work.drop("__n", "__chunk", "__i", "__start", *[f"__x_{c}" for c in columns])


def adapt_profile(rates: DataFrame, profile: DataFrame, seconds: float = 3600.0, alpha: float = 0.05, since=None,
                  keep_boundary: bool = False, chunk: int | None = None) -> DataFrame:
    """The learned profile carried on through later ticks: exponential averages and running peaks.

    ``since`` is that of ``learn_profile``. The profile is one row per link and is written first.
    """
    profile = settle(profile)
    later = after_learning(rates, seconds, since, keep_boundary).select(*LINK, "tick_start", "pps", "bps")
    seeds = profile.select(*LINK, F.col("avg_pps").alias("seed_pps"), F.col("avg_bps").alias("seed_bps"))
    out = ema(later, ["pps", "bps"], seeds, alpha, chunk)
    out = running(out, LINK, ["tick_start"], day_bucket("tick_start"),
                  maxs={"max_pps": "pps", "max_bps": "bps"})
    peaks = profile.select(*LINK, F.col("peak_pps").alias("__pp"), F.col("peak_bps").alias("__pb"))
    return small_join(out, peaks, LINK, "left").select(
        *LINK, "tick_start", "pps", "bps", F.col("ema_pps").alias("avg_pps"), F.col("ema_bps").alias("avg_bps"),
        F.greatest("max_pps", "__pp").alias("peak_pps"), F.greatest("max_bps", "__pb").alias("peak_bps"))


def current_profile(rates: DataFrame, profile: DataFrame, seconds: float = 3600.0, alpha: float = 0.05) -> DataFrame:
    """One row per link: the learned profile with its averages and peaks as of the last tick."""
    now = (adapt_profile(rates, profile, seconds, alpha).groupBy(*LINK)
           .agg(F.max_by(F.struct("avg_pps", "peak_pps", "avg_bps", "peak_bps", "tick_start"), "tick_start")
                .alias("__now")))
    out = key_join(profile, now, LINK, "left")
    changed = ["avg_pps", "peak_pps", "avg_bps", "peak_bps"]
    for c in changed:
        out = out.withColumn(c, F.coalesce(F.col(f"__now.{c}"), F.col(c)))
    return out.withColumn("last_updated", F.coalesce("__now.tick_start", "last_updated")).drop("__now")


# -- host metrics ----------------------------------------------------------------------------------

def host_summary(metrics: DataFrame, last: int = 60) -> DataFrame:
    """Means of CPU and memory over the last samples, the latest memory use, and the number of samples."""
    recent = Window.partitionBy(*LINK).orderBy(F.desc("ts"), F.desc("seq"))
    rows = metrics.withColumn("__i", F.row_number().over(recent)).filter(F.col("__i") <= last)
    counts = metrics.groupBy(*LINK).agg(F.count(F.lit(1)).alias("samples"))
    out = rows.groupBy(*LINK).agg(
        F.avg("cpu_percent").alias("avg_cpu_percent"), F.avg("memory_percent").alias("avg_memory_percent"),
        F.max(F.when(F.col("__i") == 1, F.col("memory_mb"))).alias("current_memory_mb"))
    return key_join(out, counts, LINK)


# -- alert cooldown --------------------------------------------------------------------------------

def _chain_ends(keys, gap):
    """Per chunk: where every possible first kept alert leads to. Chains only merge, so a deque of them suffices."""
    from collections import deque

    def emit(key, chains):
        import pandas as pd
        rows = [(*key, entry, at) for at, entries in chains for entry in entries]
        return pd.DataFrame(rows, columns=[*keys, "chunk", "entry", "exit"])

    def fold(batches):
        key_cols = [*keys, "chunk"]
        chains, key, opening, soon = deque(), None, True, 0
        for k, piece, new in runs(batches, key_cols):
            if new:
                if chains:
                    yield emit(key, chains)
                chains, key, opening, soon = deque(), k, True, int(piece["chunk_start"].iloc[0]) + gap
            for t in piece["t"].tolist():
                ready = []
                while chains and chains[0][0] <= t - gap:
                    ready.extend(chains.popleft()[1])
                # A chunk is entered at a candidate less than one gap after its start, or at the first one after that.
                if opening:
                    ready.append(t)
                    opening = t < soon
                if ready:
                    chains.append((t, ready))
        if chains:
            yield emit(key, chains)
    return fold


def _enter_chunks(keys, gap):
    """Follow the chunks of a key in order: the last kept alert before each of them."""
    def fold(batches):
        import pandas as pd
        last_key, kept, out, used = object(), None, [], None
        for k, piece, new in runs(batches, [*keys, "chunk"]):
            if k[:-1] != last_key:
                last_key, kept = k[:-1], None
            if new:
                out.append((*k, kept))
                used = False
            if not used:
                may = piece if kept is None else piece[piece["entry"] >= kept + gap]
                if len(may):
                    kept, used = int(may["exit"].iloc[0]), True
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[*keys, "chunk", "before"]).astype({"before": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=[*keys, "chunk", "before"]).astype({"before": "Int64"})
    return fold


def _keep(keys, gap):
    def fold(batches):
        import pandas as pd
        last = None
        for k, piece, new in runs(batches, [*keys, "chunk"]):
            if new:
                b = piece["before"].iloc[0]
                last = None if pd.isna(b) else int(b)
            kept = []
            for t in piece["t"].tolist():
                if last is None or t - last >= gap:
                    kept.append((*k, t))
                    last = t
            yield pd.DataFrame(kept, columns=[*keys, "chunk", "t"])
    return fold


def cooldown(alerts: DataFrame, seconds: float = 60.0, keys=("link_id", "type"), chunk_seconds: float | None = None,
             ts="timestamp", tie=None) -> DataFrame:
    """Keep an alert only if ``seconds`` have passed since the last *kept* one of its type.

    The rule is greedy: one decision depends on all earlier ones. Time is cut into chunks. For every alert with which a
    chunk can begin, the chunk's last kept alert is found (pass 1, chunks in parallel); walking the chunks in order then
    tells with which one each begins (pass 2, a few rows per chunk); the rule is applied inside the chunks (pass 3, in
    parallel). All passes stream over sorted Arrow batches and hold no group in memory. Of alerts of the same type and
    time the one with the smallest ``tie`` is kept; without a tie column they must differ in time.
    """
    keys = list(keys)
    gap = int(round(seconds * 1_000_000))
    span = int(round((chunk_seconds or max(3600.0, 60 * seconds)) * 1_000_000))
    tie = tie or ("seq" if "seq" in alerts.columns else None)
    chunk = F.floor(F.col("t") / span).cast("long")
    points = (alerts.withColumn("t", F.unix_micros(ts)).select(*keys, "t").distinct()
              .withColumn("chunk", chunk).withColumn("chunk_start", F.col("chunk") * span))
    key_ddl = ", ".join(f"{k} {alerts.schema[k].dataType.simpleString()}" for k in keys)
    sort = [*keys, "chunk", "t"]
    ends = (points.repartition(*keys, "chunk").sortWithinPartitions(*sort)
            .mapInPandas(_chain_ends(keys, gap), f"{key_ddl}, chunk long, entry long, exit long"))
    entries = (ends.repartition(*keys).sortWithinPartitions(*keys, "chunk", "entry")
               .mapInPandas(_enter_chunks(keys, gap), f"{key_ddl}, chunk long, before long"))
    kept = (key_join(points, entries, [*keys, "chunk"])
            .repartition(*keys, "chunk").sortWithinPartitions(*sort)
            .mapInPandas(_keep(keys, gap), f"{key_ddl}, chunk long, t long").select(*keys, "t"))
    timed = alerts.withColumn("t", F.unix_micros(ts))
    if tie is None:
        return key_join(timed, kept, [*keys, "t"], "left_semi").drop("t")
    one = timed.groupBy(*keys, "t").agg(F.min_by(F.struct(*alerts.columns), tie).alias("__a"))
    return key_join(one, kept, [*keys, "t"], "left_semi").select("__a.*")
