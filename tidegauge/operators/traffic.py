"""Packet admission and verdicts, and the counter, source and flow tables made from packets."""

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.config import CUMULATIVE, DetectionConfig
from tidegauge.functions import columns as C
from tidegauge.operators.lists import listed_at
from tidegauge.plans.spread import (
    day_bucket, key_join, numbered, position_of_rank, running, runs, settle, sized_join, time_bucket,
    with_salt,
)
from tidegauge.schemas import COUNTERS, FLOW_KEY

DEFAULT = DetectionConfig()


# -- packets ---------------------------------------------------------------------------------------

def admit(packets: DataFrame) -> DataFrame:
    """The counted packets, with ports and flags set to 0 where no complete header was seen."""
    return (packets.filter(C.admission() == "count")
            .withColumn("src_port", C.port_or_zero("src_port"))
            .withColumn("dst_port", C.port_or_zero("dst_port"))
            .withColumn("tcp_flags", C.flags_or_zero()))


def _mark_syn_excess(packets, counted, limit):
    """Adds ``syn_dropped``. A source drops every SYN after its (limit+1)-th, so one cut-off position per source decides
    and a source's packets are never put in order as a whole.

    The cut-offs (one row per source over the limit) are written first: their number then decides whether packets have
    to be shuffled to meet them.
    """
    syn = packets.filter(counted & C.is_syn())
    cut = settle(position_of_rank(syn, ["link_id", "src_ip"], ["ts", "seq"], time_bucket("ts", 60), limit + 1)
                 .withColumnsRenamed({"ts": "__cut_ts", "seq": "__cut_seq"}))
    out = sized_join(packets, cut, ["link_id", "src_ip"], ["ts", "seq"])
    later = (F.col("ts") > F.col("__cut_ts")) | ((F.col("ts") == F.col("__cut_ts")) & (F.col("seq") > F.col("__cut_seq")))
    dropped = counted & C.is_syn() & later
    return out.withColumn("syn_dropped", F.coalesce(dropped, F.lit(False))).drop("__cut_ts", "__cut_seq")


def syn_excess(packets: DataFrame, limit: int = DEFAULT.syn_limit) -> DataFrame:
    """Adds ``syn_dropped``: a SYN of a source that has already sent more than ``limit`` SYNs.

    Blacklisted packets must be gone already; dropped SYNs still count.
    """
    return _mark_syn_excess(packets, F.lit(True), limit)


def packet_verdict(packets: DataFrame, blacklist: DataFrame | None = None,
                   limit: int = DEFAULT.syn_limit) -> DataFrame:
    """Adds ``blacklisted`` and ``verdict`` ('pass' or 'drop'). Listed sources go first, then the SYN excess.

    One pass with the given list: a source that is listed because of this result is dropped from the next run on.
    """
    # Should both joins below have to shuffle, they spread a source's packets in the same way and share the shuffle.
    salted = with_salt(packets, ["ts", "seq"])
    if blacklist is None:
        marked = salted.withColumn("blacklisted", F.lit(False))
    else:
        marked = listed_at(salted, blacklist)
    out = _mark_syn_excess(marked, ~F.col("blacklisted"), limit)
    drop = F.col("blacklisted") | F.col("syn_dropped")
    return out.withColumn("verdict", F.when(drop, "drop").otherwise("pass")).drop("syn_dropped", "__salt")


def rate_limit(packets: DataFrame, per_second: int) -> DataFrame:
    """Adds ``over_limit`` for a source's packets beyond ``per_second`` within a second of the clock.

    A busy source is spread over its seconds, and a second over its hundredths.
    """
    return numbered_in_second(packets).withColumn("over_limit", F.col("__i") > per_second).drop("__i")


def numbered_in_second(packets: DataFrame) -> DataFrame:
    """Adds ``__i``, the 1-based position of a packet among its source's of that second."""
    keyed = packets.withColumn("__second", F.date_trunc("second", "ts"))
    return numbered(keyed, ["link_id", "src_ip", "__second"], ["ts", "seq"], time_bucket("ts", 0.01), "__i").drop("__second")


# -- counters --------------------------------------------------------------------------------------

def _dropped(df):
    return F.col("verdict") == "drop" if "verdict" in df.columns else F.lit(False)


def _counter_aggs(df):
    kind, dropped = C.protocol_class(), _dropped(df)
    aggs = [F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"),
            F.count_if(dropped).alias("dropped_packets"),
            F.coalesce(F.sum(F.when(dropped, F.col("bytes"))), F.lit(0)).alias("dropped_bytes"),
            F.count_if(~dropped).alias("passed_packets"),
            F.coalesce(F.sum(F.when(~dropped, F.col("bytes"))), F.lit(0)).alias("passed_bytes")]
    return aggs + [F.count_if(kind == k).alias(f"{k}_packets") for k in ("tcp", "udp", "icmp", "other")]


def tick_counters(packets: DataFrame, tick_seconds: float = 1.0) -> DataFrame:
    """The ten counters per link and tick; partial sums are made before the shuffle."""
    return (packets.groupBy("link_id", C.tick_start("ts", tick_seconds).alias("tick_start"))
            .agg(*_counter_aggs(packets)).withColumn("tick_seconds", F.lit(float(tick_seconds))))


def merge_counters(counters: DataFrame) -> DataFrame:
    """Per-CPU counters added up."""
    present = [c for c in COUNTERS if c in counters.columns]
    return counters.groupBy("link_id", "ts").agg(*[F.sum(c).alias(c) for c in present])


# -- sources and flows -----------------------------------------------------------------------------

def _tracked(df):
    return df.filter(~F.col("blacklisted")) if "blacklisted" in df.columns else df


def _source_aggs():
    return [F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"), F.max("ts").alias("last_seen"),
            F.count_if(C.is_syn()).alias("syn_count"),
            F.count_if(F.col("protocol") == C.UDP).alias("udp_count")]


def ip_stats(packets: DataFrame, tick_seconds: float | None = None, scope: str = "tick") -> DataFrame:
    """D3: per-source counts, over all time, per tick, or (``scope='cumulative'``) up to each tick it is seen in.

    Packets of listed sources are left out, SYNs dropped for excess are not.
    """
    df = _tracked(packets)
    if tick_seconds is None:
        return df.groupBy("link_id", "src_ip").agg(*_source_aggs())
    per = (df.groupBy("link_id", C.tick_start("ts", tick_seconds).alias("tick_start"), "src_ip")
           .agg(*_source_aggs()))
    return cumulate_sources(per) if scope == CUMULATIVE else per


def cumulate_sources(per_tick: DataFrame) -> DataFrame:
    """D3 in cumulative scope: each source's totals at every tick it is seen in."""
    names = ["packets", "bytes", "syn_count", "udp_count"]
    out = running(per_tick, ["link_id", "src_ip"], ["tick_start"], day_bucket("tick_start"),
                  sums={f"cum_{c}": c for c in names})
    return out.drop(*names).withColumnsRenamed({f"cum_{c}": c for c in names})


def flow_stats(packets: DataFrame, by_link: bool = True) -> DataFrame:
    """Packets, bytes, first and last time and the OR of all flags per 5-tuple."""
    keys = (["link_id"] if by_link else []) + FLOW_KEY
    return _tracked(packets).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.bit_or("tcp_flags").alias("flags"))


def flow_count(packets: DataFrame) -> DataFrame:
    """Number of distinct 5-tuples per source, counted in two levels."""
    flows = _tracked(packets).select("link_id", *FLOW_KEY).distinct()
    return flows.groupBy("link_id", "src_ip").agg(F.count(F.lit(1)).alias("flow_count"))


def unique_ips_per_minute(packets: DataFrame) -> DataFrame:
    """Distinct sources per minute, counted in two levels."""
    seen = packets.select("link_id", C.tick_start("ts", 60).alias("minute_start"), "src_ip").distinct()
    return seen.groupBy("link_id", "minute_start").agg(F.count(F.lit(1)).alias("unique_ips"))


def mean_unique_ips(packets: DataFrame) -> DataFrame:
    """D6 as the profile's single number per link, over the minutes that have packets."""
    return (unique_ips_per_minute(packets).groupBy("link_id")
            .agg(F.avg("unique_ips").alias("unique_ips_per_minute")))


def source_ticks(packets: DataFrame, tick_seconds: float) -> DataFrame:
    """Per link, tick and source: the tracked counts of D3 and, as ``all_*``, the counters and flag counts of D1.

    The one aggregation that reads packets; ticks are added up from it.
    """
    tracked = ~F.col("blacklisted") if "blacklisted" in packets.columns else F.lit(True)
    flags = [F.count_if(C.has_flag(f)).alias(f"all_{f}_packets") for f in C.FLAG_BITS]
    counters = [a.alias(f"all_{n}") for a, n in zip(_counter_aggs(packets), COUNTERS)]
    return packets.groupBy("link_id", C.tick_start("ts", tick_seconds).alias("tick_start"), "src_ip").agg(
        F.count_if(tracked).alias("packets"),
        F.coalesce(F.sum(F.when(tracked, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.max(F.when(tracked, F.col("ts"))).alias("last_seen"),
        F.count_if(tracked & C.is_syn()).alias("syn_count"),
        F.count_if(tracked & (F.col("protocol") == C.UDP)).alias("udp_count"), *counters, *flags)


# -- concentration of sources ----------------------------------------------------------------------

def source_histogram(sources: DataFrame, keys, syn_heavy: int = DEFAULT.syn_heavy, carry=()) -> DataFrame:
    """How many sources of a group have the same packet count.

    A group of T packets has fewer than sqrt(2T) distinct counts, so what follows (entropy, shares) handles a few
    thousand rows even for a group of millions of sources. ``carry`` columns are added up on the way.
    """
    return sources.groupBy(*keys, "packets").agg(
        F.count_if(F.col("packets") > 0).alias("n"), F.count_if(F.col("syn_count") > syn_heavy).alias("heavy"),
        *[F.sum(c).alias(c) for c in carry])


def concentration(sources: DataFrame, keys=("link_id", "tick_start"), k: int = DEFAULT.top_k,
                  syn_heavy: int = DEFAULT.syn_heavy, carry=()) -> DataFrame:
    """D7, D8, D9, C5 in one pass: entropy of the source shares, share of the top k sources, SYN-heavy sources."""
    keys = list(keys)
    hist = source_histogram(sources, keys, syn_heavy, carry)
    above = Window.partitionBy(*keys).orderBy(F.desc("packets")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("__above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    taken = F.least(F.col("n"), F.greatest(F.lit(k) - F.col("__above"), F.lit(0)))
    mass = F.col("n") * F.col("packets")
    total = F.col("source_packets")
    entropy = F.when(total > 0, F.greatest(F.log2(total.cast("double")) - F.col("__plogp") / total, F.lit(0.0)))
    return (ranked.groupBy(*keys).agg(
                F.sum("n").alias("sources"), F.sum(mass).alias("source_packets"),
                F.sum(mass * C.safe_log2(F.col("packets").cast("double"))).alias("__plogp"),
                F.sum(taken * F.col("packets")).alias("top_packets"), F.sum("heavy").alias("syn_heavy"),
                *[F.sum(c).alias(c) for c in carry])
            .withColumn("ip_entropy", F.coalesce(entropy, F.lit(0.0)))
            .withColumn("top_ratio", C.ratio("top_packets", "source_packets"))
            .drop("__plogp"))


def ip_entropy(sources: DataFrame, keys=("link_id", "tick_start")) -> DataFrame:
    """Entropy in bits of the sources' packet shares; groups without packets are absent (entropy 0)."""
    return concentration(sources, keys).select(*keys, "ip_entropy")


def topk_share(sources: DataFrame, k: int = 10, keys=("link_id", "tick_start")) -> DataFrame:
    """D8"""
    return concentration(sources, keys, k).select(*keys, "top_ratio")


def syn_heavy(sources: DataFrame, limit: int = DEFAULT.syn_heavy, keys=("link_id", "tick_start")) -> DataFrame:
    """D9"""
    return sources.groupBy(*keys).agg(F.count_if(F.col("syn_count") > limit).alias("syn_heavy"))


def _top_after(known, k):
    """Streaming top k of counts that only grow: whoever is outside can only get in by changing itself.

    Of equal counts the smaller address is ahead.
    """
    def update(src, n):
        if src in known or len(known) < k:
            known[src] = n
        else:
            least = min(known, key=lambda s: (known[s], -s))
            if (n, -src) > (known[least], -least):
                del known[least]
                known[src] = n
    return update


def _packets_of(known):
    return [sum(known.values())]


def _members_of(known):
    ranked = sorted(known.items(), key=lambda e: (-e[1], e[0]))
    return [[s for s, _ in ranked], [n for _, n in ranked]]


def _states_before(k):
    def fold(batches):
        import pandas as pd
        known, last = {}, object()
        for (link, chunk), piece, new in runs(batches, ["link_id", "chunk"]):
            if new:
                if link != last:
                    known, last = {}, link
                yield pd.DataFrame({"link_id": [link], "chunk": [chunk], "start_src": [list(known)],
                                    "start_n": [list(known.values())]})
            update = _top_after(known, k)
            for src, n in zip(piece["src_ip"], piece["n"]):
                update(src, n)
    return fold


def _inside(k, told, columns):
    """Per tick what ``told`` says about the top k; ``columns`` names it."""
    columns = ["link_id", "tick_us", *columns]

    def fold(batches):
        import pandas as pd
        known, tick, out = {}, None, []
        current = None
        for (link, chunk), piece, new in runs(batches, ["link_id", "chunk"]):
            if new:
                if current is not None:
                    out.append((current, tick, *told(known)))
                first = piece.iloc[0]
                known = dict(zip(first["start_src"], first["start_n"]))
                current, tick = link, None
            update = _top_after(known, k)
            for t, src, n in zip(piece["tick_us"], piece["src_ip"], piece["n"]):
                if tick is not None and t != tick:
                    out.append((link, tick, *told(known)))
                tick = t
                update(src, n)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if tick is not None:
            out.append((current, tick, *told(known)))
        yield pd.DataFrame(out, columns=columns)
    return fold


def cumulative_top(cumulated: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """D8 in cumulative scope: sum of the k largest source totals at every tick."""
    return _fold_top(cumulated, k, _packets_of, "top_packets long")


def cumulative_members(per_tick: DataFrame, k: int) -> DataFrame:
    """F3 in cumulative scope: the k sources with the most packets since the start, at every tick that adds any.

    Per (link_id, tick_start) ``top_sources`` and ``top_totals`` in falling order; sources silent in the tick are included.
    """
    cum = running(per_tick, ["link_id", "src_ip"], ["tick_start"], day_bucket("tick_start"), sums={"__n": "packets"})
    return _fold_top(cum.select("link_id", "tick_start", "src_ip", F.col("__n").alias("packets")), k, _members_of,
                     "top_sources array<long>, top_totals array<long>")


def _fold_top(cumulated, k, told, made):
    """What ``told`` says about the k largest totals after every tick.

    Totals only grow, so at a tick only its k largest *changed* sources can matter (k others are ahead of the rest, and
    stay ahead). That leaves at most k rows per tick. Days are then folded independently, each from the top k at its
    start, which follows from the k largest changed sources of the days before. The fold is greedy in time, which no
    built-in operator expresses; it streams over sorted Arrow batches and holds k sources.
    """
    names = [c.split()[0] for c in made.split(", ")]
    at_tick = Window.partitionBy("link_id", "tick_start").orderBy(F.desc("packets"), "src_ip")
    changes = (cumulated.withColumn("__i", F.row_number().over(at_tick)).filter(F.col("__i") <= k)
               .select("link_id", day_bucket("tick_start").alias("chunk"),
                       F.unix_micros("tick_start").alias("tick_us"), "src_ip", F.col("packets").alias("n")))
    in_day = Window.partitionBy("link_id", "chunk").orderBy(F.desc("n"), "src_ip")
    summaries = (changes.groupBy("link_id", "chunk", "src_ip").agg(F.max("n").alias("n"))
                 .withColumn("__i", F.row_number().over(in_day)).filter(F.col("__i") <= k).drop("__i"))
    starts = (summaries.repartition("link_id").sortWithinPartitions("link_id", "chunk", "n")
              .mapInPandas(_states_before(k),
                           "link_id string, chunk long, start_src array<long>, start_n array<long>"))
    work = key_join(changes, starts, ["link_id", "chunk"])
    return (work.repartition("link_id", "chunk").sortWithinPartitions("link_id", "chunk", "tick_us")
            .mapInPandas(_inside(k, told, names), f"link_id string, tick_us long, {made}")
            .select("link_id", F.timestamp_micros("tick_us").alias("tick_start"), *names))


def cumulative_concentration(per_tick: DataFrame, k: int = DEFAULT.top_k,
                             syn_heavy: int = DEFAULT.syn_heavy) -> DataFrame:
    """D7-D9 in cumulative scope from per-tick source rows, without a row per known source and tick.

    The sum of n*log2(n) over sources changes only by the sources seen in a tick, so per tick the changes are added up
    and then run along the ticks; the same holds for the number of sources and of SYN-heavy sources.
    """
    cum = running(per_tick, ["link_id", "src_ip"], ["tick_start"], day_bucket("tick_start"),
                  sums={"__n": "packets", "__syn": "syn_count"})
    old = F.col("__n") - F.col("packets")
    grow = (F.col("__n") * C.safe_log2(F.col("__n").cast("double"))
            - old * C.safe_log2(old.cast("double")))
    crossed = (F.col("__syn") > syn_heavy) & (F.col("__syn") - F.col("syn_count") <= syn_heavy)
    deltas = cum.groupBy("link_id", "tick_start").agg(
        F.sum("packets").alias("d_packets"), F.sum(grow).alias("d_plogp"),
        F.count_if((old == 0) & (F.col("packets") > 0)).alias("d_sources"),
        F.count_if(crossed).alias("d_heavy"))
    along = running(deltas, ["link_id"], ["tick_start"], day_bucket("tick_start"),
                    sums={"source_packets": "d_packets", "__plogp": "d_plogp", "sources": "d_sources",
                          "syn_heavy": "d_heavy"})
    total = F.col("source_packets")
    entropy = F.when(total > 0, F.greatest(C.safe_log2(total.cast("double")) - F.col("__plogp") / total, F.lit(0.0)))
    top = cumulative_top(cum.select("link_id", "tick_start", "src_ip", F.col("__n").alias("packets")), k)
    return (key_join(along, top, ["link_id", "tick_start"], "left")
            .withColumn("ip_entropy", F.coalesce(entropy, F.lit(0.0)))
            .withColumn("top_ratio", C.ratio("top_packets", "source_packets"))
            .drop("__plogp", "d_packets", "d_plogp", "d_sources", "d_heavy"))


# -- rates and shares ------------------------------------------------------------------------------

def protocol_ratios(df: DataFrame, prefix: str = "") -> DataFrame:
    """Shares of TCP, UDP and ICMP in their sum; packets of other protocols do not count."""
    tcp, udp, icmp = (F.col(f"{prefix}{p}_packets") for p in ("tcp", "udp", "icmp"))
    known = tcp + udp + icmp
    return (df.withColumn("proto_packets", known)
            .withColumn("tcp_ratio", C.ratio(tcp, known)).withColumn("udp_ratio", C.ratio(udp, known))
            .withColumn("icmp_ratio", C.ratio(icmp, known)))


def throughput(df: DataFrame, seconds="seconds", keys=()) -> DataFrame:
    """Packets per second and Mbit per second of a run, 0 for a run without duration."""
    out = df.groupBy(*keys).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
                                F.sum(seconds).alias("seconds"))
    return (out.withColumn("pps", C.ratio("packets", "seconds"))
            .withColumn("mbps", C.ratio(F.col("bytes") * 8.0, F.col("seconds")) / 1_000_000))
