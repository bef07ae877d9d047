"""Tables of bounded size over packets: the least recently used entry makes room for a new one.

A table of ``capacity`` entries is cut into shards by a hash of the key, each with its share of the capacity, so the work
of one link is spread and a shard's entries fit into one state value. The batch and the streaming form share the rule.
"""

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Entries of the flow table and of the source table.
FLOW_ENTRIES, SOURCE_ENTRIES = 65_536, 131_072
_ENTRY = ["entry", "first_us", "last_us", "packets", "bytes"]
ENDED = StructType([StructField("link_id", StringType()), StructField("entry", StringType())]
                   + [StructField(n, LongType()) for n in ("first_us", "last_us", "packets", "bytes")]
                   + [StructField("ended", StringType())])


class LruTable:
    """Entries in order of their last use. An entry that was idle for ``idle`` microseconds starts anew as well."""

    def __init__(self, capacity, idle, entries=()):
        self.capacity, self.idle = capacity, idle
        self.entries = OrderedDict((e[0], list(e[1:])) for e in entries)

    def add(self, key, ts, size):
        """Counts a packet; gives the entry that ended because of it, if any, with the reason."""
        gone, e = None, self.entries.get(key)
        if e is not None and ts - e[1] < self.idle:
            e[1], e[2], e[3] = ts, e[2] + 1, e[3] + size
            self.entries.move_to_end(key)
            return None
        if e is not None:
            gone = (key, *self.entries.pop(key), "idle")
        elif len(self.entries) >= self.capacity:
            old, e = self.entries.popitem(last=False)
            gone = (old, *e, "idle" if ts - e[1] >= self.idle else "evicted")
        self.entries[key] = [ts, ts, 1, size]
        return gone

    def expire(self, now):
        """Entries that have been idle by ``now``; the least recently used come first."""
        while self.entries:
            key, e = next(iter(self.entries.items()))
            if now - e[1] < self.idle:
                return
            del self.entries[key]
            yield (key, *e, "idle")

    def rows(self):
        return [(k, *e) for k, e in self.entries.items()]

    def oldest(self):
        return next(iter(self.entries.values()))[1] if self.entries else None


def _keyed(packets, keys, shards):
    """(link_id, shard, entry, t, seq, bytes): the key as text, and the shard its hash falls into."""
    entry = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    number = F.conv(F.substring(F.md5(entry), 1, 8), 16, 10).cast("long")
    return packets.select("link_id", F.pmod(number, F.lit(shards)).cast("int").alias("shard"),
                          entry.alias("entry"), F.unix_micros("ts").alias("t"), "seq", "bytes",
                          *([F.col("ts")] if packets.isStreaming else []))


def bounded_table(packets: DataFrame, keys, capacity: int = FLOW_ENTRIES, idle_seconds: float = 60.0, shards: int = 64) -> DataFrame:
    """K9: every entry that a table of ``capacity`` entries held, with its first and last packet and its counts.

    ``ended`` is evicted, idle or null for entries still in the table. A key that comes back after its entry ended starts
    anew. Each shard is read in time order as a stream of batches; a task holds one shard's entries.
    """
    share, idle = max(capacity // shards, 1), int(round(idle_seconds * 1_000_000))
    arrow = pa.schema([("link_id", pa.string()), ("entry", pa.string())] + [(n, pa.int64()) for n in _ENTRY[1:]] + [("ended", pa.string())])

    def batch_of(link, rows):
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, (link, *r))) for r in rows], schema=arrow)

    def run(batches):
        table, at = None, None
        for batch in batches:
            out = []
            for link, shard, entry, t, _, size in zip(*[c.to_pylist() for c in batch.columns]):
                if (link, shard) != at:
                    if table is not None:
                        out += [(at[0], *r, None) for r in table.rows()]
                    table, at = LruTable(share, idle), (link, shard)
                gone = table.add(entry, t, size)
                if gone:
                    out.append((link, *gone))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)
        if table is not None:
            yield batch_of(at[0], [(*r, None) for r in table.rows()])

    rows = _keyed(packets, keys, shards)
    return (rows.repartition("link_id", "shard").sortWithinPartitions("link_id", "shard", "t", "seq")
            .mapInArrow(run, ENDED))


class _Shard(StatefulProcessor):
    """K9: the entries of one shard, and an event-time timer at which the oldest of them will have been idle."""

    def __init__(self, capacity, idle):
        self.capacity, self.idle = capacity, idle

    def init(self, handle):
        entry = StructType([StructField("entry", StringType())] + [StructField(n, LongType()) for n in _ENTRY[1:]])
        self.handle = handle
        self.table = handle.getValueState("table", StructType([StructField("entries", ArrayType(entry))]))

    def _load(self):
        held = self.table.get()[0] if self.table.exists() else []
        return LruTable(self.capacity, self.idle, [tuple(e) for e in held])

    def _save(self, table):
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.table.update(([*map(tuple, table.rows())],))
        if table.entries:
            # Timers count milliseconds; the first whole one after the last is idle.
            self.handle.registerTimer(-(-(table.oldest() + self.idle) // 1000))

    def _out(self, key, gone):
        return pd.DataFrame([(key[0], *g) for g in gone], columns=ENDED.names)

    def handleInputRows(self, key, rows, timerValues):
        frames = [r for r in rows if not r.empty]
        if not frames:
            return
        packets, table = pd.concat(frames).sort_values(["t", "seq"], kind="stable"), self._load()
        gone = [g for e, t, n in zip(packets["entry"], packets["t"].tolist(), packets["bytes"].tolist()) if (g := table.add(e, t, n))]
        self._save(table)
        yield self._out(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        table = self._load()
        gone = list(table.expire(timerValues.getCurrentWatermarkInMs() * 1000))
        self._save(table)
        yield self._out(key, gone)

    def close(self):
        pass


def stream_bounded_table(packets: DataFrame, keys, delay: str, capacity: int = FLOW_ENTRIES, idle_seconds: float = 60.0,
                         shards: int = 64) -> DataFrame:
    """K9: the entries of a bounded table as they end, evicted or idle; state is bounded by ``capacity`` per link.

    Packets of a batch are taken in time order. An entry that no packet touches ends when the watermark has passed its
    idle time.
    """
    rows = _keyed(packets.withWatermark("ts", delay), keys, shards)
    return rows.groupBy("link_id", "shard").transformWithStateInPandas(
        _Shard(max(capacity // shards, 1), int(round(idle_seconds * 1_000_000))), ENDED, "append", "EventTime")


class _Totals(StatefulProcessor):
    """K2: running totals of the sources of a shard; a source starts anew after a silence, and a timer then clears it.

    A batch's rows of all sources of a shard are added up at once, and their totals lie in one state value.
    """

    def __init__(self, idle):
        self.idle = idle

    def init(self, handle):
        self.handle = handle
        held = StructType([StructField("src_ip", LongType()), *[StructField(n, LongType()) for n in _TOTALS]])
        self.totals = handle.getValueState("totals", StructType([StructField("sources", ArrayType(held))]))

    def _load(self):
        held = self.totals.get()
        return {e[0]: tuple(e[1:]) for e in held[0]} if held else {}

    def _save(self, held):
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.totals.update(([(s, *e) for s, e in held.items()],))
            self.handle.registerTimer(-(-(min(e[1] for e in held.values()) + self.idle) // 1000))
        else:
            self.totals.clear()

    def handleInputRows(self, key, rows, timerValues):
        frames = [r for r in rows if not r.empty]
        if not frames:
            return
        new = pd.concat(frames).sort_values(["no_source", "src_ip", "t"], kind="stable")
        none, source, t = (new[c].to_numpy() for c in ("no_source", "src_ip", "t"))
        other = np.append(True, (source[1:] != source[:-1]) | (none[1:] != none[:-1]))
        begins = np.flatnonzero(other)
        ends = np.append(begins[1:], len(t))
        starts = np.flatnonzero(other | np.append(True, t[1:] - t[:-1] >= self.idle))
        since = starts[np.searchsorted(starts, ends) - 1]
        sums = [np.append(0, np.cumsum(new[c].to_numpy())) for c in _TOTALS[2:]]
        made = np.column_stack([t[since], t[ends - 1], *[c[ends] - c[since] for c in sums]]).tolist()
        held, out = self._load(), []
        for i, at, e in zip(begins.tolist(), since.tolist(), made):
            src = None if none[i] else int(source[i])
            old = held.get(src)
            if at == i and old is not None and t[i] - old[1] < self.idle:
                e = [old[0], e[1], *(a + b for a, b in zip(old[2:], e[2:]))]
            held[src] = tuple(e)
            out.append((key[0], src, *e))
        self._save(held)
        yield pd.DataFrame(out, columns=TOTALS.names).astype({"src_ip": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self._save({s: e for s, e in self._load().items() if -(-(e[1] + self.idle) // 1000) > now})
        yield pd.DataFrame([], columns=TOTALS.names)

    def close(self):
        pass


_TOTALS = ["first_us", "last_us", "packets", "bytes", "syn_count", "udp_count"]
TOTALS = StructType([StructField("link_id", StringType()), StructField("src_ip", LongType())]
                    + [StructField(n, LongType()) for n in _TOTALS])


def stream_totals(packets: DataFrame, delay: str, idle_seconds: float, shards: int = 256) -> DataFrame:
    """K2: totals of every source that a batch touches, since its first packet or its last silence of ``idle_seconds``.

    State of a source ends when the watermark has passed its silence, so it is bounded by the sources of that time. The
    sources of a link are dealt to ``shards`` state values by a hash.
    """
    from tidegauge.functions import columns as C
    source = F.col("src_ip").cast("long")

    def number(c):
        return F.coalesce(c.cast("long"), F.lit(0)).cast("long")
    rows = packets.withWatermark("ts", delay).select(
        "link_id", F.pmod(F.xxhash64(source), F.lit(shards)).cast("int").alias("shard"), source.isNull().alias("no_source"),
        number(source).alias("src_ip"), "ts", F.unix_micros("ts").alias("t"), F.lit(1).cast("long").alias("packets"),
        number(F.col("bytes")).alias("bytes"), number(C.is_syn()).alias("syn_count"), number(F.col("protocol") == C.UDP).alias("udp_count"))
    return rows.groupBy("link_id", "shard").transformWithStateInPandas(
        _Totals(int(round(idle_seconds * 1_000_000))), TOTALS, "update", "EventTime")
