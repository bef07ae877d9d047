"""Tables of bounded size and late packets, batch and stream, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import packets
from tidegauge.operators import traffic
from tidegauge.streaming import bounded, jobs


def data(n=400, sources=30, seed=5):
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.1, 0.5, 3.0]) + (40.0 if i % 97 == 0 else 0.0)
        out.append({"t": t, "src": rng.randrange(sources) if rng.random() < 0.7 else rng.randrange(4), "seq": i, "size": rng.randrange(60, 900),
                    "link": rng.choice("ab"), "flags": rng.choice([0, 2]), "proto": rng.choice([6, 17])})
    return out


def brute(rows, capacity, idle):
    """Entries of one table per link; ``ended`` is None for those still in it."""
    out, tables = [], {}
    for r in rows:
        table = tables.setdefault(r["link"], [])
        held = next((e for e in table if e[0] == r["src"]), None)
        if held and r["t"] - held[2] >= idle:
            out.append((r["link"], *held, "idle"))
            table.remove(held)
            held = None
        if held:
            table.remove(held)
            table.append((r["src"], held[1], r["t"], held[3] + 1, held[4] + r["size"]))
            continue
        if len(table) == capacity:
            e = table.pop(0)
            out.append((r["link"], *e, "idle" if r["t"] - e[2] >= idle else "evicted"))
        table.append((r["src"], r["t"], r["t"], 1, r["size"]))
    return out + [(link, *e, None) for link, table in tables.items() for e in table]


def plain(rows):
    return sorted((r.link_id, int(r.entry), r.packets, r.bytes, r.ended or "", r.last_us - r.first_us) for r in rows)


def wanted(rows):
    return sorted((link, s, n, b, e or "", round((last - first) * 1e6)) for link, s, first, last, n, b, e in rows)


@pytest.mark.parametrize("capacity,idle", [(5, 20.0), (12, 35.0), (100, 10.0)])
def test_bounded_table(spark, capacity, idle):
    rows = data()
    df = bounded.bounded_table(packets(spark, rows).repartition(3), ["src_ip"], capacity, idle, shards=1)
    got, want = plain(df.collect()), wanted(brute(rows, capacity, idle))
    # Times are rounded to microseconds on the way in.
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[5] - w[5]) <= 2 for g, w in zip(got, want))


def test_shards_keep_their_share(spark):
    df = bounded.bounded_table(packets(spark, data(900, 300)), ["src_ip", "dst_ip"], 64, 1e6, shards=8)
    live = df.filter("ended is null").groupBy("link_id").count().collect()
    assert live and all(r["count"] <= 64 for r in live) and df.agg(F.sum("packets")).first()[0] == 900


def _stream(spark, rows, folder, batches):
    df = packets(spark, rows)
    edge = rows[-1]["t"] / batches
    at = F.least(F.floor((F.unix_micros("ts") - 1704067200000000) / 1e6 / edge), F.lit(batches - 1))
    return jobs.replay(df, f"{folder}/in", [at == k for k in range(batches)])


def test_stream_ends_the_same_entries(spark, tmp_path):
    rows = data() + [{"t": 5000.0, "src": 99, "seq": 999, "link": "a", "size": 1}]
    out = bounded.stream_bounded_table(_stream(spark, rows, tmp_path, 4), ["src_ip"], "0 seconds", 5, 20.0, shards=1)
    q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = plain(spark.read.parquet(f"{tmp_path}/out").collect())
    # The last packet's time is past every idle time, so all entries but its own have ended.
    want = wanted([(*e[:-1], e[-1] or "idle") for e in brute(rows, 5, 20.0) if e[1] != 99])
    assert [g[:5] for g in got] == [w[:5] for w in want]


def test_totals_begin_anew_after_a_silence(spark, tmp_path):
    rows = [{"t": t, "src": s, "seq": i, "size": 10, "flags": 2} for i, (t, s) in enumerate(
        [(0, 1), (1, 2), (5, 1), (30, 1), (31, 2), (33, 2), (90, 3)])]
    out = bounded.stream_totals(_stream(spark, rows, tmp_path, 3), "0 seconds", 20.0)
    jobs.totals_sink(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.src_ip: (r.packets, r.bytes, r.syn_count) for r in jobs.read_totals(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (1, 10, 1), 2: (2, 20, 2), 3: (1, 10, 1)}


def test_late_packets_over_many_batches(spark, tmp_path):
    """More triggers than Spark keeps reports of. Every seventh packet comes three batches late."""
    rng, batches = random.Random(1), 105
    rows = [{"t": k * 10 + rng.random() * 9, "src": i % 5, "seq": 10 * k + i, "batch": k + (3 if (10 * k + i) % 7 == 0 else 0)}
            for k in range(batches) for i in range(4)]
    df = packets(spark, rows).join(spark.createDataFrame([(r["seq"], r["batch"]) for r in rows], "seq long, arrival long"), "seq").cache()
    stream = jobs.replay(df, f"{tmp_path}/in", [F.col("arrival") == k for k in range(batches + 3)])
    q = jobs.late_packets(traffic.admit(stream), f"{tmp_path}/late", f"{tmp_path}/state", f"{tmp_path}/cp", 5.0, 4.0)
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 100
    want, reached = set(), None
    for b in range(batches + 3):
        here = [r for r in rows if r["batch"] == b]
        if reached is not None:
            want |= {r["seq"] for r in here if (r["t"] // 5 + 1) * 5 <= reached - 4}
        reached = max([int(r["t"] * 1000) / 1000 for r in here] + [reached or 0])
    late = spark.read.parquet(f"{tmp_path}/late")
    assert len(want) > 50 and sorted(r.seq for r in late.collect()) == sorted(want)


def test_totals_of_many_sources_lie_in_few_state_values(spark, tmp_path):
    rows, idle = data(), 20.0
    out = bounded.stream_totals(_stream(spark, rows, tmp_path, 4), "0 seconds", idle, shards=3)
    jobs.totals_sink(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = {}
    for r in sorted(rows, key=lambda r: r["t"]):
        key = r["link"], r["src"]
        old = want.get(key)
        if old is None or r["t"] - old[1] >= idle:
            old = r["t"], r["t"], 0, 0, 0, 0
        syn, udp = r["proto"] == 6 and r["flags"] == 2, r["proto"] == 17
        want[key] = old[0], r["t"], old[2] + 1, old[3] + r["size"], old[4] + syn, old[5] + udp
    got = {(r.link_id, r.src_ip): r[2:] for r in jobs.read_totals(spark, f"{tmp_path}/out").select(*bounded.TOTALS.names).collect()}
    assert {k: v[2:] for k, v in got.items()} == {k: v[2:] for k, v in want.items()}
    base = min(v[0] for v in got.values()) - round(min(v[0] for v in want.values()) * 1e6)
    assert all(abs(got[k][i] - base - v[i] * 1e6) < 2 for k, v in want.items() for i in (0, 1))
    assert spark.read.format("statestore").option("stateVarName", "totals").load(f"{tmp_path}/cp").count() <= 2 * 3
