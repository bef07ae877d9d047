import random

import pytest
from pyspark.sql import functions as F

from helpers import at, ticks
from tidegauge.operators import ordered, traffic
from tidegauge.plans import spread


def test_running_and_previous_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), t, rng.randrange(100)) for t in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    bucket = F.floor(F.col("t") / 97).cast("long")
    out = spread.running(df, ["k"], ["t"], bucket, sums={"s": "v"}, maxs={"hi": "v"}, mins={"lo": "v"}, rank="n", total="all")
    out = spread.previous(out, ["k"], ["t"], bucket, ["v"])
    got = {r.t: r for r in out.collect()}
    assert len(got) == len(rows)
    for k in ("x", "y", None):
        mine, seen = sorted((t, v) for q, t, v in rows if q == k), []
        for t, v in mine:
            before, seen = (seen[-1] if seen else None), seen + [v]
            r = got[t]
            assert (r.s, r.hi, r.lo, r.n, r.all, r.prev_v) == (sum(seen), max(seen), min(seen), len(seen), len(mine), before)


def test_position_of_rank(spark):
    df = spark.createDataFrame([("x", t) for t in range(100)] + [("y", 5)], "k string, t long")
    out = spread.position_of_rank(df, ["k"], ["t"], F.floor(F.col("t") / 7).cast("long"), 42).collect()
    assert [(r.k, r.t) for r in out] == [("x", 41)]


def alerts(spark, rows):
    return spark.createDataFrame([("a", kind, at(t), i) for i, (kind, t) in enumerate(rows)],
                                 "link_id string, type string, timestamp timestamp, seq long")


def kept(df):
    return sorted((r.type, r.seq) for r in df.collect())


def test_cooldown_cases(spark):
    df = alerts(spark, [("x", t) for t in (0, 10, 59, 60, 61, 119, 120, 200)] + [("y", 1)])
    assert kept(ordered.cooldown(df, 60)) == [("x", 0), ("x", 3), ("x", 6), ("x", 7), ("y", 8)]


@pytest.mark.parametrize("chunk", [60, 100, 1000, 100_000])
def test_cooldown_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("xy"), rng.choice([rng.randrange(3000), rng.randrange(900, 1100), 5 * rng.randrange(600)]))
            for _ in range(500)]
    want, last = [], {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][1], i)):
        kind, t = rows[i]
        if kind not in last or t - last[kind] >= 60:
            want.append((kind, i))
            last[kind] = t
    assert kept(ordered.cooldown(alerts(spark, rows), 60, chunk_seconds=chunk)) == sorted(want)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_ema_does_not_depend_on_chunks(spark, chunk):
    df = ticks(spark, [(n, n, 0, 0) for n in [20, 5, 40] + [random.Random(5).randrange(1000) for _ in range(60)]])
    df = df.withColumn("pps", F.col("packets").cast("double"))
    seeds = spark.createDataFrame([("a", 10.0)], "link_id string, seed_pps double")
    got = [r.ema_pps for r in ordered.ema(df, ["pps"], seeds, chunk=chunk).orderBy("tick_start").collect()]
    y, want = 10.0, []
    for r in df.orderBy("tick_start").collect():
        y = 0.95 * y + 0.05 * r.packets
        want.append(y)
    assert got == pytest.approx(want, rel=1e-9)
    assert got[:3] == pytest.approx([10.5, 10.225, 11.71375])


def rates(spark, counts):
    df = ticks(spark, [(n, n, 0, 0) for n in counts])
    return ordered.tick_rates(traffic.protocol_ratios(df))


def test_baseline_needs_ten_samples(spark):
    got = ordered.baseline(rates(spark, range(1, 13))).orderBy("tick_start").collect()
    assert [r.history for r in got] == list(range(12))
    assert got[9].samples is None and got[10].samples == 10 and got[11].samples == 11
    assert got[10].mean_pps == pytest.approx(5.5)


@pytest.mark.parametrize("chunk", [300, 512, 8192])
def test_baseline_frame_holds_300(spark, chunk):
    got = ordered.baseline(rates(spark, range(1, 303)), chunk=chunk).orderBy("tick_start").collect()
    assert len(got) == 302 and got[301].samples == 300
    assert got[301].mean_pps == pytest.approx(sum(range(2, 302)) / 300)
    assert got[301].prev_pps == 301


def test_change_rate(spark):
    got = ordered.baseline(rates(spark, [0, 5, 20])).orderBy("tick_start").collect()
    assert [r.change_rate for r in got] == [None, None, 4.0]


def test_inter_arrival_in_milliseconds(spark):
    df = spark.createDataFrame([("a", at(t)) for t in (0, 1.0, 3.5)], "link_id string, tick_start timestamp")
    assert [r.iat_ms for r in ordered.inter_arrival(df).orderBy("tick_start").collect()] == [None, 1000, 2500]


def test_counter_rates(spark):
    df = spark.createDataFrame([("a", at(0), 10, 100), ("a", at(2), 30, 500), ("a", at(2), 30, 500)],
                               "link_id string, ts timestamp, packets long, bytes long")
    got = ordered.counter_rates(df).orderBy("ts").collect()
    assert [(r.pps, r.bps) for r in got] == [(None, None), (10, 200)]
    first = ordered.counter_rates(df, "2023-12-31 23:59:55").orderBy("ts").first()
    assert first.pps == 2


def test_profile(spark):
    df = ticks(spark, [(10, 10, 0, 0), (20, 20, 0, 0), (60, 80, 15, 5), (1000, 1, 0, 0), (30, 30, 0, 0)], seconds=1.0)
    df = df.withColumn("tick_start", F.col("tick_start") + F.expr("make_interval(0,0,0,0,0,0,0)"))
    r = ordered.tick_rates(traffic.protocol_ratios(df))
    profile = ordered.learn_profile(r, 3.0)
    p = profile.first()
    assert (p.avg_pps, p.peak_pps, p.learning_samples) == (30, 60, 3)
    assert (p.tcp_ratio, p.udp_ratio, p.icmp_ratio) == (0.8, 0.15, 0.05)
    # The tick that ends the learning period is used for neither.
    got = ordered.adapt_profile(r, profile, 3.0).collect()
    assert [(g.pps, round(g.avg_pps, 9), g.peak_pps) for g in got] == [(30, 30, 60)]
    both = ordered.adapt_profile(r, profile, 3.0, keep_boundary=True).orderBy("tick_start").collect()
    assert both[0].avg_pps == pytest.approx(0.95 * 30 + 50) and both[1].peak_pps == 1000
    assert ordered.learn_profile(r, 3.0, "2024-01-01 00:00:03").first().avg_pps == 515


def test_host_summary(spark):
    df = spark.createDataFrame([("a", at(i), i, float(i), 1.0, float(i)) for i in range(1200)],
                               "link_id string, ts timestamp, seq long, cpu_percent double, memory_percent double, memory_mb double")
    row = ordered.host_summary(df).first()
    assert (row.avg_cpu_percent, row.current_memory_mb, row.samples) == (1169.5, 1199, 1200)
