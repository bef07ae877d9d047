import math
import random
from collections import Counter, defaultdict

import pytest

from helpers import at, packets, sources
from tidegauge.operators import lists, ranking, traffic


def test_entropy_cases(spark):
    def entropy(counts):
        rows = traffic.ip_entropy(sources(spark, counts)).collect()
        return rows[0].ip_entropy if rows else 0
    assert entropy([10000, 9000, 8000]) == pytest.approx(1.579013, abs=1e-6)
    assert entropy([100] * 100) == pytest.approx(math.log2(100))
    assert entropy([]) == 0 and entropy([0, 0]) == 0 and entropy([7]) == 0


def test_concentration_against_brute_force(spark):
    rng = random.Random(1)
    for n in (1, 5, 37, 400):
        counts = [int(rng.paretovariate(0.7)) % 5000 + 1 for _ in range(n)]
        row = traffic.concentration(sources(spark, counts)).first()
        total = sum(counts)
        assert row.sources == n and row.source_packets == total
        assert row.top_ratio == pytest.approx(sum(sorted(counts)[-10:]) / total)
        assert row.ip_entropy == pytest.approx(-sum(c / total * math.log2(c / total) for c in counts), abs=1e-9)
        assert row.ip_entropy <= math.log2(n) + 1e-9


def test_syn_excess_starts_after_one_more_than_the_limit(spark):
    rows = [{"t": i // 100, "flags": 2} for i in range(1005)]
    out = traffic.syn_excess(packets(spark, rows), 1000).orderBy("seq").collect()
    assert [r.seq for r in out if r.syn_dropped] == [1001, 1002, 1003, 1004]
    assert traffic.ip_stats(packets(spark, rows)).first().syn_count == 1005


def test_syn_excess_with_one_hot_source(spark):
    rng = random.Random(2)
    rows = [{"t": rng.randrange(2000), "src": 1 if rng.random() < 0.9 else rng.randrange(2, 20),
             "flags": rng.choice([0, 2, 18])} for _ in range(3000)]
    seen, want = Counter(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["t"], i)):
        r = rows[i]
        syn = bool(r["flags"] & 2)
        want[i] = syn and seen[r["src"]] > 7
        seen[r["src"]] += syn
    out = {r.seq: r.syn_dropped for r in traffic.syn_excess(packets(spark, rows), 7).collect()}
    assert out == want


def test_blacklisted_packets_are_counted_as_dropped_but_not_tracked(spark):
    df = packets(spark, [{"src": 9}] * 3 + [{"src": 1}])
    bl = spark.createDataFrame([("a", 9, at(-1), None)], "link_id string, src_ip long, added_at timestamp, removed_at timestamp")
    seen = traffic.packet_verdict(traffic.admit(df), bl)
    counts = traffic.tick_counters(seen, 60).first()
    assert (counts.packets, counts.dropped_packets, counts.passed_packets) == (4, 3, 1)
    assert [r.src_ip for r in traffic.ip_stats(seen).collect()] == [1]
    assert lists.apply_blacklist(df, bl).count() == 1 and lists.blacklisted_packets(df, bl).count() == 3


def test_blacklist_in_time(spark):
    bl = spark.createDataFrame([("a", 1, at(10), at(20)), ("a", 1, at(40), None)],
                               "link_id string, src_ip long, added_at timestamp, removed_at timestamp")
    df = packets(spark, [{"t": t} for t in (9, 10, 19, 20, 40)])
    assert [r.seq for r in lists.apply_blacklist_asof(df, bl).orderBy("seq").collect()] == [0, 3]
    assert lists.listed_at(df, bl).count() == 5


def test_sources_without_address_are_kept(spark):
    df = packets(spark, [{"src": None}, {"src": 1}])
    bl = spark.createDataFrame([("a", 1, at(0), None)], "link_id string, src_ip long, added_at timestamp, removed_at timestamp")
    assert traffic.packet_verdict(df, bl).count() == 2


def test_admission_and_truncated_headers(spark):
    df = packets(spark, [{"l3_ok": False}, {"ethertype": 0x86DD}, {"l4_ok": False, "flags": 2}, {"proto": 1}, {}])
    kept = traffic.admit(df).orderBy("seq").collect()
    assert [(r.seq, r.src_port, r.tcp_flags) for r in kept] == [(2, 0, 0), (3, 0, 0), (4, 1000, 0)]


def test_flow_flags_are_ored(spark):
    row = traffic.flow_stats(packets(spark, [{"flags": 2}, {"flags": 16}, {"flags": 1}])).first()
    assert (row.packets, row.flags) == (3, 19)


def test_counters_per_cpu_are_added(spark):
    df = spark.createDataFrame([("a", 0, at(0), 5, 50), ("a", 1, at(0), 7, 70)],
                               "link_id string, cpu int, ts timestamp, packets long, bytes long")
    assert traffic.merge_counters(df).first().packets == 12


def test_cumulative_shares_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for tick in range(60):
        for src in rng.sample(range(40), rng.randrange(1, 12)):
            rows.append(("a", at(tick * 7200), src, int(rng.paretovariate(0.8)) % 500 + 1, rng.randrange(4)))
    df = spark.createDataFrame(rows, "link_id string, tick_start timestamp, src_ip long, packets long, syn_count long")
    got = {r.tick_start.timestamp(): r for r in traffic.cumulative_concentration(df, 10, 6).collect()}
    per = defaultdict(list)
    for r in rows:
        per[r[1].timestamp()].append(r)
    count, syn = Counter(), Counter()
    for t in sorted(per):
        for r in per[t]:
            count[r[2]] += r[3]
            syn[r[2]] += r[4]
        total, g = sum(count.values()), got[t]
        assert g.sources == len(count) and g.syn_heavy == sum(v > 6 for v in syn.values())
        assert g.top_ratio == pytest.approx(sum(v for _, v in count.most_common(10)) / total)
        assert g.ip_entropy == pytest.approx(-sum(v / total * math.log2(v / total) for v in count.values()), abs=1e-9)


def test_rate_limit_per_second(spark):
    df = packets(spark, [{"t": 0.1 * i} for i in range(25)])
    assert traffic.rate_limit(df, 6).filter("over_limit").count() == 4 + 4 + 0


def test_signatures(spark):
    sigs = spark.createDataFrame([(1, 1, 7, True), (2, 2, 53, True), (3, 3, 1, True), (4, 3, 6, False)],
                                 "sig_id int, signature_type int, match_value long, enabled boolean")
    df = packets(spark, [{"src": 7, "dport": 53}, {"src": 7}, {"proto": 1}, {"dport": 53, "size": 5}])
    got = {r.sig_id: (r.blocked_packets, r.blocked_bytes) for r in lists.match_signatures(df, sigs).collect()}
    assert got == {1: (2, 200), 2: (2, 105), 3: (1, 100)}


def test_block_list_changes(spark):
    bl = spark.createDataFrame([("a", 1, at(0), at(5)), ("a", 2, at(0), None)],
                               "link_id string, src_ip long, added_at timestamp, removed_at timestamp")
    again = spark.createDataFrame([("a", 1, at(9))], "link_id string, src_ip long, added_at timestamp")
    added = lists.blacklist_add(bl, again)
    assert {r.src_ip for r in lists.blacklist_active(added, "2024-01-01 00:01:00").collect()} == {1, 2}
    gone = spark.createDataFrame([("a", 2, at(30))], "link_id string, src_ip long, removed_at timestamp")
    assert {r.src_ip for r in lists.blacklist_active(lists.blacklist_remove(added, gone), "2024-01-01 00:01:00").collect()} == {1}


def test_top_lists_and_candidates(spark):
    df = spark.createDataFrame([("a", at(0), i, n) for i, n in enumerate([5, 50, 20_000, 30_000, 1, 11_000, 12_000, 40_000, 15_000])],
                               "link_id string, tick_start timestamp, src_ip long, packets long")
    assert [r.src_ip for r in ranking.top_sources(df, 3).orderBy("rank").collect()] == [7, 3, 2]
    assert [r.src_ip for r in ranking.top_sources(df, 3, per_link=False).collect()] == [7, 3, 2]
    alerts = spark.createDataFrame([("a", at(0))], "link_id string, timestamp timestamp")
    found = ranking.block_candidates(df, alerts, 5, 10_000)
    assert [r.src_ip for r in found.orderBy("rank").collect()] == [7, 3, 2, 8, 6]
    assert ranking.block_candidates(df, alerts.filter("false")).count() == 0


def test_throughput(spark):
    df = spark.createDataFrame([(100, 1_000_000, 2.0), (0, 0, 0.0)], "packets long, bytes long, seconds double")
    row = traffic.throughput(df).first()
    assert (row.pps, row.mbps) == (50, 4)
    assert traffic.throughput(df.filter("seconds = 0")).first().pps == 0
