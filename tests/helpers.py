"""Small packet and tick tables."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
PACKET_DDL = ("link_id string, ts timestamp, seq long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, "
              "tcp_flags int, bytes long, ethertype int, l3_ok boolean, l4_ok boolean")


def at(seconds):
    return START + timedelta(seconds=seconds)


def packets(spark, rows):
    """rows: dicts with any of t (seconds), src, dst, proto, flags, size, link, l3_ok, l4_ok, ethertype, ports."""
    made = [(r.get("link", "a"), at(r.get("t", i)), r.get("seq", i), r.get("src", 1), r.get("dst", 2),
             r.get("sport", 1000), r.get("dport", 80), r.get("proto", 6), r.get("flags", 0), r.get("size", 100),
             r.get("ethertype", 0x0800), r.get("l3_ok", True), r.get("l4_ok", True)) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, PACKET_DDL)


def ticks(spark, counts, link="a", seconds=1.0):
    """counts: (packets, tcp, udp, icmp) per consecutive tick; no sources known."""
    made = [(link, at(i * seconds), seconds, p, p * 100, t, u, c) for i, (p, t, u, c) in enumerate(counts)]
    df = spark.createDataFrame(made, "link_id string, tick_start timestamp, tick_seconds double, packets long, "
                                     "bytes long, tcp_packets long, udp_packets long, icmp_packets long")
    return (df.withColumn("sources", F.lit(0)).withColumn("ip_entropy", F.lit(0.0))
            .withColumn("top_ratio", F.lit(0.0)).withColumn("syn_heavy", F.lit(0)))


def sources(spark, counts, ddl="link_id string, tick_start timestamp, src_ip long, packets long, syn_count long"):
    return spark.createDataFrame([("a", START, i, n, 0) for i, n in enumerate(counts)], ddl)
