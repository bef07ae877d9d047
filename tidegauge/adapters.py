"""The driver's tables, read as the canonical tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Timestamps in the files carry no zone; all of the engine works in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _link():
    return F.concat(F.lit("link"), (F.col("user_id") % 2).cast("string")).alias("link_id")


def _ts():
    return F.col("ts").cast("timestamp").alias("ts")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def packets(spark, sf_dir) -> DataFrame:
    return packets_of(read(spark, sf_dir, "events"))


def packets_of(events: DataFrame) -> DataFrame:
    """Two links; sources are users; ports, flags and header checks follow from ids."""
    kind = F.col("event_type")
    number = (F.when(kind.isin("click", "view"), 6).when(kind == "purchase", 17)
              .when(kind == "signup", 1).otherwise(47))
    return events.select(
        _link(), _ts(), F.col("event_id").alias("seq"), F.col("user_id").alias("src_ip"),
        (F.get_json_object("props", "$.k").cast("long") % 8).alias("dst_ip"),
        (1024 + F.col("event_id") % 60000).cast("int").alias("src_port"),
        F.when(kind.isin("click", "view"), 443).when(kind == "purchase", 53).otherwise(0).alias("dst_port"),
        number.alias("protocol"),
        F.when(kind.isin("click", "view"), (F.col("event_id") % 64).cast("int")).otherwise(0).alias("tcp_flags"),
        (64 + F.floor(F.col("value") * 10)).cast("long").alias("bytes"),
        F.when(F.col("event_id") % 50 == 0, 34525).otherwise(2048).alias("ethertype"),
        (F.col("event_id") % 97 != 0).alias("l3_ok"), (F.col("event_id") % 89 != 0).alias("l4_ok"))


def blacklist(spark, sf_dir) -> DataFrame:
    """Every tenth source, half of them released again."""
    return (read(spark, sf_dir, "events").filter(F.col("user_id") % 10 == 0)
            .select(_link(), F.col("user_id").alias("src_ip")).distinct()
            .withColumn("added_at", F.to_timestamp(F.lit("2024-01-10 00:00:00")))
            .withColumn("removed_at", F.when(F.col("src_ip") % 20 == 0,
                                             F.to_timestamp(F.lit("2024-01-20 00:00:00")))))


def signatures(spark) -> DataFrame:
    """1 = source, 2 = destination port, 3 = protocol."""
    return spark.createDataFrame([(1, 1, 7), (2, 2, 53), (3, 3, 1)],
                                 "sig_id int, signature_type int, match_value long")


def counters(spark, sf_dir) -> DataFrame:
    """Cumulative counters per link and CPU every six hours."""
    from tidegauge.functions import columns as C
    from tidegauge.plans.spread import day_bucket, running

    per = (packets(spark, sf_dir)
           .groupBy("link_id", (F.col("seq") % 4).cast("int").alias("cpu"),
                    (C.tick_start("ts", 21600) + F.expr("interval 6 hours")).alias("ts"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"),
                F.count_if(F.col("protocol") == 6).alias("tcp"),
                F.count_if(F.col("protocol") == 17).alias("udp"),
                F.count_if(F.col("protocol") == 1).alias("icmp")))
    return (running(per, ["link_id", "cpu"], ["ts"], day_bucket("ts"),
                    sums={"packets": "n", "bytes": "b", "tcp_packets": "tcp", "udp_packets": "udp",
                          "icmp_packets": "icmp"})
            .select("link_id", "cpu", "ts", "packets", "bytes", "tcp_packets", "udp_packets", "icmp_packets"))


def alert_candidates(spark, sf_dir) -> DataFrame:
    return alert_candidates_of(read(spark, sf_dir, "events"))


def alert_candidates_of(events: DataFrame) -> DataFrame:
    """One alert type per event type."""
    return events.select(
        _link(), F.col("event_type").alias("type"), _ts(), F.col("event_id").alias("seq"))


def labelled_flows(spark, sf_dir) -> DataFrame:
    qty, price = F.col("l_quantity"), F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") % 1000) * 1000).cast("double").alias("Flow Duration"),
        qty.alias("Total Fwd Packets"), (qty * F.col("l_discount")).alias("Total Backward Packets"),
        price.alias("Total Length of Fwd Packets"), (price * F.col("l_tax")).alias("Total Length of Bwd Packets"),
        (price / qty).alias("Flow Bytes/s"),
        (F.col("l_partkey") % 500).cast("double").alias("SYN Flag Count"),
        (F.col("l_suppkey") % 50).cast("double").alias("ACK Flag Count"),
        F.when(F.col("l_returnflag") == "N", " benign ").when(F.col("l_returnflag") == "A", "Syn")
        .otherwise("DrDoS_UDP").alias("label"),
        F.concat(F.lit("file"), F.col("l_linenumber").cast("string")).alias("source_file"))


def predictions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"),
        F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("prediction"))


def host_metrics(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        _link(), _ts(), F.col("event_id").alias("seq"),
        F.least(F.col("value"), F.lit(100.0)).alias("cpu_percent"),
        (F.col("event_id") % 100).cast("double").alias("memory_percent"),
        (1000 + F.col("event_id") % 3000).cast("double").alias("memory_mb"))
