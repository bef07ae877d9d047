"""Readers and writers of packets, counters, profiles, alerts, metrics and models."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.schemas import ALERTS, COUNTER_SNAPSHOTS, COUNTERS, DEFAULT_PROFILE, PACKETS, PROFILE


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: parsed packet headers; the schema is given, so nothing is inferred and unused columns are not read."""
    return spark.read.schema(PACKETS).format(fmt).load(path)


def stream_packets(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                   files_per_trigger: int | None = None, kafka: dict | None = None) -> DataFrame:
    """A1 as a stream: new files of a folder, or a Kafka topic of JSON records (``kafka`` holds its options)."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.from_json(F.col("value").cast("string"), PACKETS).alias("p")).select("p.*")
    reader = spark.readStream.schema(PACKETS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_counters(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2: cumulative counters; a missing counter is 0."""
    df = spark.read.schema(COUNTER_SNAPSHOTS).format(fmt).load(path)
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTERS})


#: Timestamps in JSON, to the microsecond.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_profile(profile: DataFrame, path: str) -> None:
    """One JSON record per link."""
    profile.write.mode("overwrite").option("timestampFormat", TIMES).json(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A stored profile; the default one if there is none or no record of it can be read.

    A missing or unreadable value is that of the default profile.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("link_id", StringType()), *PROFILE.fields])
    try:
        df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("timestampFormat", TIMES).json(path)
        df = df.filter(F.col("is_learned").isNotNull())
        found = not df.limit(1).isEmpty()
    except AnalysisException:
        found = False
    if not found:
        return spark.createDataFrame([(None, *DEFAULT_PROFILE)], schema)
    return df.withColumns({f.name: F.coalesce(f.name, F.lit(default)) for f, default in zip(PROFILE.fields, DEFAULT_PROFILE)
                           if default is not None})


def write_alerts(alerts: DataFrame, path: str) -> None:
    """A10: appended as JSON lines, with the link if there is one."""
    names = [c for c in ("link_id", *[f.name for f in ALERTS.fields]) if c in alerts.columns]
    alerts.select(*names).write.mode("append").option("timestampFormat", TIMES).json(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts and their links; null where none was written."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("link_id", StringType()), *ALERTS.fields])
    return spark.read.schema(schema).option("timestampFormat", TIMES).json(path)


# Metric name, kind, help text and the column it is taken from.
METRICS = [
    ("ddos_total_packets", "counter", "Total packets processed", "packets"),
    ("ddos_total_bytes", "counter", "Total bytes processed", "bytes"),
    ("ddos_dropped_packets", "counter", "Packets dropped", "dropped_packets"),
    ("ddos_tcp_packets", "counter", "TCP packets", "tcp_packets"),
    ("ddos_udp_packets", "counter", "UDP packets", "udp_packets"),
    ("ddos_cpu_percent", "gauge", "CPU usage percentage", "cpu_percent"),
    ("ddos_memory_percent", "gauge", "Memory usage percentage", "memory_percent"),
    ("ddos_uptime_seconds", "counter", "System uptime in seconds", "uptime_seconds"),
]


def to_metric_rows(df: DataFrame, keys=("link_id",)) -> DataFrame:
    """One row per metric; a missing column or value is 0."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("type"),
                     F.lit(text).alias("help"),
                     (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias("value"),
                     F.lit(df.schema[c].dataType.simpleString() if c in df.columns else "bigint").alias("__t"))
            for i, (name, kind, text, c) in enumerate(METRICS)]
    return df.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")


def metric_text(rows: DataFrame, keys=("link_id",)) -> DataFrame:
    """A13 as exposition text: one string per key, eight metrics of three lines."""
    value = F.when(F.col("__t") == "double", F.col("value").cast("string")).otherwise(
        F.col("value").cast("decimal(38,0)").cast("string"))
    line = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "type",
                    F.lit("\n"), "name", F.lit(" "), value)
    texts = F.array_sort(F.collect_list(F.struct("position", line.alias("text"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"))


def save_model(spark: SparkSession, model: PipelineModel, metadata: dict, path: str) -> None:
    """The fitted stages (scaler included) and a JSON record about them."""
    model.write().overwrite().save(f"{path}/model")
    (spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string")
     .coalesce(1).write.mode("overwrite").text(f"{path}/metadata"))


def load_model(spark: SparkSession, path: str):
    """(model, metadata), or (None, {}) if there is nothing at the path. A damaged model is an error."""
    from pyspark.errors import AnalysisException
    try:
        meta = json.loads(spark.read.text(f"{path}/metadata").first().value)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, {}
    return PipelineModel.load(f"{path}/model"), meta
