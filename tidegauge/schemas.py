"""Schemas of the canonical tables and the fixed name lists."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField,
    StructType, TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


COUNTERS = [
    "packets", "bytes", "dropped_packets", "dropped_bytes", "passed_packets", "passed_bytes",
    "tcp_packets", "udp_packets", "icmp_packets", "other_packets",
]

FLAG_COUNTERS = ["fin_packets", "syn_packets", "rst_packets", "psh_packets", "ack_packets", "urg_packets"]

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

PACKETS = _struct(
    link_id=StringType(), ts=TimestampType(), seq=LongType(), src_ip=LongType(), dst_ip=LongType(),
    src_port=IntegerType(), dst_port=IntegerType(), protocol=IntegerType(), tcp_flags=IntegerType(),
    bytes=LongType(), ethertype=IntegerType(), l3_ok=BooleanType(), l4_ok=BooleanType(),
)

COUNTER_SNAPSHOTS = _struct(
    link_id=StringType(), cpu=IntegerType(), ts=TimestampType(), **{c: LongType() for c in COUNTERS})

BLACKLIST = _struct(
    link_id=StringType(), src_ip=LongType(), added_at=TimestampType(), removed_at=TimestampType())

PROFILE = _struct(
    avg_pps=DoubleType(), peak_pps=DoubleType(), avg_bps=DoubleType(), peak_bps=DoubleType(),
    tcp_ratio=DoubleType(), udp_ratio=DoubleType(), icmp_ratio=DoubleType(),
    unique_ips_per_minute=DoubleType(), learning_samples=LongType(), learn_start=TimestampType(),
    last_updated=TimestampType(), is_learned=BooleanType(),
)

# The profile used before anything is learned.
DEFAULT_PROFILE = (0.0, 0.0, 0.0, 0.0, 0.85, 0.10, 0.05, 0.0, 0, None, None, False)

ALERT_DETAILS = _struct(
    reasons=ArrayType(StringType()), metrics=MapType(StringType(), DoubleType()),
    current_pps=DoubleType(), baseline_pps=DoubleType())

ALERTS = _struct(
    timestamp=TimestampType(), type=StringType(), severity=StringType(), message=StringType(),
    details=ALERT_DETAILS)

# Label names of the labelled flow tables and their codes.
LABEL_IDS = {
    "BENIGN": 0,
    "DrDoS_DNS": 1,
    "DrDoS_LDAP": 2,
    "DrDoS_MSSQL": 3,
    "DrDoS_NTP": 4,
    "DrDoS_NetBIOS": 5,
    "DrDoS_SNMP": 6,
    "DrDoS_SSDP": 7,
    "DrDoS_UDP": 8,
    "Syn": 9,
    "TFTP": 10,
    "UDP-lag": 11,
    "WebDDoS": 12,
    "Portmap": 13,
    "NetBIOS": 14,
    "LDAP": 15,
    "MSSQL": 16,
    "UDP": 17,
}

# The 64 feature columns, in vector order.
FEATURES = [
    "Flow Duration",
    "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# Further columns that labelled flow files may carry.
EXTRA_FLOW_FEATURES = [
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "act_data_pkt_fwd", "min_seg_size_forward",
]
