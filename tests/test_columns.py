import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import learn
from tidegauge.schemas import EXTRA_FLOW_FEATURES, FEATURES, LABEL_IDS


def values(spark, rows, ddl, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_feature_names():
    assert len(FEATURES) == 64 == len(set(FEATURES))
    assert len(set(FEATURES) | set(EXTRA_FLOW_FEATURES)) == 76
    assert FEATURES[13] == "Flow Bytes/s" and FEATURES[43] == "SYN Flag Count" and FEATURES[63] == "Idle Min"


def test_cleaning_differs_from_vector_cleaning(spark):
    rows = [(math.nan,), (math.inf,), (-math.inf,), (1e12,), (None,), (2.5,)]
    assert values(spark, rows, "x double", C.clean_number("x")) == [0, 0, 0, 1e10, 0, 2.5]
    assert values(spark, rows, "x double", C.nan_to_num("x")) == [0, 1e10, -1e10, 1e12, 0, 2.5]


def test_text_to_number(spark):
    rows = [("abc",), ("Infinity",), ("NaN",), ("",), (None,), ("1e3",)]
    assert values(spark, rows, "x string", C.clean_number(C.to_number("x"))) == [0, 0, 0, 0, 0, 1000]


def test_attack_type(spark):
    rows = [(101.0, 9.0, 0.0, 0.0), (0.0, 0.0, 10001.0, 1000001.0), (0.0, 0.0, 5001.0, 0.0), (100.0, 9.0, 0.0, 0.0)]
    ddl = "`SYN Flag Count` double, `ACK Flag Count` double, `Flow Packets/s` double, `Flow Bytes/s` double"
    assert values(spark, rows, ddl, C.infer_attack_type()) == ["SYN_Flood", "UDP_Flood", "DrDoS_UDP", "DDoS_Generic"]
    assert values(spark, rows, ddl, C.infer_attack_type(trained=False)) == ["UNKNOWN"] * 4
    assert values(spark, rows, ddl, C.infer_attack_type(is_attack=F.lit(False))) == ["BENIGN"] * 4


def test_bands(spark):
    pps = [(49_999,), (50_000,), (499_999,), (500_000,), (1_999_999,), (2_000_000,)]
    assert values(spark, pps, "p long", C.intensity_band("p")) == ["small", "medium", "medium", "large", "large", "hyper"]
    scores = [(59.9,), (60.0,), (74.9,), (75.0,), (85.0,)]
    assert values(spark, scores, "s double", C.severity("s")) == ["medium"] * 3 + ["high"] * 2
    assert values(spark, scores, "s double", C.severity4("s")) == ["low", "medium", "medium", "high", "critical"]
    assert values(spark, [(9.0,), (10.0,), (50.0,), (200.0,), (800.0,), (801.0,)], "g double", C.gbps_band("g")) == [
        None, "small", "medium", "large", "large", None]


def test_human_units(spark):
    n = [(0,), (999,), (1000,), (1005,), (1125,), (1_500_000,)]
    assert values(spark, n, "n long", C.human_count("n")) == ["0", "999", "1.00K", "1.00K", "1.13K", "1.50M"]
    b = [(0,), (1023,), (1024,), (1536,), (1 << 20,), (1 << 30,)]
    assert values(spark, b, "n long", C.human_bytes("n")) == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "1.00 MB", "1.00 GB"]


def test_fixed_rounds_ties_to_even(spark):
    x = [(0.125,), (0.375,), (0.625,), (2.5,)]
    assert values(spark, x, "x double", C.fixed("x", 2)) == [f"{v:.2f}" for (v,) in x]
    assert values(spark, x, "x double", C.fixed("x", 0)) == [f"{v:.0f}" for (v,) in x]


def test_addresses(spark):
    assert values(spark, [(3232235777,), (0,), (4294967295,), (None,)], "x long", C.ip_to_string("x")) == [
        "192.168.1.1", "0.0.0.0", "255.255.255.255", None]
    text = [("192.168.1.1",), ("1.2.3",), ("1.2.3.256",), ("a.b.c.d",), (None,), ("0.0.0.0",)]
    assert values(spark, text, "x string", C.ip_to_long("x")) == [3232235777, None, None, None, None, 0]


def test_labels(spark):
    rows = [(" benign ",), ("DrDoS_UDP",), ("BENIGN",), ("Syn",), ("new",), (None,)]
    assert values(spark, rows, "label string", C.encode_binary()) == [0, 1, 0, 1, 1, 1]
    assert values(spark, rows, "label string", C.label_id()) == [None, 8, 0, 9, None, None]
    codes = [(i,) for i in LABEL_IDS.values()]
    assert values(spark, codes, "c int", C.decode_label_id("c")) == list(LABEL_IDS)
    df, encoder = learn.encode_multiclass(spark.createDataFrame(rows[:4], "label string"))
    assert encoder.labels == sorted({r[0].strip() for r in rows[:4]})
    assert [r.name for r in learn.decode_multiclass(df, encoder).collect()] == [r[0].strip() for r in rows[:4]]


def test_ratio_is_zero_without_denominator(spark):
    assert values(spark, [(1, 0), (1, -1), (1, 4)], "n long, d long", C.ratio("n", "d")) == [0, 0, 0.25]


def test_known_features():
    assert C.select_features([" Flow Duration", "x", "Idle Min "]) == ["Flow Duration", "Idle Min"]
    with pytest.raises(ValueError):
        C.select_features(["x"])
