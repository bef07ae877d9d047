"""Registered queries against their SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from tidegauge.verify import oracles, queries as registered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SAMPLE = ["b4_flow_ports", "c2_apply_blacklist_asof", "c4_match_signatures", "d1_tick_counters", "d3_ip_stats_cumulative",
          "d7_d9_cumulative", "e3_baseline_inclusive", "e7_adapt_profile", "e10_packet_verdict", "e15_cooldown",
          "f3_block_candidates", "score_ticks", "i11_combine_scores", "h1_h19_flow_features", "h_flow_features_true",
          "j5_scale_pop", "l1_status_snapshot", "k1_stream_ticks", "f3_block_candidates_since", "j16_anova", "j17_tree_nodes",
          "j18_folds", "j19_quantile_signatures", "k9_bounded_table", "k14_late_packets"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(one(v) for v in r) for r in rows),
                  key=lambda r: [f"{v:.3g}" if isinstance(v, float) else str(v) for v in r[::-1]])


def agree(a, b):
    """Equal but for the last of the six places, where rounding of ties differs."""
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            assert v == w or (isinstance(v, float) and v == pytest.approx(w, abs=2e-6, rel=1e-12)), (x, y)


def test_every_oracle_has_a_query():
    names = set(registered.all_queries())
    assert set(oracles.SQL) <= names and len(names) > 110
    # What a trained model says is all that SQL cannot give; that its node table says the same, it can.
    assert {n.split("_")[0] for n in names - set(oracles.SQL)} <= {"hybrid", "j6", "j7", "j9", "j14", "j17", "j18", "f5"}
    assert {"j6_forest_nodes", "j7_boosting_nodes", "j17_tree_nodes", "j9_predict_nodes", "j12_metrics_nodes", "f5_importance_nodes"} <= set(oracles.SQL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = registered.all_queries()[name](spark, SF)
    got = df.select(*sorted(df.columns)).collect()
    res = con.execute(oracles.SQL[name])
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(df.columns) == sorted(names)
    agree(plain(got), plain([tuple(r[i] for i in order) for r in res.fetchall()]))
