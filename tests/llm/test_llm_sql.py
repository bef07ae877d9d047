"""Queries of the training-data operators against their SQL on the smallest driver tables, and what is registered."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidegauge.llm import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_one_query_per_operator():
    names = sorted(queries.all_queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert {*names, "pipeline"} <= set(entry.queries())
    assert set(oracles.SQL) <= set(names) and set(oracles.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.all_queries()[name](spark, SF)
    got = df.select(*sorted(df.columns)).collect()
    res = con.execute(oracles.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in order) for r in res.fetchall())
