"""Whitening against plain numpy and exact whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidegauge.llm import whitening

DDL = "vec_id long, embedding array<float>"


def usable(rows):
    ok = [(i, [float(np.float32(c)) for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in ok]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    return [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in ok if len(v) == d]


def brute(rows, counted=False):
    """Per row: id and deviation; and the exact mean, covariance and their fit list."""
    rows = usable(rows)
    fit = [x for _, x in rows] if counted else sorted({x for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    dev = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in rows}
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    return [(i, dev[x], x) for i, x in rows], n, sums, z.T @ z / n


def sample(count=400, d=7, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(count, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(m)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(2000, None), (2001, []), (2002, [None] * d), (2003, [math.nan] * d),
             (2004, [math.inf] + [0.0] * (d - 1)), (2005, [1.0, 2.0]), (None, rows[7][1]), (7, rows[7][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows = sample()
    out, model = whitening.whiten(spark.createDataFrame(rows, DDL).repartition(3), weights=weights, components=16)
    want, n, sums, v = brute(rows, weights == "count")
    got = out.collect()
    assert (model.n, model.sums) == (n, sums)
    assert sorted((str(r.vec_id), r.deviation) for r in got) == sorted((str(i), d) for i, d, _ in want)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    np.testing.assert_allclose(model.eigenvalues, values, rtol=1e-9)
    np.testing.assert_allclose(model.explained, values / values.sum(), rtol=1e-9)
    np.testing.assert_allclose(v @ model.components.T, model.components.T * model.eigenvalues, atol=1e-7 * values[0])
    assert model.identity_error < 1e-9
    by_x = {x: d for _, d, x in want}
    plain = {}
    for x, d in by_x.items():
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        plain.setdefault(d, []).append(model.components @ centred / np.sqrt(model.eigenvalues))
    for r in got:
        assert min(np.abs(np.array(r.whitened) - p).max() for p in plain[r.deviation]) < 1e-8


def test_dependent_and_constant_dimensions(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 1.0, float(i % 3)]) for i in range(60)]
    out, model = whitening.whiten(spark.createDataFrame(rows, DDL))
    assert len(model.eigenvalues) == 2 and model.identity_error < 1e-9 and {len(r.whitened) for r in out.collect()} == {2}


def test_one_vector_and_none(spark):
    out, model = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, DDL))
    assert [(r.deviation, r.whitened) for r in out.collect()] == [(0, [])] * 3 and model.n == 1 and model.identity_error == 0
    for rows in ([], [(1, None)], [(1, [float("nan")])]):
        out, model = whitening.whiten(spark.createDataFrame(rows, DDL))
        assert out.count() == 0 and model is None and out.columns == ["vec_id", "deviation", "whitened"]


def test_frequent_and_rare_vectors_meet_their_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FREQUENT", 3)
    rows = [(i, [float(i % 40), float(i % 7)]) for i in range(120)] + [(500 + i, [3.0, 3.0]) for i in range(300)]
    out, model = whitening.whiten(spark.createDataFrame(rows, DDL).repartition(4))
    want, *_ = brute(rows)
    assert sorted((r.vec_id, r.deviation) for r in out.collect()) == sorted((i, d) for i, d, _ in want)


def test_large_values_and_clashing_names(spark):
    ddl = "vec_id long, embedding array<double>, Embedding string, deviation long, Whitened int, x int, `key` int"
    rows = [(i, [i * 1e7, -i * 2e7 + (i % 3)], "e", 1, 2, 3, 4) for i in range(50)] + [(99, [1e300, 0.0], None, None, None, None, None)]
    out, model = whitening.whiten(spark.createDataFrame(rows, ddl))
    n, xs = 50, [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows[:50]]
    sums = [sum(c) for c in zip(*xs)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    got = {r.vec_id: r.deviation for r in out.collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in enumerate(exact)}
    assert None in got.values() or max(exact) < 1 << 63


def test_query_rows(spark, tmp_path):
    from tidegauge.llm import queries
    rows = sample(100, 20)
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path)).collect()
    want, n, *_ = brute(rows)
    assert len(got) == 16 * len(want) and {r.component for r in got} == set(range(1, 17)) and {r.n for r in got} == {n}
    assert sum(r.explained for r in got if r.vec_id == 0) < 1 and max(r.identity_error for r in got) < 1e-9
