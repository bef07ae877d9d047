"""Whitening of embeddings: weighted covariance over distinct vectors, each whitened once.

Vectors are put on an integer grid and identical ones become one row with a count. Means come from exact integer sums. The
covariance adds up, task by task, weighted products of centred rows; only dimension by dimension numbers reach the
driver. Every distinct vector is whitened once and joined back to its rows; frequent vectors are broadcast, and there are
at most ``FREQUENT`` of these by construction.
"""

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidegauge.llm.frames import fields, pick
from tidegauge.plans.spread import settle

#: Grid of the fit: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no exact place on the grid and count as not finite.
LARGEST = float(1 << 40)
FREQUENT = 4096


@dataclass
class Whitening:
    """A fitted transformation. ``n`` and ``sums`` are exact; rows of ``components`` are unit eigenvectors."""

    n: int
    sums: list
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self):
        return [float(e / self.trace) for e in self.eigenvalues]


def grid(df: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(id, x, key) of the usable rows: x is the vector on the grid, key a digest of it.

    Rows whose vector is null or empty, or holds null, not finite or too large entries, are left out, and so are vectors
    of another length than the most frequent one (of equally frequent lengths the greater).
    """
    c = F.col("c")
    rows = pick(df, id=id_col, c=vector_col).withColumn("c", c.cast("array<double>")).filter(
        F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST)) & (F.size("c") > 0))
    x = F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long"))
    rows = settle(rows.select("id", x.alias("x")).withColumn("key", F.unhex(F.sha2(F.array_join("x", ","), 256))))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (usual.d if usual else 0))


def distinct(rows: DataFrame) -> DataFrame:
    """One row per distinct x: key, x, copies. Equal vectors are added up before the shuffle, so frequent ones are spread."""
    return settle(rows.groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("copies")))


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _weights(batch, weights):
    return batch.column("copies").to_numpy() if weights == "count" else np.ones(batch.num_rows, np.int64)


def _sums(table, column, weights):
    """(total weight, weighted sums) of a list column; integers are added up exactly."""
    def run(batches):
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                w, m = _weights(batch, weights), _matrix(batch.column(column))
                n += int(w.sum())
                total = total + (m.astype(object) * w.astype(object)[:, None]).sum(axis=0) if weights == "count" \
                    else total + m.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [[str(Fraction(t)) for t in total]]},
                                             pa.schema([("n", pa.int64()), ("total", pa.list_(pa.string()))]))

    parts = table.select(column, "copies").mapInArrow(run, "n long, total array<string>")
    # Sums of integers are whole; a row per task is split by dimension and added up by Spark.
    out = parts.select("n", F.posexplode("total").alias("i", "t")).groupBy("i").agg(
        F.sum(F.col("t").cast("decimal(38,0)")).alias("t"), F.sum("n").alias("n")).orderBy("i").collect()
    return (int(out[0].n), [int(r.t) for r in out]) if out else (0, [])


def _means(table, column):
    """Plain means of a list column of doubles."""
    def run(batches):
        n, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + _matrix(batch.column(column)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tolist()]},
                                             pa.schema([("n", pa.int64()), ("total", pa.list_(pa.float64()))]))

    parts = table.select(column).mapInArrow(run, "n long, total array<double>")
    out = parts.select("n", F.posexplode("total").alias("i", "t")).groupBy("i").agg(
        (F.sum("t") / F.sum("n")).alias("m")).orderBy("i").collect()
    return np.array([r.m for r in out])


def _covariance(table, column, center, weights, n):
    """Sum of w (v - mean)(v - mean)' over the rows, by n. ``center`` centres a matrix of rows."""
    def run(batches):
        c = None
        for batch in batches:
            if batch.num_rows:
                z = center(_matrix(batch.column(column)))
                part = z.T @ (z * _weights(batch, weights)[:, None])
                c = part if c is None else c + part
        if c is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(c))), "row": c.tolist()},
                                             pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    parts = table.select(column, "copies").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = int(round(len(cells) ** 0.5))
    out = np.zeros((d, d))
    for r in cells:
        out[r.i, r.j] = r.v
    return (out + out.T) / (2 * n)


def _centering(n, sums):
    """Takes the exact mean off integer rows: the nearest whole number without rounding, then the rest."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([float(Fraction(s - w * n, n)) for s, w in zip(sums, whole)])
    whole = np.array(whole, dtype=np.int64)
    return lambda x: (x - whole).astype(np.float64) - rest


def fit(vectors: DataFrame, weights="one", components=16) -> Whitening | None:
    """Fits on the rows of ``distinct``, each weighted by one or by its number of copies (``weights="count"``).

    Components are numbered by falling eigenvalue; each has its largest entry positive. Components without variance, as of
    constant or dependent dimensions, are left out, so there may be fewer than asked for. None where there are no vectors.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be one or count, not {weights!r}")
    n, sums = _sums(vectors, "x", weights)
    if not n:
        return None
    v = _covariance(vectors, "x", _centering(n, sums), weights, n)
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, rows = values[order], columns.T[order]
    rank = int((values > max(values[0], 0) * len(values) * np.finfo(float).eps).sum())
    k = min(components, rank)
    rows = rows[:k] * np.sign(rows[np.arange(k), np.abs(rows[:k]).argmax(axis=1)])[:, None]
    return Whitening(n, sums, values[:k], rows, float(np.trace(v)))


def transform(vectors: DataFrame, model: Whitening, weights="one") -> DataFrame:
    """(key, copies, deviation, whitened) of every distinct vector, and sets the model's identity_error.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2; null where it does not fit into a long.
    """
    n, sums, center = model.n, model.sums, _centering(model.n, model.sums)
    matrix = model.components.T / np.sqrt(model.eigenvalues) if len(model.eigenvalues) else np.zeros((len(sums), 0))
    arrow = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("deviation", pa.int64()),
                       ("whitened", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                w = center(x) @ matrix
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), _deviations(x, n, sums), lists],
                                                 schema=arrow)

    out = settle(vectors.mapInArrow(run, "key binary, copies long, deviation long, whitened array<double>"))
    if len(model.eigenvalues):
        if weights == "one":
            mean = _means(out, "whitened")
            error = _covariance(out, "whitened", lambda w: w - mean, weights, n) - np.eye(len(mean))
        else:
            error = _covariance(out, "whitened", lambda w: w, weights, n) - np.eye(len(model.eigenvalues))
        model.identity_error = float(np.abs(error).max())
    return out


def _deviations(x, n, sums):
    """Exact in 64 bits where the bound of the batch allows it, else in whole numbers of any size."""
    near = [s // n for s in sums]
    rest = [s - m * n for s, m in zip(sums, near)]
    y = x - np.array(near, dtype=np.int64)
    largest = n * (int(np.abs(y).max()) + 1)
    if largest * largest * x.shape[1] < 1 << 63:
        d = y * n - np.array(rest, dtype=np.int64)
        return pa.array((d * d).sum(axis=1))
    d = y.astype(object) * n - np.array(rest, dtype=object)
    return pa.array([v if v < 1 << 63 else None for v in (d * d).sum(axis=1)], pa.int64())


def whiten(df: DataFrame, id_col="vec_id", vector_col="embedding", weights="one", components=16) -> tuple[DataFrame, Whitening | None]:
    """Whitens the vectors of ``df``; gives (id column, deviation, whitened) per usable row, and the model.

    Which rows are usable says ``grid``. Repeated rows and equal or null ids keep a row each. Without usable rows the table
    is empty and the model None; where no dimension varies ``whitened`` is empty. Other columns are not returned,
    whatever their names. A vector with a third of all rows is spread: it is joined by broadcast.
    """
    rows = grid(df, id_col, vector_col)
    vectors = distinct(rows)
    model = fit(vectors, weights, components)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType)] + fields("deviation long, whitened array<double>"))
    if model is None:
        return df.sparkSession.createDataFrame([], schema), None
    made = transform(vectors, model, weights)
    # Fewer than FREQUENT vectors can have more copies than this.
    often = made.agg(F.sum("copies")).first()[0] // FREQUENT
    frequent, rare = made.filter(F.col("copies") > often), made.filter(F.col("copies") <= often)
    keyed = rows.select("id", "key")
    there = keyed.join(F.broadcast(frequent.select("key", "deviation", "whitened")), "key")
    rest = keyed.join(F.broadcast(frequent.select("key")), "key", "left_anti").join(rare.select("key", "deviation", "whitened"), "key")
    out = there.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "deviation", "whitened"), model
