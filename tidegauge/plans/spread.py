"""Ordered and skewed work, spread so that no key has to fit into one task.

A plain ``Window.partitionBy(key).orderBy(time)`` sends a whole key to one task. The helpers here cut every key into
buckets along its order, work inside the buckets, and pass only one small row per bucket between them. All are exact.
"""

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16


def _same(left, right, keys) -> Column:
    """Null-safe key equality, so that rows with a missing key are not lost in a join."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return cond


def key_join(left: DataFrame, right: DataFrame, keys, how="inner", extra=None) -> DataFrame:
    """Null-safe equi-join; the right side brings only its other columns. ``extra`` may add a condition."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = _same(left, r, keys)
    if extra is not None:
        cond = cond & extra
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def with_salt(df: DataFrame, salt_of, salts=SALTS) -> DataFrame:
    """Adds ``__salt``, a hash of row values (not a random number), so a task that runs again salts every row alike."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)).cast("int"))


def salted_join(left: DataFrame, right: DataFrame, keys, salt_of, how="left", during=None, salts=SALTS) -> DataFrame:
    """Join in which one key of ``left`` may be very frequent: left, semi or anti, on plain equality.

    The left rows of a key are spread over ``salts`` buckets and the right side is repeated once per bucket. ``during``
    (time, start, end) also asks that start <= time < end. A left side that already has ``__salt`` keeps it, so that
    several such joins in a row need one shuffle.
    """
    salted = "__salt" in left.columns
    lhs = left if salted else with_salt(left, salt_of, salts)
    rhs = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    out = _equi_join(lhs, rhs, [*keys, "__salt"], how, during)
    return out if salted else out.drop("__salt")


def _equi_join(left, right, keys, how, during=None):
    names = {k: f"__r_{k}" for k in keys}
    rhs = right.withColumnsRenamed(names)
    cond = [left[k] == rhs[r] for k, r in names.items()]
    if during:
        time, start, end = during
        cond += [left[time] >= rhs[start], left[time] < rhs[end]]
    return left.join(rhs, cond, how).drop(*names.values())


BROADCAST_ROWS = 500_000


def sized_join(left: DataFrame, right: DataFrame, keys, salt_of, how="left", during=None,
               max_rows=BROADCAST_ROWS) -> DataFrame:
    """Join a large left side with a list of narrow rows that is usually, but not surely, short.

    The list is counted (up to the limit) now. A short one is broadcast, so the left side is not shuffled at all; a
    longer one goes through ``salted_join``.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return _equi_join(left, F.broadcast(right), keys, how, during)
    return salted_join(left, right, keys, salt_of, how, during)


def small_join(left: DataFrame, right: DataFrame, keys, how="inner", max_rows=BROADCAST_ROWS) -> DataFrame:
    """Null-safe join with a table of about one row per link: broadcast if its counted size allows it.

    Without that, all rows of a link would meet in one task. Beyond the limit there are so many links that the plain join
    is spread by them, and AQE splits what is skewed.
    """
    short = right.limit(max_rows + 1).count() <= max_rows
    return key_join(left, F.broadcast(right) if short else right, keys, how)


def day_bucket(ts="ts", days=1) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(86_400_000_000 * days)).cast("long")


def time_bucket(ts, seconds) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(int(round(seconds * 1_000_000)))).cast("long")


def hash_bucket(h, bits=16) -> Column:
    """Bucket of a 64-bit hash that keeps the order of the hash."""
    return F.shiftright(h, 64 - bits)


def _with_carry(work, carry):
    """Rows and one carried row per bucket, which sorts first."""
    return (work.withColumn("__row", F.lit(1))
            .unionByName(carry.withColumn("__row", F.lit(0)), allowMissingColumns=True))


def running(df: DataFrame, keys, order, bucket, sums=None, maxs=None, mins=None, rank=None,
            total=None) -> DataFrame:
    """Running sums, maxima, minima and row numbers per key.

    ``bucket`` is a Column that never falls along ``order`` (a day, a hash prefix). ``sums``, ``maxs`` and ``mins`` map
    new column names to columns of ``df``; ``rank`` names a 1-based row number, ``total`` the key's row count. Per key
    one row per bucket is put in order; the rows themselves are only ordered inside their bucket. What comes before a
    bucket joins its rows as one more row at the front, so rows are shuffled once and nothing is joined.
    """
    sums, maxs, mins = dict(sums or {}), dict(maxs or {}), dict(mins or {})
    if rank:
        sums[rank] = F.lit(1).cast("long")
    made = {**sums, **maxs, **mins}
    work = df.select("*", bucket.alias("__b"),
                     *[(F.col(c) if isinstance(c, str) else c).alias(f"__v_{n}") for n, c in made.items()])

    totals = work.groupBy(*keys, "__b").agg(
        *([F.count(F.lit(1)).alias("__rows")] if total else []),
        *[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__v_{n}") for n in maxs],
        *[F.min(f"__v_{n}").alias(f"__v_{n}") for n in mins])
    key = Window.partitionBy(*keys)
    before = key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "__b", *([F.sum("__rows").over(key).alias(total)] if total else []),
        *[F.sum(f"__v_{n}").over(before).alias(f"__v_{n}") for n in sums],
        *[F.max(f"__v_{n}").over(before).alias(f"__v_{n}") for n in maxs],
        *[F.min(f"__v_{n}").over(before).alias(f"__v_{n}") for n in mins])

    inside = (Window.partitionBy(*keys, "__b").orderBy("__row", *order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    old = [F.col(f"`{c}`") for c in df.columns]
    out = _with_carry(work, carry).select(
        *old, "__row",
        *([F.max(total).over(inside).alias(total)] if total else []),
        *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(n) for n in sums],
        *[F.max(f"__v_{n}").over(inside).alias(n) for n in maxs],
        *[F.min(f"__v_{n}").over(inside).alias(n) for n in mins])
    return out.filter("__row = 1").drop("__row")


def previous(df: DataFrame, keys, order, bucket, columns) -> DataFrame:
    """Values of the row before, as ``prev_<column>``; null on a key's first row."""
    work = df.withColumn("__b", bucket)
    last = work.groupBy(*keys, "__b").agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__b")
    carry = (last.select(*keys, "__b", F.lag("__last").over(along).alias("__prev"))
             .select(*keys, "__b", *[F.col(f"__prev.{c}").alias(f"__p_{c}") for c in columns]))
    inside = Window.partitionBy(*keys, "__b").orderBy("__row", *order)
    # The carried row holds the values in columns of their own: a key column may be among the wanted ones.
    work = work.select("*", *[F.col(c).alias(f"__p_{c}") for c in columns])
    out = _with_carry(work, carry).select(
        *[F.col(f"`{c}`") for c in df.columns], "__row",
        *[F.lag(f"__p_{c}").over(inside).alias(f"prev_{c}") for c in columns])
    return out.filter("__row = 1").drop("__row")


def numbered(df: DataFrame, keys, order, bucket, name="n") -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, bucket, rank=name)


def with_halo(df: DataFrame, n, chunk, halo) -> DataFrame:
    """Cut numbered rows into chunks and lend each chunk the last ``halo`` rows before it.

    Adds ``__chunk`` and ``__own`` (false for lent rows). A window over (key, ``__chunk``) then sees every row's last
    ``halo`` predecessors; keep only ``__own`` rows afterwards. With chunk >= halo a row is lent at most once.
    """
    first = F.floor((F.col(n) - 1) / F.lit(chunk)).cast("long")
    last = F.floor((F.col(n) - 1 + halo) / F.lit(chunk)).cast("long")
    spread = df.withColumn("__chunk", F.explode(F.sequence(first, last)))
    return spread.withColumn("__own", F.col("__chunk") == first)


def owned(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", "__chunk")


def position_of_rank(df: DataFrame, keys, order, bucket, k) -> DataFrame:
    """The ``order`` values of every key's k-th row; keys with fewer rows (or without a value) are absent.

    Only the bucket in which a key reaches its k-th row is ranked, all others are merely counted. ``k`` is a number or
    a column of ``df`` that is constant per key.
    """
    want = F.lit(k) if isinstance(k, int) else k
    work = df.select(*keys, *order, bucket.alias("__b"), want.alias("__k"))
    counts = work.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), F.max("__k").alias("__want"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
                .filter((F.col("__before") < F.col("__want")) & (F.col("__want") <= F.col("__before") + F.col("__n")))
                .select(*keys, "__b", (F.col("__want") - F.col("__before")).alias("__left")))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    ranked = work.join(crossing, [*keys, "__b"]).withColumn("__i", F.row_number().over(inside))
    if isinstance(k, int):
        # No bucket needs more than its first k rows; with a number, tasks cut theirs before the shuffle.
        ranked = ranked.filter(F.col("__i") <= k)
    return (ranked.filter(F.col("__i") == F.col("__left"))
            .select(*keys, *order))


def settle(df: DataFrame) -> DataFrame:
    """Write a reduced intermediate table once and read it back.

    For results that are much smaller than their input and used several times. The table lies in the shared folder the
    session names in ``spark.checkpoint.dir``, so it outlives lost executors, and its file sizes let the optimizer pick
    the join strategy by real size.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_local_folder = None


def shared_folder(spark) -> str:
    """Folder for intermediate tables and checkpoints; a temporary one only in local mode."""
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        import tempfile
        _local_folder = tempfile.mkdtemp(prefix="tidegauge-")
    return _local_folder


def runs(batches, keys):
    """Split Arrow batches of rows sorted by ``keys`` into (key, piece, is_new_key) without collecting a key."""
    import numpy as np
    import pandas as pd

    current = object()
    for pdf in batches:
        if pdf.empty:
            continue
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            codes = pd.factorize(pdf[k])[0]
            change[1:] |= codes[1:] != codes[:-1]
        starts = [*np.flatnonzero(change), len(pdf)]
        for a, b in zip(starts, starts[1:]):
            piece = pdf.iloc[a:b]
            key = tuple(None if pd.isna(piece[k].iloc[0]) else piece[k].iloc[0] for k in keys)
            yield key, piece, key != current
            current = key
