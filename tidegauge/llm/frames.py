"""Columns and identity: what every operator here needs before its own work."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from tidegauge.llm.textbytes import release
from tidegauge.plans.spread import settle


def with_columns_of(df: DataFrame, made: list) -> StructType:
    """Schema of ``df`` with the fields of ``made`` at the end; columns of the same names give way."""
    names = {f.name for f in made}
    return StructType([f for f in df.schema if f.name not in names] + made)


def extend(batch: pa.RecordBatch, made: dict) -> pa.RecordBatch:
    """The batch with further columns; columns of the same names give way."""
    kept = [n for n in batch.schema.names if n not in made]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(made.values()), names=kept + list(made))


def pick(df: DataFrame, **wanted) -> DataFrame:
    """The columns ``wanted`` names (new name = old name), found by place: other columns may differ from them in case only."""
    at = {new: df.columns.index(old) for new, old in wanted.items()}
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def tidy(df: DataFrame, keep, made) -> DataFrame:
    """``df`` without columns that differ from the names in ``keep`` in case only, or equal one in ``made`` in any case.

    Spark does not tell such names apart. Of other columns that differ in case only the first stays. The columns in
    ``keep`` stay as they are, and a table without such names is returned as it is.
    """
    taken, own = {k.lower() for k in keep}, []
    taken |= {m.lower() for m in made}
    for i, c in enumerate(df.columns):
        if c in keep or c.lower() not in taken:
            own.append(i)
            taken.add(c.lower())
    if len(own) == len(df.columns):
        return df
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in own])


#: What a task works on at a time, in bytes of text and rows; a longer text stands alone.
PART_BYTES, PART_ROWS = 1 << 20, 2048


def parts(batches, text_col):
    """The batches in slices of bounded size, whatever the length of the texts; memory goes back to the system in between."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        until, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < batch.num_rows:
            before = until[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(until, before + PART_BYTES, side="right"))), at + PART_ROWS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        release()


def has_unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether the column identifies the rows: no null and no repetition."""
    ids = df.select(F.col(f"`{id_col}`").alias("id"))
    return ids.groupBy("id").count().filter("count > 1 or id is null").limit(1).count() == 0


ROW = "__row"


def with_row_ids(df: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """Adds ``__row``, a long that identifies the row and grows with the id, and says whether it is the id itself.

    It is where ids are unique integers. Otherwise the rows are sorted by id (nulls first, equal ids in some order),
    numbered and written to the shared folder, so that a task that runs again sees the same numbers.
    """
    if isinstance(df.schema[id_col].dataType, IntegralType) and has_unique_ids(df, id_col):
        return df.withColumn(ROW, F.col(f"`{id_col}`").cast("long")), True
    return settle(df.orderBy(F.col(f"`{id_col}`")).withColumn(ROW, F.monotonically_increasing_id())), False


def join_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Left join of ``docs`` with at most one row per ``__row`` that holds arrays: both sides are shuffled, at every size.

    Lists have no size bound, so they are not broadcast; rows are unique, so nothing is skewed.
    """
    return docs.join(lists.hint("merge"), ROW, "left")


def fields(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl))
