"""Labelled flow files."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.plans.spread import hash_bucket, key_join, numbered, settle, sized_join


def trim_columns(df: DataFrame) -> DataFrame:
    """A4: header names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


#: Why a file is left out.
EMPTY, UNREADABLE, BLANK, NO_LABEL = "empty", "unreadable", "no header", "no label"


def _lines(spark, folder):
    """All lines of the ``*.csv`` files below a folder, with the file and whether they lie in its first block."""
    text = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", True)
            .text(folder))
    return text.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first"))


def flow_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """One row per ``*.csv`` file below a folder: file, bytes, header, names and reason.

    ``header`` is its first line, ``names`` the trimmed column names. ``reason`` is null for files that are read; otherwise
    it says why a file is left out: it is empty, cannot be read, begins with a blank line, or has no label column. One
    scan finds all first lines. ``max_files`` takes the first files in the order of their names.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
               .select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes")))
    # Scans pass over files without bytes; Spark's own list of the folder, which the driver holds anyway, has them.
    every = spark.createDataFrame([(re.sub("^([a-z0-9]+):///", r"\1:/", f),) for f in listing.inputFiles()], "file string")
    listed = key_join(every, listing, ["file"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    if max_files is not None:
        listed = listed.filter("bytes > 0").orderBy("file").limit(max_files)
    # A block is read in order by one task, so the first line has the least number there.
    first = (_lines(spark, folder).filter("first").withColumn("at", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "at").alias("header")))
    files = key_join(listed, first, ["file"], "left")
    files = files.withColumn("names", F.transform(F.filter(_cells("header", _WIDEST), lambda c: c.isNotNull()), lambda c: F.btrim(c)))
    blank = F.coalesce(F.btrim("header"), F.lit("")) == ""
    label = F.exists("names", lambda n: F.lower(n) == "label")
    return files.withColumn("reason", F.when(F.col("bytes") == 0, EMPTY).when(F.col("header").isNull(), UNREADABLE)
                            .when(blank, BLANK).when(~label, NO_LABEL))


#: Columns that a header can have.
_WIDEST = 256


def _cells(line: str, width: int):
    """The first ``width`` cells of a line, null beyond its last; the line is parsed once."""
    parsed = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(width))))
    return F.transform(F.array(parsed), lambda c: F.array(*[c[f"c{i}"] for i in range(width)]))[0]


def read_labelled_flows(spark: SparkSession, folder: str, max_files: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """All flow files of a folder as text columns, aligned by header name, with ``source_file``.

    Files may differ in their columns; one scan reads them all. Which files are left out, and why, says ``flow_files``
    (give its written result as ``files`` to look at it, too). A line that repeats its file's header is no row. Values do
    not span lines. Of equal column names of a file the first counts.
    """
    files = files if files is not None else settle(flow_files(spark, folder, max_files))
    good = files.filter("reason is null")
    names = sorted(r.n for r in good.select(F.explode("names").alias("n")).distinct().collect() if r.n)
    width = good.agg(F.max(F.size("names"))).first()[0]
    if not names:
        raise FileNotFoundError(f"no readable flow files below {folder}")
    places = F.array(*[F.array_position("names", n).cast("int") for n in names])
    good = good.select("file", "header", places.alias("places"))
    rows = sized_join(_lines(spark, folder), good, ["file"], ["value"], "inner").filter("value <> header and trim(value) <> ''")
    values = F.transform(F.array(_cells("value", width)), lambda v: F.transform("places", lambda p: F.when(p > 0, F.get(v, p - 1))))[0]
    rows = rows.select("file", values.alias("v"))
    return rows.select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)], F.col("file").alias("source_file"))


def union_flows(parts) -> DataFrame:
    """G1: rows of all parts, columns matched by name; a missing column is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sample_per_group(df: DataFrame, key: str, n: int, seed: int = 42, tie=None) -> DataFrame:
    """Exactly min(n, size) rows of every group, picked by a hash of their content.

    A group is not sorted as a whole: it is cut into hash ranges, which are numbered on their own. ``tie`` names columns
    that order rows of equal hash.
    """
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    h = df.withColumn("__h", F.xxhash64(*cols, F.lit(seed)))
    order = [F.col("__h"), *([F.col(c) for c in tie] if tie else cols)]
    return (numbered(h, [key], order, hash_bucket(F.col("__h")), "__i")
            .filter(F.col("__i") <= n).drop("__h", "__i"))
