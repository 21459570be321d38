"""Physical care that the optimizer cannot take from the query alone."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def attach(facts: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join a table to a dimension by columns of the same names."""
    return facts.join(dim, [on] if isinstance(on, str) else list(on), how)


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


# Bytes that a broadcast row takes in the driver's memory for each byte of its zstd file. Rows of the catalog tables are
# 10 to 38 times the file; the table that a join looks them up in takes two to four times the rows.
IN_MEMORY = 64
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def weigh_in_memory(spark: SparkSession) -> None:
    """Let the optimizer weigh files by the rows they hold, not by their compressed bytes.

    A join broadcasts a table below the session's threshold, and the driver has to build that table in
    memory. Ids and names compress so well that a file of 2 MB holds a million roles. The threshold stays
    what the session says, and so does a higher weight that it already has.
    """
    if float(spark.conf.get(_FACTOR, "1")) < IN_MEMORY:
        spark.conf.set(_FACTOR, str(float(IN_MEMORY)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The table survives the loss of executors, is scanned column by column, and carries the size of
    its files, which decides how it is joined from there on; see :func:`weigh_in_memory`.
    """
    path = f"{shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[Column], into: str = "id") -> DataFrame:
    """``row_number()`` over the whole table without moving it to one task.

    Rows are range-partitioned and sorted, written once, and each partition starts counting
    where the previous one stopped; only one count per partition is shared. ``order`` must be
    total (ties broken by the caller). Numbers start at 1.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # finding the ranges reads a sample: the input is written first, so that it is worked out once
    ranged = cut_lineage(df).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_pos"), 33)
    placed = placed.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by spark.sql.shuffle.partitions, not by the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(into, local + F.col("_offset") + F.lit(1))
        .drop("_pos", "_part", "_offset")
    )


def next_marked(df: DataFrame, key: list[str], at: str, mark: str, value: str, into: str) -> DataFrame:
    """For every row the ``value`` of the first later row of its key where ``mark`` holds, else null.

    Rows are dealt out by ranges of (key, at), so a key with a large share of the rows lies in many
    ranges; what a range does not answer itself comes from the first marked row of the ranges after it,
    one row for each key and range. Marked rows of one key differ in ``at`` from all others of it.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(df).repartitionByRange(parts, *key, at)
    placed = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    target = F.when(F.col(mark), F.struct(at, value))
    later = Window.partitionBy("_part", *key).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_target", target).withColumn("_here", F.min("_target").over(later))
    own = rows.groupBy("_part", *key).agg(F.min("_target").alias("_first"))
    after = Window.partitionBy(*key).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("_part", *key, F.min("_first").over(after).alias("_later"))
    answer = F.coalesce("_here", "_later")[value].alias(into)
    return rows.join(own, ["_part", *key]).select(*df.columns, answer)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not copy.

    The optimizer replaces a computed column by its definition when it pushes a filter down; for
    long decision tables built on one another the copies outgrow what can be compiled. Columns
    that leave a generator stay columns.
    """
    names = [c for c in df.columns if c not in columns]
    struct = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*names, F.inline(F.array(struct)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
