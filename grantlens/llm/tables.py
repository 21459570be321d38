"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from grantlens import scaling

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back; its shuffle files go at once.

    What follows reads the table, so nothing comes back to the shuffles that led to it.
    """
    path = f"{scaling.shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` or :func:`bucketed` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a frame to the shared folder in sorted buckets of ``key``, and read it back.

    Joins and aggregations by ``key`` neither shuffle nor sort it again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{scaling.shared_folder(spark)}/cut/{name}"
    conf = spark.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        dealt = df.repartition(n, key)
        dealt.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    finally:
        conf.set(_CLEANUP, before)
    table = spark.table(name)
    table._folder = path
    spark.sql(f"DROP TABLE {name}")  # the files stay, as they are outside the catalog's own folder
    return table
