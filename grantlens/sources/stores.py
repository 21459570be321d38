"""Versioned registry tables and command plans."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.scaling import attach, number_rows

PIECE = "schema_piece"  # number of the folder that a schema's rows are filed in
PIECES = 16  # folders of a database


def schema_piece(db_id: Column, schema_oid: Column) -> Column:
    """Folder of a schema in tables of :func:`write_by_schema`."""
    piece = F.pmod(F.xxhash64(schema_oid.cast("bigint")), F.lit(PIECES))
    return (F.coalesce(db_id, F.lit(-1)).cast("bigint") * PIECES + piece).alias(PIECE)


def write_by_schema(table: DataFrame, path: str, spread: int = 4) -> None:
    """Write a catalog table (db_id, schema_oid, …) in folders by database and piece of its schemas.

    A folder is written by up to ``spread`` tasks, by object, so a large schema is not one task's.
    """
    filed = table.withColumn(PIECE, schema_piece(F.col("db_id"), F.col("schema_oid")))
    share = F.pmod(F.xxhash64("obj_oid"), F.lit(spread))
    filed.repartition(F.col(PIECE), share).write.partitionBy(PIECE).mode("overwrite").parquet(path)


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    if fs.exists(path):
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("version=") and fs.exists(done):
                found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Highest completely written version below ``before``; a version is one folder."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    return found[-1] if found else None


def drop_versions(spark: SparkSession, root: str, below: int) -> None:
    """Remove the complete versions below a number."""
    for version in versions(spark, root):
        if version < below:
            path = spark._jvm.org.apache.hadoop.fs.Path(version_path(root, version))
            fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            fs.delete(path, True)


def read_version(spark: SparkSession, root: str, version: int | None) -> DataFrame | None:
    return None if version is None else spark.read.parquet(version_path(root, version))


def upsert(current: DataFrame, changes: DataFrame, key: list[str] | str) -> DataFrame:
    """Rows of ``changes`` (key unique, ``_deleted`` optional) replace those of ``current``.

    Names of schemas are unique per database only: their key is ``["db_id", "schema_name"]``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kept = attach(current, changes.select(*keys), keys, "left_anti")
    added = changes
    if "_deleted" in changes.columns:
        added = changes.where(~F.coalesce(F.col("_deleted"), F.lit(False))).drop("_deleted")
    return kept.unionByName(added.select(*current.columns))


def write_registry(registry: DataFrame, root: str, version: int) -> str:
    """Write one version to its own folder; writing it again replaces it."""
    path = version_path(root, version)
    registry.write.mode("overwrite").parquet(path)
    return path


class Conflict(RuntimeError):
    """Another writer has committed a version in the meantime."""


def _manifests(spark: SparkSession, root: str) -> dict[int, str]:
    """Number → manifest file of every committed version."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return {}
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return {int(n.removesuffix(".json")): f"{root}/_manifests/{n}" for n in names if n.endswith(".json") and not n.startswith((".", "_"))}


def committed(spark: SparkSession, root: str) -> int | None:
    """Number of the last committed version."""
    return max(_manifests(spark, root), default=None)


def read_committed(spark: SparkSession, root: str, version: int | None = None) -> tuple[int | None, DataFrame | None]:
    """A committed version (the last one by default) and its table; (None, None) if there is none.

    A manifest stands once its data do, so a reader never sees half a version.
    """
    manifests = _manifests(spark, root)
    version = max(manifests, default=None) if version is None else version
    if version is None:
        return None, None
    entry = spark.read.schema("version int, based_on int, data string").json(manifests[version]).first()
    return version, spark.read.parquet(f"{root}/{entry['data']}")


def commit(table: DataFrame, root: str, based_on: int | None) -> int:
    """Write ``table`` as the version after ``based_on``; :class:`Conflict` if somebody else was first.

    Data go to a folder of their own; then the manifest of that number is created, which the file
    system lets one writer do only, as nothing is overwritten. Data of a refused commit are removed.
    """
    spark = table.sparkSession
    version = 0 if based_on is None else based_on + 1
    if committed(spark, root) != based_on:
        raise Conflict(f"{root} is at version {committed(spark, root)}, not at {based_on}")
    data = f"data/{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{data}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests/{version}.json")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as error:
        folder = jvm.org.apache.hadoop.fs.Path(f"{root}/{data}")
        fs.delete(folder, True)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            raise Conflict(f"version {version} of {root} has been committed by another writer") from None
        raise
    line = json.dumps({"version": version, "based_on": based_on, "data": data}) + "\n"
    out.write(line.encode())
    out.close()
    return version


def commit_changes(
    spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 10
) -> int:
    """Commit ``change`` of the last version, worked out anew whenever another writer was first."""
    for _ in range(attempts):
        version, table = read_committed(spark, root)
        try:
            return commit(change(table), root, version)
        except Conflict:
            continue
    raise Conflict(f"{attempts} attempts at {root} came too late")


def write_plan(plan: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write a plan by database, with a ``seq`` that gives the order of execution.

    ``order`` defaults to step and object; it must be total.
    """
    columns = order or [c for c in ("db_id", "schema_name", "step", "obj_oid", "role_oid", "command") if c in plan.columns]
    numbered = number_rows(plan, [F.col(c).asc_nulls_first() for c in columns], "seq")
    numbered.write.partitionBy("db_id").mode("overwrite").parquet(path)
