"""Registration, deregistration and taxonomy of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.model import SYSTEM_SCHEMA_PATTERN
from grantlens.scaling import attach

TAXONOMY_COLUMNS = ("in_nomenclature", "level1", "level1_abbr", "level2", "level2_abbr")


def register_unlisted_schemas(
    namespaces: DataFrame, registry: DataFrame, roles: DataFrame,
    exceptions: DataFrame | None = None, keep_registered: bool = False,
) -> DataFrame:
    """Real schemas the registry ignores (insert) or holds as not created (update).

    The owner becomes the producer, except for schemas already listed when ``keep_registered``.
    System schemas and ``exceptions`` (schema_name) are left alone.
    """
    real = namespaces.where(~F.col("schema_name").rlike(SYSTEM_SCHEMA_PATTERN))
    if exceptions is not None:
        real = attach(real, exceptions.select("schema_name").distinct(), "schema_name", "left_anti")
    known = registry.select("db_id", "schema_name", "is_created", "producer")
    held = attach(real, known, ["db_id", "schema_name"], "left")
    held = held.where(F.col("is_created").isNull() | ~F.col("is_created"))
    owners = roles.select(F.col("role_oid").alias("owner_oid"), F.col("role_name").alias("owner"))
    held = attach(held, owners, "owner_oid", "left")
    listed = F.col("is_created").isNotNull()
    producer = F.when(listed, F.col("producer")).otherwise(F.col("owner")) if keep_registered else F.col("owner")
    return held.select(
        "db_id", "schema_oid", "schema_name",
        F.when(listed, F.lit("update")).otherwise(F.lit("insert")).alias("action"),
        producer.alias("producer"),
    )


def deregister_schemas(
    registry: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(remaining registry, answers) after removing the requested (db_id, schema_name).

    Rows of the taxonomy are refused (TB26) and stay; unknown names are reported.
    """
    asked = requests.select("db_id", "schema_name").distinct()
    known = registry.select("db_id", "schema_name", "in_nomenclature")
    answers = attach(asked, known, ["db_id", "schema_name"], "left").select(
        "db_id", "schema_name",
        F.when(F.col("in_nomenclature").isNull(), F.lit("unknown"))
        .when(F.col("in_nomenclature"), F.lit("TB26"))
        .otherwise(F.lit("removed"))
        .alias("answer"),
    )
    removed = answers.where(F.col("answer") == "removed").select("db_id", "schema_name")
    remaining = attach(registry, removed, ["db_id", "schema_name"], "left_anti")
    return remaining, answers


def import_taxonomy(registry: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """What importing the taxonomy changes in each database that has a registry: unknown schemas are
    inserted as not created, known ones only get their taxonomy columns, and only where these differ
    (NULL equals empty)."""
    columns = [c for c in TAXONOMY_COLUMNS if c in registry.columns and c in taxonomy.columns]
    old = registry.select(
        "db_id", "schema_name", F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_{c}") for c in columns],
    )
    # one row for each schema of the national list and database: that is what there is to decide
    databases = registry.select("db_id").distinct()
    held = attach(taxonomy.crossJoin(databases), old, ["db_id", "schema_name"], "left")
    differs = F.lit(False)
    for c in columns:
        if c == "in_nomenclature":
            differs = differs | F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False))
        else:
            differs = differs | (F.coalesce(F.col(f"_{c}"), F.lit("")) != F.coalesce(F.col(c), F.lit("")))
    action = (
        F.when(F.col("_known").isNull(), F.lit("insert")).when(differs, F.lit("update")).otherwise(F.lit("none"))
    )
    return held.select(*taxonomy.columns, "db_id", action.alias("action"))
