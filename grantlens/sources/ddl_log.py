"""The feed of DDL events, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.model import DDL_EVENTS

CREATE, ALTER, DROP = "CREATE SCHEMA", "ALTER SCHEMA", "DROP SCHEMA"
CREATE_OBJECT, ALTER_OBJECT = "CREATE OBJECT", "ALTER OBJECT"

# Commands that create, alter or drop something inside a schema or a schema.
DROP_SCHEMA_TAGS = ("DROP SCHEMA", "DROP EXTENSION", "DROP OWNED")
OBJECT_WORDS = (
    ("TABLE", 0),
    ("VIEW", 0),
    ("MATERIALIZED VIEW", 0),
    ("SEQUENCE", 0),
    ("FOREIGN TABLE", 0),
    ("FUNCTION", 0),
    ("OPERATOR", 0),
    ("AGGREGATE", 0),
    ("COLLATION", 0),
    ("CONVERSION", 0),
    ("DOMAIN", 0),
    ("TEXT SEARCH CONFIGURATION", 0),
    ("TEXT SEARCH DICTIONARY", 0),
    ("TYPE", 0),
    ("OPERATOR CLASS", 0),
    ("OPERATOR FAMILY", 0),
    ("STATISTICS", 100000),
    ("PROCEDURE", 110000),
)


def object_tags(verb: str, server_version: int = 150000) -> list[str]:
    """Command tags of one verb that concern objects in schemas, on one server version."""
    tags = [f"{verb} {word}" for word, since in OBJECT_WORDS if since <= server_version]
    return tags + (["CREATE TABLE AS", "SELECT INTO"] if verb == "CREATE" else [])


def normalise_tags(raw: DataFrame, server_version: int = 150000) -> DataFrame:
    """Reduce server command tags to the five the operators know; others are dropped.

    A DROP reports all that goes with it: only what is reported as a schema is the drop of one. A log
    that does not say what it reports tells schemas by having no object.
    """
    tag = F.col("tag")
    of_schema = F.coalesce(F.lower("object_type") == "schema", F.col("obj_oid").isNull())
    reduced = (
        F.when(tag == "CREATE SCHEMA", F.lit(CREATE))
        .when(tag == "ALTER SCHEMA", F.lit(ALTER))
        .when(tag.isin(*DROP_SCHEMA_TAGS) & of_schema, F.lit(DROP))
        .when(tag.isin(*object_tags("CREATE", server_version), CREATE_OBJECT), F.lit(CREATE_OBJECT))
        .when(tag.isin(*object_tags("ALTER", server_version), ALTER_OBJECT), F.lit(ALTER_OBJECT))
    )
    return raw.withColumn("tag", reduced).where(F.col("tag").isNotNull())


def read_ddl_events(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    pattern: str = "*",
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Events that concern a schema or something in one (Parquet, JSON, ...).

    A table has each event once. A stream has all that comes, late or twice: what is kept for
    telling copies would have to be forgotten at some time, and events with it. The streams of this
    package take no harm from copies.
    """
    reader = spark.readStream if streaming else spark.read
    source = reader.format(fmt).schema(DDL_EVENTS).option("pathGlobFilter", pattern)
    if streaming and files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    log = normalise_tags(source.load(path).where(F.col("schema_oid").isNotNull()))
    if streaming:
        return log.withColumn("ts", F.col("ts").cast("timestamp"))
    return log.dropDuplicates(["event_id"])
