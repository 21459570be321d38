"""The registry kept up to date from DDL events, in batch and as a stream.

A schema keeps its id from its CREATE to its DROP and no other schema gets it, so all that counts of
an id's events are the first CREATE, the last ALTER and the first DROP. These are minima and maxima:
events may come in any order, late or twice, and partial states merge.

Between ids, rows of the registry go by database and name. A schema that is created takes the row of its name if
there is one that is not created (registered beforehand, or left by a schema that was dropped), with
its editor and reader; a renamed schema takes its row along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grantlens.functions.privileges import expected_mask, privilege_list
from grantlens.functions.sqltext import first_group
from grantlens.operators.diagnostics import effective_registry, view_source_access
from grantlens.operators.roles import Reach
from grantlens.scaling import attach, cut_lineage, next_marked, union_all
from grantlens.sources.ddl_log import ALTER, ALTER_OBJECT, CREATE, CREATE_OBJECT, DROP
from grantlens.sources.stores import drop_versions, folder_exists, latest_version, version_path, versions

_EVENT = "struct<ts:timestamp,event_id:bigint,schema_name:string,owner_oid:bigint>"
STATE = f"db_id bigint, schema_oid bigint, born {_EVENT}, altered {_EVENT}, died {_EVENT}"


def fold_events(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State of every schema id after ``events`` on top of ``state``, in any order.

    One aggregation, merged on the map side: an id may hold a large share of all events.
    """
    event = F.struct(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "schema_name", F.col("owner_oid").cast("bigint").alias("owner_oid")
    )
    marks = [F.when(F.col("tag") == t, event).alias(c) for t, c in ((CREATE, "born"), (ALTER, "altered"), (DROP, "died"))]
    log = events.where(F.col("tag").isin(CREATE, ALTER, DROP)).select(F.col("db_id").cast("bigint").alias("db_id"), "schema_oid", *marks)
    if state is not None:
        log = log.unionByName(state)
    return log.groupBy("db_id", "schema_oid").agg(
        F.min("born").alias("born"), F.max("altered").alias("altered"), F.min("died").alias("died")
    )


def lives(state: DataFrame) -> DataFrame:
    """Every schema that had a CREATE: its first and last name, owner, and when it lived."""
    at = lambda c: F.struct(F.col(f"{c}.ts").alias("ts"), F.col(f"{c}.event_id").alias("event_id"))
    later = F.coalesce(at("altered") > at("born"), F.lit(False)) & F.col("altered").isNotNull()
    ended = F.col("died").isNotNull() & F.coalesce(at("died") > at("born"), F.lit(False))
    current = F.when(later, F.col("altered")).otherwise(F.col("born"))
    return state.where(F.col("born").isNotNull()).select(
        "db_id",
        "schema_oid",
        F.col("born.schema_name").alias("born_name"),
        current["schema_name"].alias("schema_name"),
        current["owner_oid"].alias("owner_oid"),
        (~ended).alias("is_live"),
        later.alias("was_altered"),
        at("born").alias("born_at"),
        F.when(ended, at("died")).alias("died_at"),
    )


def _row_names(lived: DataFrame, preregistered: DataFrame) -> DataFrame:
    """(db_id, schema_name, editor_oid, reader_oid): under which name each registered row goes on.

    A row leaves a name with the first schema that is created under it and renamed; it stays with
    that schema, and after its drop with the name it had then. Which renaming comes next is found for
    all of them at once; chains of renamings are then followed by doubling the steps taken.
    """
    beginning = F.struct(F.lit("0001-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("event_id"))
    moving = lived.where("schema_name != born_name")
    nothing = F.lit(None).cast("bigint")
    turns = union_all(
        [
            # a row may leave a name with a schema born under it ..
            moving.select("db_id", F.col("born_name").alias("name"), F.col("born_at").alias("at"), nothing.alias("left"),
                          F.col("schema_oid").alias("enters"), F.lit(True).alias("leaves"), nothing.alias("editor_oid"), nothing.alias("reader_oid")),
            # .. and waits under a name from the drop of the schema it went with ..
            moving.where("died_at is not null").select(
                "db_id", F.col("schema_name").alias("name"), F.col("died_at").alias("at"), F.col("schema_oid").alias("left"),
                nothing.alias("enters"), F.lit(False).alias("leaves"), nothing.alias("editor_oid"), nothing.alias("reader_oid")),
            # .. or from the beginning
            preregistered.select(
                F.col("db_id").cast("bigint").alias("db_id"), F.col("schema_name").alias("name"), beginning.alias("at"), nothing.alias("left"),
                nothing.alias("enters"), F.lit(False).alias("leaves"), "editor_oid", "reader_oid"),
        ]
    )
    found = cut_lineage(next_marked(turns, ["db_id", "name"], "at", "leaves", "enters", "next"))
    onward = found.where("left is not null").select("db_id", F.col("left").alias("schema_oid"), "next")
    steps = moving.select("db_id", "schema_oid", "schema_name").join(onward, ["db_id", "schema_oid"], "left")
    steps = cut_lineage(steps)
    while not steps.where("next is not null").isEmpty():
        ahead = steps.select("db_id", F.col("schema_oid").alias("next"), F.col("schema_name").alias("_name"), F.col("next").alias("_next"))
        steps = cut_lineage(
            steps.join(ahead, ["db_id", "next"], "left").select(
                "db_id", "schema_oid", F.coalesce("_name", "schema_name").alias("schema_name"), F.col("_next").alias("next")
            )
        )
    ends = steps.select("db_id", F.col("schema_oid").alias("next"), "schema_name")
    waiting = found.where("left is null and not leaves")
    return waiting.join(ends, ["db_id", "next"], "left").select(
        "db_id", F.coalesce("schema_name", "name").alias("schema_name"), "editor_oid", "reader_oid"
    )


def registry_rows(state: DataFrame, preregistered: DataFrame | None = None) -> DataFrame:
    """Registry rows of the folded state, and the preregistered rows nobody created.

    A live schema is created and has its id, a dropped one has none; the block is the name's
    prefix. One row stands for all schemas that had a name in a database one after the other: the last
    of them. ``preregistered`` has (db_id, schema_name, producer_oid, editor_oid, reader_oid).
    """
    key = ["db_id", "schema_name"]
    lived = cut_lineage(lives(state))
    # a dropped schema's row is taken over if its name was created again
    again = lived.groupBy("db_id", F.col("born_name").alias("schema_name")).agg(F.max("born_at").alias("_again"))
    gone = attach(lived.where("not is_live"), again, key, "left")
    gone = gone.where(F.col("_again").isNull() | (F.col("_again") < F.col("died_at"))).drop("_again")
    rows = lived.where("is_live").unionByName(gone).select(
        *key,
        F.when(F.col("is_live"), F.col("schema_oid")).alias("schema_oid"),
        F.col("is_live").alias("is_created"),
        F.col("owner_oid").alias("producer_oid"),
    )
    if preregistered is None:
        functions = [F.lit(None).cast("bigint").alias(c) for c in ("editor_oid", "reader_oid")]
        rows = rows.select("*", *functions)
    else:
        preregistered = preregistered.withColumn("db_id", F.col("db_id").cast("bigint"))
        waiting = attach(
            preregistered, lived.select("db_id", F.col("born_name").alias("schema_name")), key, "left_anti"
        ).select(
            *key, F.lit(None).cast("bigint").alias("schema_oid"), F.lit(False).alias("is_created"),
            "producer_oid", "editor_oid", "reader_oid",
        )
        rows = attach(rows, _row_names(lived, preregistered), key, "left")
        rows = rows.unionByName(waiting)
    return rows.withColumn("block", first_group(F.col("schema_name"), "^([a-z])_"))


def registry_from_events(events: DataFrame, preregistered: DataFrame | None = None) -> DataFrame:
    """The registry that a whole event log leads to."""
    return registry_rows(fold_events(events), preregistered)


def start_registry_stream(
    events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 20,
) -> StreamingQuery:
    """Fold a stream of events into a state below ``root``.

    Each batch writes what its own events fold to, whatever the size of the state, to a folder of
    its number; a repeated batch writes the same again. Late events and copies need no care, as
    states merge in any order. Every ``compact_every`` batches the parts are merged into one, and
    what went into the one before is dropped.
    """

    def fold_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fold_events(batch).write.mode("overwrite").parquet(version_path(f"{root}/part", batch_id))
        if (batch_id + 1) % compact_every == 0:
            merged = _merged(spark, root, batch_id)
            merged.write.mode("overwrite").parquet(version_path(f"{root}/full", batch_id))
            before = latest_version(spark, f"{root}/full", before=batch_id)
            if before is not None:
                drop_versions(spark, f"{root}/part", below=before + 1)
                drop_versions(spark, f"{root}/full", below=before)

    return (
        events.writeStream.foreachBatch(fold_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _merged(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The last complete merged state below ``upto`` and the parts after it, as one state."""
    full = latest_version(spark, f"{root}/full", before=upto)
    parts = [
        version_path(f"{root}/part", v)
        for v in versions(spark, f"{root}/part")
        if (full is None or v > full) and (upto is None or v <= upto)
    ]
    if full is not None:
        parts.append(version_path(f"{root}/full", full))
    state = spark.read.schema(STATE).parquet(*parts) if parts else spark.createDataFrame([], STATE)
    none = spark.createDataFrame([], "db_id bigint, schema_oid bigint, ts timestamp, event_id bigint, tag string, schema_name string, owner_oid bigint")
    return fold_events(none, state)


def read_registry_state(spark: SparkSession, root: str) -> DataFrame:
    """State written by the stream so far."""
    return _merged(spark, root)


def grants_on_create_object(events: DataFrame, registry: DataFrame, roles: DataFrame) -> DataFrame:
    """What a new object in a registered schema needs: its producer as owner, standard grants.

    Stateless, so the same code runs on a table and on a stream. Schemas without a living
    producer are left alone; an object reported twice is treated once (by the reader).
    """
    created = events.where((F.col("tag") == CREATE_OBJECT) & F.col("obj_oid").isNotNull())
    live = effective_registry(registry, roles).where(F.col("producer_oid").isNotNull()).select(
        "schema_oid", F.col("schema_name").alias("in_schema"), "producer_oid", "editor_oid", "reader_oid"
    )
    held = attach(created, live, "schema_oid", "inner")
    kind = F.col("obj_kind")

    def grant(function: str):
        mask = expected_mask(kind, function)
        return F.when(
            F.col(f"{function}_oid").isNotNull() & kind.isin("r", "p", "v", "m", "f", "S"),
            F.struct(
                F.lit(function).alias("function"), F.lit("GRANT").alias("verb"),
                privilege_list(mask).alias("privilege"), F.col(f"{function}_oid").alias("role_oid"),
            ),
        )

    owner = F.when(
        F.col("owner_oid") != F.col("producer_oid"),
        F.struct(
            F.lit("producer").alias("function"), F.lit("OWNER").alias("verb"),
            F.lit(None).cast("string").alias("privilege"), F.col("producer_oid").alias("role_oid"),
        ),
    )
    acts = F.explode(F.array(owner, grant("editor"), grant("reader")))
    return held.withColumn("_a", acts).where(F.col("_a").isNotNull()).select(
        "event_id", F.col("in_schema").alias("schema_name"), "obj_oid", "obj_kind",
        "_a.function", "_a.verb", "_a.privilege", "_a.role_oid",
    )


def view_warnings_on_create(
    events: DataFrame, view_sources: DataFrame, all_objects: DataFrame, all_acl: DataFrame,
    registry: DataFrame, roles: DataFrame, closure: DataFrame | Reach,
) -> DataFrame:
    """Sources that the producers of newly created views cannot read."""
    views = events.where((F.col("tag") == CREATE_OBJECT) & F.col("obj_kind").isin("v", "m")).select(
        F.col("obj_oid").alias("view_oid")
    ).distinct()
    return view_source_access(
        view_sources.join(views, "view_oid", "left_semi"), all_objects, all_acl, registry, roles, closure
    )


def owner_on_alter_object(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Altered objects in registered schemas that must go back to the producer."""
    altered = events.where((F.col("tag") == ALTER_OBJECT) & F.col("obj_oid").isNotNull())
    producers = registry.where("is_created").select(
        "schema_oid", F.col("schema_name").alias("in_schema"), "producer_oid"
    )
    held = attach(altered, producers, "schema_oid", "inner")
    return held.where(F.col("owner_oid") != F.col("producer_oid")).select(
        "event_id", F.col("in_schema").alias("schema_name"), "obj_oid", "obj_kind",
        F.lit("OWNER").alias("verb"), F.col("producer_oid").alias("role_oid"),
    )


BUCKET = 100_000  # event ids of one bucket


def seen_events(spark: SparkSession, path: str, buckets: list[int], before: int) -> DataFrame | None:
    """Ids in some buckets that batches before ``before`` have written; only those buckets' files are read."""
    folders = []
    for version in versions(spark, f"{path}/seen"):
        if version < before:
            root = version_path(f"{path}/seen", version)
            folders += [f"{root}/bucket={b}" for b in buckets if folder_exists(spark, f"{root}/bucket={b}")]
    if not folders:
        return None
    return spark.read.schema("event_id bigint").parquet(*folders)


def start_object_stream(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
    work: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the rows of an event operator to a Parquet folder, those of an event once.

    Rows of an event that an earlier batch has taken are left out, however late a copy comes; a
    repeated batch replaces its own folders. The ids taken are kept in buckets of neighbouring ids, and
    a batch reads only the buckets that its own events fall into. ``work`` is done on the new rows of
    each batch, with whatever tables it joins them to; without it they are written as they are. Rows are
    below ``rows``, ids below ``seen``.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch.dropDuplicates())
        bucket = F.floor(F.col("event_id") / BUCKET).cast("bigint")
        # as many as the batch's events fall into
        touched = [r[0] for r in batch.where("event_id is not null").select(bucket).distinct().collect()]
        seen = seen_events(spark, path, touched, batch_id)
        if seen is not None:
            batch = attach(batch, seen.distinct(), "event_id", "left_anti")
        done = batch if work is None else work(batch)
        done.write.mode("overwrite").parquet(version_path(f"{path}/rows", batch_id))
        ids = batch.where("event_id is not null").select("event_id", bucket.alias("bucket")).distinct()
        ids.write.mode("overwrite").partitionBy("bucket").parquet(version_path(f"{path}/seen", batch_id))

    return (
        rows.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
