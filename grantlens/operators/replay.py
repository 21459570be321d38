"""Edits of the registry that depend on each other, applied in the order they were made.

Edits meet only in the names they take or give up, so those that share no name go in one round, reviewed
and applied as a set; an edit waits for the earlier ones on its names. Names count as shared if they are
equal but for block prefixes, as the review may give a name another prefix. Renames in a circle (a to b, b
to a) could never go one by one: a circle counts as one edit, made when its first one was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.operators.registry import apply_registry_changes
from grantlens.scaling import cut_lineage, shared_folder


def base_name(name: Column) -> Column:
    """A schema's name without block prefixes; null for no name."""
    return F.regexp_replace(F.nullif(name, F.lit("")), "^([a-z]?_)+", "")


def rename_circles(changes: DataFrame) -> DataFrame:
    """(change_id, unit) of the renames that form a circle; ``unit`` is its smallest change_id.

    Only names that exactly one rename gives up and exactly one takes lie on a circle here. Each step
    doubles how far a rename sees along the names that follow; what sees an end is on no circle.
    """
    renames = changes.where(
        (F.col("op") == "UPDATE")
        & (F.col("new_schema_name") != F.col("target_schema_name"))
        & (F.col("new_schema_name") != "")
    ).select("db_id", "change_id", F.col("target_schema_name").alias("at"), F.col("new_schema_name").alias("to"))
    once = []
    for end in ("at", "to"):
        counts = renames.groupBy("db_id", end).agg(F.count(F.lit(1)).alias("_n"))
        once.append(counts.where("_n = 1").drop("_n"))
    links = renames.join(once[0], ["db_id", "at"], "left_semi").join(once[1], ["db_id", "to"], "left_semi")
    links = cut_lineage(links.withColumn("unit", F.col("change_id")))
    state = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("change_id", "unit"))).first())
        if now == state or not now[0]:
            return links.select("change_id", "unit")
        state = now
        ahead = links.select("db_id", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("unit").alias("_unit"))
        links = links.join(ahead, ["db_id", "to"]).select(
            "db_id", "change_id", "at", F.col("_to").alias("to"), F.least("unit", "_unit").alias("unit")
        )
        links = cut_lineage(links)


def _as_one(reviewed: DataFrame, units: DataFrame) -> DataFrame:
    """Circles pass if nothing but names taken inside the circle speaks against any of their renames."""
    rows = reviewed.join(units.select("change_id", "unit", "members"), "change_id")
    old = rows.where("members > 1").select("unit", "db_id", F.col("old_name").alias("schema_name")).distinct()
    rows = rows.join(old.withColumn("_inside", F.lit(True)), ["unit", "db_id", "schema_name"], "left")
    clean = F.col("_inside") & (F.size(F.array_except("codes", F.array(F.lit("TB10")))) == 0) & ~F.col("asks_drop")
    whole = rows.where("members > 1").groupBy("unit").agg(
        (F.bool_and(F.coalesce(clean, F.lit(False))) & (F.count_distinct("schema_name") == F.max("members"))).alias("_pass")
    )
    rows = rows.join(whole, "unit", "left")
    refused = F.when(F.size("codes") == 0, F.array(F.lit("TB10"))).otherwise(F.col("codes"))
    codes = F.when(F.col("_pass").isNull(), F.col("codes")).when(F.col("_pass"), F.array().cast("array<string>"))
    rows = rows.withColumn("codes", codes.otherwise(refused))
    return rows.select(*reviewed.columns)


def replay_changes(
    changes: DataFrame,
    registry: DataFrame,
    namespaces: DataFrame,
    review: Callable[[DataFrame, DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """The registry after all edits, and (change_id, round, codes, asks_drop) of each edit.

    ``review(changes, registry)`` applies the rules, as :func:`~grantlens.operators.registry.review_changes`
    with its other tables given. Edits name their row by ``target_schema_name``, in the order of their
    unique ``change_id``; refused ones change nothing, so those after them are still reviewed. They are
    edits by hand: marks of ``trusted`` are dropped. A circle of renames is accepted or refused as a whole.

    Rounds are as many as the longest row of edits on one name. A round reads only the rows whose names
    some edit mentions and the edits that wait. Null names take no part in circles and wait for nothing
    but their row; edits of an empty change set leave the registry as it is.
    """
    spark = changes.sparkSession
    edits = changes.drop("trusted")
    circles = rename_circles(edits)
    edits = edits.join(circles, "change_id", "left").withColumn("unit", F.coalesce("unit", "change_id"))
    sizes = edits.groupBy("unit").agg(F.count(F.lit(1)).alias("members"))
    pending = cut_lineage(edits.join(sizes, "unit"))

    names = F.array_distinct(F.array_compact(F.array(*[base_name(F.col(c)) for c in ("target_schema_name", "new_schema_name")])))
    touched = pending.select("db_id", F.explode(names).alias("_base")).distinct()
    based = registry.withColumn("_base", base_name(F.col("schema_name")))
    untouched = based.join(touched, ["db_id", "_base"], "left_anti").select(*registry.columns)
    rows = cut_lineage(based.join(touched, ["db_id", "_base"], "left_semi").select(*registry.columns))

    folder, turn = f"{shared_folder(spark)}/replay/{uuid.uuid4().hex}", 0
    answer = "change_id long, codes array<string>, asks_drop boolean"
    spark.createDataFrame([], answer).write.parquet(f"{folder}/round=0")
    while not pending.isEmpty():
        turn += 1
        keys = pending.select("unit", "db_id", F.explode(names).alias("_base")).distinct()
        first = keys.groupBy("db_id", "_base").agg(F.min("unit").alias("_first"))
        waiting = keys.join(first, ["db_id", "_base"]).where("unit > _first").select("unit").distinct()
        marked = pending.join(waiting.withColumn("_waits", F.lit(True)), "unit", "left")
        marked = cut_lineage(marked.withColumn("_waits", F.coalesce("_waits", F.lit(False))))
        ready, pending = marked.where("NOT _waits").drop("_waits"), marked.where("_waits").drop("_waits")
        reviewed = cut_lineage(_as_one(review(ready.drop("unit", "members"), rows), ready))
        reviewed.select(*[F.col(c) for c in ("change_id", "codes", "asks_drop")]).write.parquet(f"{folder}/round={turn}")
        rows = cut_lineage(apply_registry_changes(rows, reviewed, namespaces))
    answers = spark.read.schema(f"{answer}, round int").parquet(folder)
    return untouched.unionByName(rows), answers.select("change_id", "round", "codes", "asks_drop")
