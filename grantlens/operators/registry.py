"""Review of edits to the registry: normalisation, alignment, and rules that may refuse them.

A change set is a table of edits (change_id, db_id, op, target_schema_name, actor_oid, new_*
columns). The old row is the registry row of that name in the database, created or not; an UPDATE
without one is an INSERT. Edits may name their row by ``target_schema_oid`` instead, which reaches
created schemas only. Optional columns: ``trusted`` (the edit reports a real DDL event: its ids are kept) and
``is_exit`` (a deletion asked for by deregistration). Everything is a column expression over the
one joined row, so a change set of any size is reviewed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.model import PUBLIC_OID
from grantlens.operators.roles import ADMIN_ROLE, FUNCTIONS, Reach, as_reach, has_named_role, has_roles, role_oid_of
from grantlens.scaling import attach, computed, cut_lineage

_KEPT = ("change_id", "db_id", "op", "actor_oid")


def _empty_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def _target(changes: DataFrame) -> list[str]:
    """What tells the row an edit is about."""
    return ["db_id", "target_schema_name"] if "target_schema_name" in changes.columns else ["target_schema_oid"]


def latest_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a change set into the last edit of each schema and the edits it supersedes."""
    last = changes.groupBy(*_target(changes)).agg(F.max("change_id").alias("change_id"))
    keys = [*_target(changes), "change_id"]
    return changes.join(last, keys, "left_semi"), changes.join(last, keys, "left_anti")


def normalise_changes(
    changes: DataFrame, registry: DataFrame, roles: DataFrame, namespaces: DataFrame,
    admin: str = ADMIN_ROLE,
) -> DataFrame:
    """Defaults, empty strings, ids and role names of each edit, next to its old row.

    Ids typed by hand give way to the old ones (none for an INSERT), and are cleared with their
    function or with the schema. Unchanged functions of a created schema follow their role: a
    renamed one gets its new name, a dropped producer gives way to the schema's owner, a dropped
    editor or reader is cleared; ``clean_*`` tells these from real edits.
    """
    target = _target(changes)
    row_of = {"db_id": "db_id", "target_schema_name": "schema_name", "target_schema_oid": "schema_oid"}
    old = registry.select(
        *[F.col(row_of[c]).alias(c) for c in target],
        F.col("schema_name").alias("old_name"),
        F.col("block").alias("old_block"),
        F.col("in_nomenclature").alias("old_nomenclature"),
        F.col("is_created").alias("old_created"),
        F.col("schema_oid").alias("old_schema_oid"),
        *[F.col(c).alias(f"old_{c}") for f in FUNCTIONS for c in (f, f"{f}_oid")],
    ).where(F.col(target[-1]).isNotNull())
    held = attach(changes, old, target, "left")
    known = F.col("old_name").isNotNull()
    op = F.when((F.col("op") == "UPDATE") & ~known, F.lit("INSERT")).otherwise(F.col("op"))
    trusted = F.col("trusted") if "trusted" in changes.columns else F.lit(False)
    exits = F.col("is_exit") if "is_exit" in changes.columns else F.lit(False)
    held = held.withColumn("op", op)
    is_insert = F.col("op") == "INSERT"
    old_columns = [c for c in held.columns if c.startswith("old_")]
    held = held.select(
        *_KEPT,
        F.coalesce(trusted, F.lit(False)).alias("trusted"),
        F.coalesce(exits, F.lit(False)).alias("is_exit"),
        # an INSERT has no old row even if its target is known
        *[F.when(~is_insert, F.col(c)).alias(c) for c in old_columns],
        F.col("new_schema_name").alias("raw_name"),
        F.col("new_block").alias("raw_block"),
        _empty_to_null(F.col("new_schema_name")).alias("schema_name"),
        _empty_to_null(F.col("new_block")).alias("block"),
        F.coalesce(_empty_to_null(F.col("new_producer")), F.lit(admin)).alias("producer"),
        _empty_to_null(F.col("new_editor")).alias("editor"),
        _empty_to_null(F.col("new_reader")).alias("reader"),
        F.coalesce(F.col("new_created"), F.lit(False)).alias("is_created"),
        F.coalesce(F.col("new_nomenclature"), F.lit(False)).alias("in_nomenclature"),
        F.col("new_schema_oid"),
    )
    given = F.when(F.col("trusted"), F.col("new_schema_oid"))
    kept = F.when(F.col("op") != "INSERT", F.col("old_schema_oid"))
    held = held.withColumn(
        "schema_oid", F.when(F.col("is_created"), F.coalesce(given, kept)).cast("bigint")
    ).drop("new_schema_oid")
    for f in FUNCTIONS:
        held = held.withColumn(
            f"{f}_oid",
            F.when(F.col("is_created") & F.col(f).isNotNull() & ~is_insert, F.col(f"old_{f}_oid")).cast("bigint"),
        )
    # functions that did not change follow their role
    owners = namespaces.select(F.col("schema_oid"), F.col("owner_oid").alias("_owner_oid"))
    held = attach(held, owners, "schema_oid", "left")
    owner_names = roles.select(F.col("role_oid").alias("_owner_oid"), F.col("role_name").alias("_owner"))
    held = attach(held, owner_names, "_owner_oid", "left")
    lasting = (F.col("op") == "UPDATE") & F.col("is_created") & F.coalesce(F.col("old_created"), F.lit(False))
    for f in FUNCTIONS:
        now = roles.select(F.col("role_oid").alias(f"{f}_oid"), F.col("role_name").alias("_now"))
        held = attach(held, now, f"{f}_oid", "left")
        same = lasting & F.coalesce(F.col(f) == F.col(f"old_{f}"), F.lit(False))
        if f != "producer":
            same = same & (F.col(f) != "public")
        gone, renamed = same & F.col("_now").isNull(), same & (F.col("_now") != F.col(f))
        fallback = (F.col("_owner"), F.col("_owner_oid")) if f == "producer" else (F.lit(None), F.lit(None))
        held = held.select(
            *[c for c in held.columns if c not in (f, f"{f}_oid", "_now")],
            F.when(gone, fallback[0]).when(renamed, F.col("_now")).otherwise(F.col(f)).alias(f),
            F.when(gone, fallback[1]).otherwise(F.col(f"{f}_oid")).cast("bigint").alias(f"{f}_oid"),
            F.coalesce(gone | renamed, F.lit(False)).alias(f"clean_{f}"),
        )
    return held.drop("_owner", "_owner_oid")


def align_block_and_name(normalised: DataFrame) -> DataFrame:
    """Make block and schema prefix agree; ``align_code`` is TB14-TB16 for an invalid block.

    Moves to and from the trash (block d) come first: the prefix d_ never stays in a name.
    """
    name, block = F.col("schema_name"), F.col("block")
    old_name, old_block = F.col("old_name"), F.col("old_block")
    is_update = F.col("op") == "UPDATE"
    rest = F.substring(name, 3, 1 << 20)

    def under(prefix: Column) -> Column:
        return F.concat(prefix, F.lit("_"), rest)

    to_trash, no_block, was_trash = block == "d", block.isNull(), old_block == "d"
    had_block = old_block.isNotNull() & ~was_trash
    on_update = (
        F.when((to_trash | no_block) & had_block, under(old_block))
        .when(to_trash & was_trash & old_name.rlike("^[a-ce-z]_"), under(F.substring(old_name, 1, 1)))
        .when(to_trash & was_trash & ~old_name.rlike("^[a-z]_"), rest)
        .when((no_block | to_trash) & old_block.isNull(), rest)
        .when((block == old_block) & (block != "d"), under(old_block))
    )
    on_insert = F.when(no_block | to_trash, rest)
    trashed = F.when(
        name.rlike("^d_") & (F.col("op") != "DELETE"),
        F.when(is_update, on_update).otherwise(on_insert),
    )
    step = computed(normalised, _trashed=trashed)
    step = step.withColumn("_name", F.coalesce("_trashed", "schema_name")).withColumn(
        "_block", F.when(F.col("_trashed").isNotNull(), F.lit("d")).otherwise(block)
    )
    step = step.drop("schema_name", "block", "_trashed")
    name, block = F.col("_name"), F.col("_block")
    letter = F.when(name.rlike("^[a-z]_"), F.substring(name, 1, 1))
    bare = F.regexp_replace(name, "^([a-z])?_", "")
    valid = block.rlike(r"^[a-z]\z")
    same_block = F.coalesce(block == old_block, F.lit(False))
    unset = block.isNull() & name.rlike("^[a-z]_")
    dropped_prefix = unset & is_update & old_block.isNotNull() & old_name.rlike("^[a-z]_") & (
        F.substring(name, 1, 1) == F.substring(old_name, 1, 1)
    )
    apart = ~name.startswith(F.concat(block, F.lit("_"))) & (block != "d")
    prefixed = name.rlike("^([a-z])?_")
    follow_name = apart & prefixed & is_update & (name != old_name) & same_block
    leave_block = apart & ~prefixed & valid & is_update & same_block & old_name.rlike("^([a-z])?_")
    refused = apart & ~valid & ~F.coalesce(follow_name, F.lit(False))
    edits = F.col("op") != "DELETE"
    aligned = computed(
        step,
        schema_name=F.when(~edits, name)
        .when(dropped_prefix, F.substring(name, 3, 1 << 20))
        .when(refused | follow_name | leave_block, name)
        .when(apart & prefixed, F.concat(block, F.lit("_"), bare))
        .when(apart, F.concat(block, F.lit("_"), name))
        .otherwise(name),
        block=F.when(~edits, block)
        .when(dropped_prefix, F.lit(None))
        .when(unset, letter)
        .when(follow_name, letter)
        .when(leave_block, F.lit(None))
        .otherwise(block),
        align_code=F.when(
            edits & refused,
            F.when(prefixed & is_update, F.lit("TB14")).when(prefixed, F.lit("TB15")).otherwise(F.lit("TB16")),
        ),
    )
    return aligned.drop("_name", "_block")


def block_name_violations(rows: DataFrame) -> DataFrame:
    """Rows whose block is neither empty, nor the trash, nor the lower-case prefix of the name."""
    block, name = F.col("block"), F.col("schema_name")
    fits = (block == "d") | (block.rlike(r"^[a-z]\z") & name.startswith(F.concat(block, F.lit("_"))))
    return rows.where(block.isNotNull() & ~fits)


def repeated_roles() -> Column:
    """True when two functions go to one role; vacant functions never repeat."""
    p, e, l = (F.col(f"{f}_oid") for f in FUNCTIONS)
    return F.coalesce(l == p, F.lit(False)) | F.coalesce(e == p, F.lit(False)) | F.coalesce(l == e, F.lit(False))


def role_repetition(rows: DataFrame) -> DataFrame:
    """Rows in which producer, editor and reader are not pairwise distinct (TB13)."""
    return rows.where(repeated_roles())


def registry_duplicates(rows: DataFrame) -> DataFrame:
    """Schema names and schema ids held by more than one row, with their number.

    A count per key, merged on the map side: copies of one key never meet in a task.
    """
    names = rows.groupBy("db_id", F.col("schema_name").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    ids = rows.where(F.col("schema_oid").isNotNull()).groupBy(
        "db_id", F.col("schema_oid").cast("string").alias("key")
    ).agg(F.count(F.lit(1)).alias("copies"))
    return names.withColumn("kind", F.lit("name")).unionByName(ids.withColumn("kind", F.lit("oid"))).where(
        F.col("copies") > 1
    )


def resolve_functions(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Ids of the functions by name, on rows of created schemas (public: 0)."""
    for f in FUNCTIONS:
        by_name = roles.select(F.col("role_name").alias(f), F.col("role_oid").alias("_named"))
        rows = attach(rows.drop(f"{f}_oid"), by_name, f, "left")
        oid = F.when(F.col(f) == "public", F.lit(PUBLIC_OID)).otherwise(F.col("_named"))
        rows = rows.withColumn(f"{f}_oid", F.when(F.col("is_created"), oid).cast("bigint")).drop("_named")
    return rows


def _named_schema(rows: DataFrame, namespaces: DataFrame, column: str, into: str) -> DataFrame:
    real = namespaces.select("db_id", F.col("schema_name").alias(column), F.lit(True).alias("_there"))
    joined = attach(rows, real, ["db_id", column], "left")
    return joined.withColumn(into, F.coalesce(F.col("_there"), F.lit(False))).drop("_there")


def _creators_reached(
    rows: DataFrame, creators: DataFrame, roles: DataFrame, closure: DataFrame | Reach
) -> DataFrame:
    """Flag actors who may create schemas in the database of their edit.

    Creators are reduced to (actor, database) before they meet the edits, so neither a busy actor
    nor a database with many creators multiplies rows.
    """
    actors = rows.select(F.col("actor_oid").alias("member_oid")).distinct()
    creators = creators.select("db_id", "role_oid").distinct()
    reach = as_reach(closure).holders(creators.select("role_oid"))
    able = (
        reach.join(actors, "member_oid", "left_semi")
        .join(creators, "role_oid")
        .select(F.col("member_oid").alias("actor_oid"), "db_id")
        .distinct()
        .withColumn("_able", F.lit(True))
    )
    supers = roles.where("is_super").select(F.col("role_oid").alias("actor_oid"), F.lit(True).alias("_super"))
    joined = attach(rows.join(able, ["actor_oid", "db_id"], "left"), supers, "actor_oid")
    return joined.withColumn("may_create", F.coalesce(F.col("_able"), F.col("_super"), F.lit(False))).drop(
        "_able", "_super"
    )


def review_changes(
    changes: DataFrame,
    registry: DataFrame,
    roles: DataFrame,
    namespaces: DataFrame,
    creators: DataFrame,
    usage: DataFrame | Reach,
    member: DataFrame | Reach,
    admin: str = ADMIN_ROLE,
) -> DataFrame:
    """Normalised and aligned edits with ``codes``, the rules they break, in order.

    ``creators``: (db_id, role_oid) that may create schemas; ``usage`` and ``member``: closures.
    An edit is accepted if ``codes`` is empty; ``asks_drop`` marks the removal of a schema from
    the trash, which is a request to drop it and changes no row.
    """
    # written in between: in one plan the driver would hold all the tables that some twenty joins broadcast
    rows = cut_lineage(align_block_and_name(normalise_changes(changes, registry, roles, namespaces, admin)))
    rows = _creators_reached(rows, creators, roles, usage)
    rows = has_named_role(rows, member, roles, "actor_oid", admin, "is_admin")
    for column, into in (("schema_name", "exists"), ("raw_name", "raw_exists"), ("old_name", "old_exists")):
        rows = _named_schema(rows, namespaces, column, into)
    for side in ("producer", "old_producer"):
        named = roles.select(
            F.col("role_name").alias(side), F.col("role_oid").alias(f"_{side}"), F.col("is_super").alias("_s")
        )
        rows = attach(rows, named, side, "left")
        rows = rows.withColumn(f"super_{side}", F.coalesce(F.col("_s"), F.lit(False))).drop("_s")
    probes = {"_producer": "has_producer", "_old_producer": "has_old_producer", "old_producer_oid": "has_old_owner"}
    rows = has_roles(cut_lineage(rows), usage, roles, "actor_oid", probes).drop("_producer", "_old_producer")
    rows = cut_lineage(rows)
    listed = registry.select("db_id", "schema_name", F.lit(True).alias("_listed")).distinct()
    rows = attach(rows, listed, ["db_id", "schema_name"], "left")
    by_id = registry.where(F.col("schema_oid").isNotNull()).select("schema_oid", F.lit(True).alias("_held")).distinct()
    rows = attach(rows, by_id, "schema_oid", "left")
    rows = resolve_functions(rows, roles)

    insert, update, delete = (F.col("op") == o for o in ("INSERT", "UPDATE", "DELETE"))
    edits = ~delete
    created, was_created = F.col("is_created"), F.coalesce(F.col("old_created"), F.lit(False))
    from_trash = F.coalesce(F.col("old_block") == "d", F.lit(False)) & ~F.col("trusted") & F.col("old_exists")
    uncreated = update & was_created & ~created
    drop = uncreated & from_trash

    def changed(a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))

    taxonomy_edit = (
        (F.coalesce(F.col("old_nomenclature"), F.lit(False)) != F.col("in_nomenclature"))
        | changed(F.col("old_name"), F.col("raw_name"))
        | changed(F.col("old_block"), F.col("raw_block"))
    )
    in_taxonomy = F.coalesce(F.col("old_nomenclature"), F.lit(False)) | F.col("in_nomenclature")
    new_name = F.coalesce(F.col("schema_name") != F.col("old_name"), F.lit(False))
    new_producer = (F.col("producer") != F.col("old_producer")) & ~F.col("clean_producer")
    function_edit = (
        new_name
        | F.coalesce(new_producer, F.lit(False))
        | (changed(F.col("editor"), F.col("old_editor")) & ~F.col("clean_editor"))
        | (changed(F.col("reader"), F.col("old_reader")) & ~F.col("clean_reader"))
    )
    listed, held = F.coalesce("_listed", F.lit(False)), F.coalesce("_held", F.lit(False))
    new_oid = ~F.col("schema_oid").eqNullSafe(F.col("old_schema_oid"))
    rules = (
        ("NO_ROW", delete & F.col("old_name").isNull()),
        ("TB1", insert & ~F.col("may_create")),
        ("TB2", delete & was_created & ~F.col("is_exit")),
        ("TB3", delete & F.col("old_nomenclature") & ~F.col("is_exit")),
        ("TB26", delete & F.col("old_nomenclature") & F.col("is_exit")),
        ("TB23", drop & ~F.col("has_old_owner")),
        ("TB4", uncreated & ~from_trash & F.col("raw_exists")),
        ("TB18", update & in_taxonomy & taxonomy_edit & ~F.col("is_admin")),
        ("TB19", insert & F.col("in_nomenclature") & ~F.col("is_admin")),
        ("TB8", edits & F.col("schema_name").isNull()),
        ("TB11", insert & held),
        ("TB12", update & new_oid & held),
        ("TB13", edits & repeated_roles()),
        ("TB14", F.col("align_code") == "TB14"),
        ("TB15", F.col("align_code") == "TB15"),
        ("TB16", F.col("align_code") == "TB16"),
        ("TB9", insert & listed),
        ("TB10", update & new_name & listed),
        ("TB20", update & was_created & F.col("super_old_producer") & function_edit & ~F.col("has_old_producer")),
        ("TB21", update & created & ~was_created & F.col("super_producer") & ~F.col("has_producer")),
        ("TB24", update & created & F.col("super_producer") & new_producer & ~F.col("has_producer")),
        ("TB22", insert & created & F.col("super_producer") & ~F.col("exists") & ~F.col("has_producer")),
        ("TB25", insert & F.col("super_producer") & F.col("exists") & ~F.col("has_producer")),
    )
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    asks = drop & F.col("has_old_owner")
    return computed(rows, codes=codes, asks_drop=asks).drop("_listed", "_held")


# Which rules belong to which check.
CHECKS = {
    "registry_duplicates": ("TB9", "TB10", "TB11", "TB12"),
    "role_repetition": ("TB13",),
    "align_block_and_name": ("TB14", "TB15", "TB16"),
    "deletion_rules": ("NO_ROW", "TB2", "TB3", "TB26", "TB4", "TB23"),
    "taxonomy_lock": ("TB1", "TB18", "TB19"),
    "superuser_rules": ("TB20", "TB21", "TB22", "TB24", "TB25"),
    "missing_name": ("TB8",),
}


def violations(reviewed: DataFrame, check: str | None = None) -> DataFrame:
    """(change_id, op, schema_name, code) for every broken rule, of one check or of all."""
    rows = reviewed.select("change_id", "op", "schema_name", F.explode("codes").alias("code"))
    return rows if check is None else rows.where(F.col("code").isin(*CHECKS[check]))


def trash_transitions(aligned: DataFrame) -> DataFrame:
    """Edits that put a created schema into the trash, or take it out."""
    created = F.col("is_created")
    into = created & (F.col("block") == "d")
    was = F.coalesce(F.col("old_block") == "d", F.lit(False))
    fresh = ~F.coalesce(F.col("old_created"), F.lit(False))
    move = (
        F.when((F.col("op") == "INSERT") & into, F.lit("enter"))
        .when((F.col("op") == "UPDATE") & into & (~was | fresh), F.lit("enter"))
        .when((F.col("op") == "UPDATE") & created & was & (F.coalesce(F.col("block"), F.lit("")) != "d"), F.lit("leave"))
    )
    return aligned.select("change_id", "op", "schema_name", "old_name", move.alias("transition")).where(
        F.col("transition").isNotNull()
    )


def accepted_changes(reviewed: DataFrame) -> DataFrame:
    """Edits that break no rule, one per resulting schema name: the first one keeps the name.

    Edits of a batch do not see each other; of several that lead to the same name only the
    lowest change_id is accepted, as if the others had come later.
    """
    valid = reviewed.where((F.size("codes") == 0) & ~F.col("asks_drop"))
    named = valid.where(F.col("op") != "DELETE")
    first = named.groupBy("db_id", "schema_name").agg(F.min("change_id").alias("change_id"))
    kept = attach(named, first, ["db_id", "schema_name", "change_id"], "left_semi")
    return kept.unionByName(valid.where(F.col("op") == "DELETE"))


def apply_registry_changes(
    registry: DataFrame, reviewed: DataFrame, namespaces: DataFrame
) -> DataFrame:
    """The next version of the registry: untouched rows, updated rows, inserted rows.

    Created rows take the id of the real schema of their name when there is one; ids of roles
    come from the review.
    """
    reviewed = cut_lineage(reviewed)
    accepted = accepted_changes(reviewed)
    touched = accepted.where(F.col("old_name").isNotNull()).select("db_id", F.col("old_name").alias("schema_name"))
    untouched = attach(registry, touched, ["db_id", "schema_name"], "left_anti")
    levels = registry.select("db_id", F.col("schema_name").alias("old_name"), "level1", "level2")
    edited = attach(accepted.where(F.col("op") != "DELETE"), levels, ["db_id", "old_name"], "left")
    real = namespaces.select("db_id", "schema_name", F.col("schema_oid").alias("_real"))
    edited = attach(edited, real, ["db_id", "schema_name"], "left")
    edited = edited.withColumn(
        "schema_oid", F.when(F.col("is_created"), F.coalesce(F.col("schema_oid"), F.col("_real")))
    )
    return untouched.unionByName(edited.select(*registry.columns))
