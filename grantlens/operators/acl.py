"""Privileges held on objects, computed for all roles at once."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.privileges import code_mask, expected_mask, explode_mask
from grantlens.functions.sqltext import (
    alter_class,
    grant_class,
    grant_command,
    object_ref,
    owner_command,
    quote_ident,
    role_ref,
)
from grantlens.model import (
    OBJECT_TYPES,
    PRIVILEGES,
    PUBLIC_OBJECT_CLASSES,
    PUBLIC_OID,
    RELATION_KINDS,
    RIGHTS_KINDS,
)
from grantlens.scaling import attach

OBJECT_KEY = ["db_id", "schema_oid", "obj_kind", "obj_oid", "column_name"]
_ITEM = r'\A("(?:[^"]|"")*"|[^=]*)=([A-Za-z*]*)(?:/(.*))?\z'


def _privilege_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(PRIVILEGES)])
    return F.try_element_at(names, code)


def explode_acl(df: DataFrame, acl: str = "acl") -> DataFrame:
    """One row per (grantor, grantee, privilege, grantable) of an ACL array.

    The array holds either structs of those four fields or text items
    ``grantee=codes/grantor``, where ``*`` after a code stands for the grant option and an empty
    grantee for public (0). A NULL array gives no row. Text items keep role names as written.
    """
    element = df.schema[acl].dataType.elementType.typeName()
    if element == "struct":
        return df.select(*[c for c in df.columns if c != acl], F.inline(F.col(acl)))
    rest = [c for c in df.columns if c != acl]
    items = df.select(*rest, F.explode(F.col(acl)).alias("_item"))
    parts = items.select(
        *rest,
        F.regexp_extract("_item", _ITEM, 3).alias("grantor"),
        F.regexp_extract("_item", _ITEM, 1).alias("grantee"),
        F.explode(
            F.regexp_extract_all(F.regexp_extract("_item", _ITEM, 2), F.lit(r"[A-Za-z]\*?"), F.lit(0))
        ).alias("_code"),
    )
    return (
        parts.withColumn("grantee", F.when(F.col("grantee") == "", F.lit("0")).otherwise(F.col("grantee")))
        .withColumn("privilege", _privilege_name(F.substring("_code", 1, 1)))
        .withColumn("grantable", F.length("_code") == 2)
        .where(F.col("privilege").isNotNull())
        .drop("_code")
    )


def _merged(acl: DataFrame) -> DataFrame:
    grouped = acl.groupBy(*OBJECT_KEY, F.col("grantee_oid").alias("role_oid"))
    return explode_mask(grouped.agg(F.bit_or(code_mask(F.col("codes"))).alias("_mask")), "_mask")


def role_privileges(all_acl: DataFrame) -> DataFrame:
    """What each role was granted on objects it does not own (on columns: whoever owns them)."""
    granted = all_acl.where(
        (F.col("grantee_oid") != PUBLIC_OID)
        & ((F.col("obj_kind") == "A") | (F.col("grantee_oid") != F.col("owner_oid")))
    )
    return _merged(granted).withColumn("verb", F.lit("GRANT"))


def _spelled(rows: DataFrame, spelled: bool) -> DataFrame:
    rows = rows.where(F.col("_mask") != 0)
    return explode_mask(rows, "_mask") if spelled else rows


def owner_missing_privileges(all_objects: DataFrame, all_acl: DataFrame, spelled: bool = True) -> DataFrame:
    """Default privileges that owners lost, on objects that have an ACL.

    Objects and their owners' entries meet in one aggregation by object, so the two tables are
    shuffled once and never joined. Without ``spelled`` see :func:`render_commands`.
    """
    expected = all_objects.where(F.col("has_acl") & F.col("obj_kind").isin(*RIGHTS_KINDS)).select(
        "db_id", "schema_oid", "obj_kind", "obj_oid",
        F.col("owner_oid").alias("role_oid"),
        expected_mask(F.col("obj_kind"), "owner").alias("_expected"),
        F.lit(0).alias("_held"),
    )
    held = all_acl.where(F.col("grantee_oid") == F.col("owner_oid")).select(
        "db_id", "schema_oid", "obj_kind", "obj_oid",
        F.col("grantee_oid").alias("role_oid"),
        F.lit(0).alias("_expected"),
        code_mask(F.col("codes")).alias("_held"),
    )
    merged = (
        expected.unionByName(held)
        .groupBy("db_id", "schema_oid", "obj_kind", "obj_oid", "role_oid")
        .agg(F.bit_or("_expected").alias("_expected"), F.bit_or("_held").alias("_held"))
    )
    lost = merged.select(
        "db_id", "schema_oid", "obj_kind", "obj_oid",
        F.lit(None).cast("string").alias("column_name"),
        "role_oid",
        F.col("_expected").bitwiseAND(F.bitwise_not(F.col("_held"))).alias("_mask"),
    )
    return _spelled(lost, spelled).withColumn("verb", F.lit("REVOKE"))


def public_privileges(all_acl: DataFrame) -> DataFrame:
    """What public was granted on schemas, relations, sequences and columns.

    Routines and types are left out: public holds rights on them by default.
    """
    kinds = ("N", "S", "A", *RELATION_KINDS)
    granted = all_acl.where((F.col("grantee_oid") == PUBLIC_OID) & F.col("obj_kind").isin(*kinds))
    return _merged(granted).withColumn("verb", F.lit("GRANT"))


def all_privileges(
    all_objects: DataFrame, all_acl: DataFrame, with_public: bool = False, spelled: bool = True
) -> DataFrame:
    """Commands that describe the rights of every role: grants, and revocations of owners.

    The same rows as :func:`role_privileges` and :func:`owner_missing_privileges` (and
    :func:`public_privileges`) together, from one aggregation by (object, role) instead of three.
    Without ``spelled`` a row carries a ``_mask`` of privileges for :func:`render_commands`.
    """
    kind, to_public = F.col("obj_kind"), F.col("grantee_oid") == PUBLIC_OID
    in_scope = kind.isin("N", "S", "A", *RELATION_KINDS) if with_public else F.lit(False)
    mask = code_mask(F.col("codes"))
    own = F.coalesce(F.col("grantee_oid") == F.col("owner_oid"), F.lit(False))
    entries = all_acl.where(~to_public | in_scope).select(
        *OBJECT_KEY, F.col("grantee_oid").alias("role_oid"),
        F.when(own, F.lit(0)).otherwise(mask).alias("_granted"),
        F.when(own, mask).otherwise(F.lit(0)).alias("_held"),
        F.lit(0).alias("_expected"),
    )
    owners = all_objects.where(F.col("has_acl") & kind.isin(*RIGHTS_KINDS)).select(
        "db_id", "schema_oid", "obj_kind", "obj_oid",
        F.lit(None).cast("string").alias("column_name"),
        F.col("owner_oid").alias("role_oid"),
        F.lit(0).alias("_granted"), F.lit(0).alias("_held"),
        expected_mask(kind, "owner").alias("_expected"),
    )
    merged = (
        entries.unionByName(owners)
        .groupBy(*OBJECT_KEY, "role_oid")
        .agg(*[F.bit_or(c).alias(c) for c in ("_granted", "_held", "_expected")])
    )
    lost = F.col("_expected").bitwiseAND(F.bitwise_not(F.col("_held")))
    sides = F.array(
        F.struct(F.lit("GRANT").alias("verb"), F.col("_granted").alias("_mask")),
        F.struct(F.lit("REVOKE").alias("verb"), lost.alias("_mask")),
    )
    rows = merged.where((F.col("_granted") != 0) | (lost != 0)).select(
        *OBJECT_KEY, "role_oid", F.inline(sides)
    )
    return _spelled(rows, spelled)


def _requested(requests: DataFrame, classes: tuple[str, ...] | None, error: str):
    """Split requests into (obj_oid, class) to look up and error rows for other types."""
    wanted = [(t, c) for t, c in OBJECT_TYPES.items() if classes is None or c in classes]
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(wanted)])
    typed = requests.withColumn("_class", F.try_element_at(known, F.col("obj_type")))
    rejected = typed.where(F.col("_class").isNull()).select(
        "obj_oid", "obj_type", F.lit(error).alias("error")
    )
    return typed.where(F.col("_class").isNotNull()).select("obj_oid", "_class").distinct(), rejected


def _answers(found: DataFrame, rejected: DataFrame) -> DataFrame:
    columns = ["obj_oid", "column_name", "role_oid", "verb", "privilege"]
    errors = rejected.select(
        "obj_oid",
        F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("bigint").alias("role_oid"),
        F.lit(None).cast("string").alias("verb"),
        F.lit(None).cast("string").alias("privilege"),
        "error",
    )
    return found.select(*columns, F.lit(None).cast("string").alias("error")).unionByName(errors)


def object_privileges(all_objects: DataFrame, all_acl: DataFrame, requests: DataFrame) -> DataFrame:
    """Rights of every role on the requested (obj_oid, obj_type); other types give FSR0."""
    asked, rejected = _requested(requests, None, "FSR0")
    klass = grant_class(F.col("obj_kind")).alias("_class")
    keys = ["obj_oid", "_class"]
    objects = all_objects.where(F.col("obj_kind") != "N").withColumn("_class", klass)
    acl = all_acl.where(F.col("obj_kind") != "N").withColumn("_class", klass)
    found = all_privileges(
        attach(objects, asked, keys, "left_semi"),
        attach(acl, asked, keys, "left_semi"),
    )
    return _answers(found, rejected)


def object_public_privileges(all_acl: DataFrame, requests: DataFrame) -> DataFrame:
    """Rights of public on the requested relations and sequences; other types give FSP0."""
    asked, rejected = _requested(requests, PUBLIC_OBJECT_CLASSES, "FSP0")
    acl = all_acl.where((F.col("obj_kind") != "N") & (F.col("grantee_oid") == PUBLIC_OID))
    acl = acl.withColumn("_class", grant_class(F.col("obj_kind")))
    wanted = attach(acl, asked, ["obj_oid", "_class"], "left_semi")
    return _answers(public_privileges(wanted), rejected)


def object_names(all_objects: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(obj_kind, obj_oid) → quoted schema and object name; no schema when it is not in the snapshot."""
    named = namespaces.select("schema_oid", quote_ident(F.col("schema_name")).alias("schema_ident"))
    objects = all_objects.select(
        "schema_oid", "obj_kind", "obj_oid", quote_ident(F.col("obj_name")).alias("obj_ident")
    )
    return attach(objects, named, "schema_oid", "left")


def role_idents(roles: DataFrame, into: str = "_role") -> DataFrame:
    """role_oid → quoted role name."""
    return roles.select("role_oid", quote_ident(F.col("role_name")).alias(into))


def render_commands(
    rows: DataFrame,
    all_objects: DataFrame,
    namespaces: DataFrame,
    roles: DataFrame,
    server_version: int = 150000,
) -> DataFrame:
    """Add object_class and the command text of each row; NULL when a part cannot be named.

    Rows carry obj_kind, obj_oid, column_name, role_oid, privilege and a verb: GRANT, REVOKE or
    OWNER. With a ``_mask`` in place of the privilege they are spelled out after the joins, a row
    for each. An ``in_schema_oid`` column, where set, names the schema the object will be in by then. Entries of columns are named after their table, whose kind they do not know, so both
    sides meet on the class of objects.
    """
    kind = F.col("obj_kind")
    family = F.coalesce(grant_class(kind), kind)
    names = object_names(all_objects, namespaces).select(
        "obj_oid", family.alias("_family"), F.col("schema_ident").alias("_schema"), F.col("obj_ident").alias("_name")
    )
    named = rows.withColumn("_family", family).join(names, ["_family", "obj_oid"], "left")
    named = attach(named, role_idents(roles), "role_oid", "left")
    if "in_schema_oid" in rows.columns:
        later = namespaces.select(
            F.col("schema_oid").alias("in_schema_oid"), quote_ident(F.col("schema_name")).alias("_later")
        )
        named = attach(named, later, "in_schema_oid", "left")
        named = named.withColumn("_schema", F.coalesce("_later", "_schema")).drop("_later")
    if "_mask" in rows.columns:
        named = explode_mask(named, "_mask")
    target = object_ref(kind, F.col("_schema"), F.col("_name"))
    role = role_ref(F.col("role_oid"), F.col("_role"))
    is_owner = F.col("verb") == "OWNER"
    klass = F.when(is_owner, alter_class(kind, server_version)).otherwise(
        grant_class(kind, server_version)
    )
    granting = grant_command(
        F.col("verb"), F.col("privilege"), klass, target, role, F.col("column_name")
    )
    return (
        named.withColumn("object_class", klass)
        .withColumn("command", F.when(is_owner, owner_command(klass, target, role)).otherwise(granting))
        .drop("_family", "_schema", "_name", "_role")
    )


def resolve_relation_names(
    requests: DataFrame, all_objects: DataFrame, namespaces: DataFrame
) -> DataFrame:
    """obj_oid → [schema, relation]; NULL when there is no such relation."""
    named = namespaces.select("schema_oid", "schema_name")
    relations = all_objects.where(F.col("obj_kind").isin(*RELATION_KINDS, "S")).select(
        "schema_oid", "obj_oid", "obj_name"
    )
    relations = attach(relations, named, "schema_oid", "inner")
    found = relations.select("obj_oid", F.array("schema_name", "obj_name").alias("relation"))
    return requests.join(found, "obj_oid", "left")
