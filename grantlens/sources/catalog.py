"""Roles, memberships and dependencies from the catalogs; objects are read in ``snapshot``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.model import ALL_ACL, ALL_OBJECTS, PUBLIC_OID

_FLEET_SHIFT = 1 << 32


def fleet_oid(db_id: Column, oid: Column) -> Column:
    """Server oid made unique over the fleet (server oids have 32 bits)."""
    return db_id.cast("bigint") * F.lit(_FLEET_SHIFT) + oid.cast("bigint")


def fleet_role(server_id: Column, oid: Column) -> Column:
    """Role id made unique over the servers of a fleet. Public is 0 everywhere; server 0 keeps its ids."""
    own = server_id.cast("bigint") * F.lit(_FLEET_SHIFT) + oid.cast("bigint")
    return F.when(oid == PUBLIC_OID, F.lit(PUBLIC_OID).cast("bigint")).otherwise(own)


def _server_of(catalog: DataFrame) -> Column:
    """Server of a row of a server-wide catalog; without that column all rows are of server 0."""
    return F.col("server_id") if "server_id" in catalog.columns else F.lit(0)


def read_roles(catalog: DataFrame) -> DataFrame:
    """Roles from the role catalogs of one server, or of many told apart by ``server_id``.

    With many servers, ids are those of :func:`fleet_role` and ``server_id`` is a column: names are unique
    on each server only.
    """
    many = ["server_id"] if "server_id" in catalog.columns else []
    return catalog.select(
        *[F.col(c).cast("bigint").alias(c) for c in many],
        fleet_role(_server_of(catalog), F.col("oid")).alias("role_oid"),
        F.col("rolname").cast("string").alias("role_name"),
        F.col("rolcanlogin").alias("can_login"),
        F.col("rolsuper").alias("is_super"),
        F.col("rolcreaterole").alias("can_create_role"),
        F.col("rolinherit").alias("inherits"),
    )


def read_memberships(catalog: DataFrame) -> DataFrame:
    """Membership edges (role_oid: granted role, member_oid: who got it), one for each pair.

    A role granted by several grantors has the admin option if any of them gave it. ``server_id`` tells
    servers apart, as in :func:`read_roles`.
    """
    server = _server_of(catalog)
    return catalog.groupBy(
        fleet_role(server, F.col("roleid")).alias("role_oid"), fleet_role(server, F.col("member")).alias("member_oid")
    ).agg(F.bool_or("admin_option").alias("admin_option"))


def read_view_sources(depend: DataFrame, rewrite: DataFrame) -> DataFrame:
    """View → relation edges from the dependency and rewrite-rule catalogs.

    Only the enabled ``_RETURN`` rules of views count, and a view is no source of itself.
    """
    rules = rewrite.where(
        (F.col("rulename") == "_RETURN")
        & (F.col("ev_type") == "1")
        & (F.col("ev_enabled") == "O")
        & F.col("is_instead")
    ).select("db_id", F.col("oid").alias("objid"), F.col("ev_class"))
    edges = depend.where(
        (F.col("classid") == "pg_rewrite")
        & (F.col("refclassid") == "pg_class")
        & (F.col("deptype") == "n")
    ).select("db_id", "objid", "refobjid")
    return (
        edges.join(rules, ["db_id", "objid"])
        .where(F.col("refobjid") != F.col("ev_class"))
        .select(
            fleet_oid(F.col("db_id"), F.col("ev_class")).alias("view_oid"),
            fleet_oid(F.col("db_id"), F.col("refobjid")).alias("source_oid"),
        )
        .distinct()
    )


def read_owned_relations(depend: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """Sequences (kind 'S') or indexes (kind 'i') that belong to a column of a table."""
    edges = depend.where(
        (F.col("classid") == "pg_class")
        & (F.col("refclassid") == "pg_class")
        & (F.col("refobjsubid") > 0)
        & F.col("deptype").isin("a", "i")
    ).select("db_id", F.col("objid").alias("oid"), "refobjid")
    owned = classes.where(F.col("relkind") == kind).select("db_id", "oid", "relname")
    return edges.join(owned, ["db_id", "oid"]).select(
        fleet_oid(F.col("db_id"), F.col("refobjid")).alias("table_oid"),
        fleet_oid(F.col("db_id"), F.col("oid")).alias("owned_oid"),
        F.col("relname").alias("owned_name"),
    ).distinct()


def read_auto_types(depend: DataFrame) -> DataFrame:
    """Types the server generated for another object."""
    return (
        depend.where((F.col("classid") == "pg_type") & F.col("deptype").isin("i", "a"))
        .select(fleet_oid(F.col("db_id"), F.col("objid")).alias("obj_oid"))
        .distinct()
    )


def read_role_dependencies(shdepend: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """(db_id, role_oid): a role owns or is granted something in, or on, a database.

    The OR of the two ways to name the database becomes a union of two projections. With many servers
    the catalog has ``server_id``, and ``databases`` (db_id, server_id, oid) says which database of the fleet
    a server's database is; one that is not listed gives no row.
    """
    if ("server_id" in shdepend.columns) != (databases is not None):
        raise ValueError("servers need both server_id in the catalog and the list of databases")
    edges = shdepend.where(F.col("refclassid") == "pg_authid").withColumn("_server", _server_of(shdepend))
    role = fleet_role(F.col("_server"), F.col("refobjid")).alias("role_oid")
    inside = edges.select("_server", F.col("dbid").alias("db_id"), role)
    itself = edges.where(F.col("classid") == "pg_database").select("_server", F.col("objid").alias("db_id"), role)
    found = inside.where(F.col("db_id") != 0).union(itself).distinct()
    if databases is None:
        return found.select("db_id", "role_oid")
    listed = databases.select(F.col("db_id").alias("_fleet"), F.col("server_id").alias("_server"), F.col("oid").alias("db_id"))
    return found.join(listed, ["_server", "db_id"]).select(F.col("_fleet").cast("bigint").alias("db_id"), "role_oid")


def unify_objects(objects: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Objects and schemas (kind 'N') in the ALL_OBJECTS shape."""
    schemas = namespaces.select(
        "db_id",
        "schema_oid",
        F.lit("N").alias("obj_kind"),
        F.col("schema_oid").alias("obj_oid"),
        F.col("schema_name").alias("obj_name"),
        "owner_oid",
        "has_acl",
    )
    return objects.select(*ALL_OBJECTS).unionByName(schemas)


def unify_acl(acl_items: DataFrame, schema_acl: DataFrame, column_acl: DataFrame) -> DataFrame:
    """ACL entries of objects, schemas and columns in the ALL_ACL shape."""
    no_column = F.lit(None).cast("string").alias("column_name")
    on_objects = acl_items.withColumn("column_name", no_column).select(*ALL_ACL)
    on_schemas = schema_acl.select(
        "db_id", "schema_oid", F.lit("N").alias("obj_kind"), F.col("schema_oid").alias("obj_oid"),
        no_column, "owner_oid", "grantee_oid", "codes", "grantable",
    )
    on_columns = column_acl.select(
        "db_id", "schema_oid", F.lit("A").alias("obj_kind"), "obj_oid", "column_name",
        F.lit(None).cast("bigint").alias("owner_oid"), "grantee_oid", "codes", "grantable",
    )
    return on_objects.unionByName(on_schemas).unionByName(on_columns)
