"""The server's own catalogs, derived from the catalog tables of one test-data folder.

What a snapshot job would have copied from every database: one Parquet folder for each catalog, ids as a
server has them (unique per database only), ACLs as the text of an array, roles named.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.scaling import shared_folder
from grantlens.sources.snapshot import DESCRIPTORS
from harness.inputs import Inputs


def _quoted(name: Column) -> Column:
    plain = F.regexp_like(name, F.lit(r"\A[A-Za-z0-9_]*\z"))
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def _acl_texts(entries: DataFrame, keys: list[str], roles: DataFrame, number: Callable[[str], Column] = F.col) -> DataFrame:
    """(keys, acl): the entries (grantee_oid, grantor_oid, codes, grantable) of each object as one text.

    ``number`` gives the id that a role without a name is written as.
    """
    names = roles.select("role_oid", _quoted(F.col("role_name")).alias("name"))
    named = entries.join(names.toDF("grantee_oid", "_grantee"), "grantee_oid", "left")
    named = named.join(names.toDF("grantor_oid", "_grantor"), "grantor_oid", "left")
    codes = F.when(F.col("grantable"), F.regexp_replace("codes", "(.)", "$1*")).otherwise(F.col("codes"))
    grantee = F.when(F.col("grantee_oid") == 0, "").otherwise(F.coalesce("_grantee", number("grantee_oid").cast("string")))
    item = F.concat(grantee, F.lit("="), codes, F.lit("/"), F.coalesce("_grantor", number("grantor_oid").cast("string")))
    escaped = F.concat(F.lit('"'), F.regexp_replace(item, r'(["\\])', r"\\$1"), F.lit('"'))
    element = F.when(F.regexp_like(item, F.lit(r'["\\{},\s]')), escaped).otherwise(item)
    texts = named.groupBy(*keys).agg(F.array_join(F.collect_list(element), ",").alias("_items"))
    return texts.select(*keys, F.concat(F.lit("{"), F.col("_items"), F.lit("}")).alias("acl"))


def _objects(c: Inputs, number: Callable[[str], Column]) -> DataFrame:
    acl = _acl_texts(c.acl_items, ["obj_oid"], c.roles, number)
    text = F.when(F.col("has_acl"), F.coalesce("acl", F.lit("{}")))
    return c.objects.join(acl, "obj_oid", "left").withColumn("acl", text)


def _of_kind(objects: DataFrame, prefix: str, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    return objects.where(F.col("obj_kind").isin(*kinds)).select(
        "db_id", F.col("obj_oid").alias("oid"), F.col("obj_name").alias(f"{prefix}name"),
        F.col("schema_oid").alias(f"{prefix}namespace"), F.col("owner_oid").alias(f"{prefix}owner"),
        F.col("acl").alias(f"{prefix}acl"), *more,
    )


def _pg_class(c: Inputs, objects: DataFrame) -> DataFrame:
    relations = _of_kind(objects, "rel", ("r", "p", "v", "m", "f", "S"), F.col("obj_kind").alias("relkind"))
    tables = c.objects.select("db_id", F.col("obj_oid").alias("table_oid"), "owner_oid")
    indexes = c.table_indexes.join(tables, "table_oid").select(
        "db_id", (F.col("table_oid") + 3_000_000_000).alias("oid"), F.col("index_name").alias("relname"),
        F.col("schema_oid").alias("relnamespace"), F.col("owner_oid").alias("relowner"),
        F.lit(None).cast("string").alias("relacl"), F.lit("i").alias("relkind"),
    )
    return relations.unionByName(indexes)


def _pg_depend(c: Inputs) -> DataFrame:
    own = c.objects.select("db_id", F.col("obj_oid").alias("objid"))

    def edges(df: DataFrame, obj: Column, of: str, ref: Column, ref_of: str, column: int, kind: str) -> DataFrame:
        return df.select(
            obj.cast("bigint").alias("objid"), F.lit(of).alias("classid"), ref.cast("bigint").alias("refobjid"),
            F.lit(ref_of).alias("refclassid"), F.lit(column).alias("refobjsubid"), F.lit(kind).alias("deptype"),
        )

    views = edges(c.view_sources, F.col("view_oid"), "pg_rewrite", F.col("source_oid"), "pg_class", 0, "n")
    selves = edges(c.view_sources, F.col("view_oid"), "pg_rewrite", F.col("view_oid"), "pg_class", 0, "n")
    sequences = edges(c.owned_sequences, F.col("sequence_oid"), "pg_class", F.col("table_oid"), "pg_class", 1, "a")
    types = edges(c.auto_types, F.col("obj_oid"), "pg_type", F.col("obj_oid") - 1, "pg_class", 0, "i")
    return reduce(DataFrame.unionByName, (views, selves.distinct(), sequences, types)).join(own, "objid")


def _pg_namespace(c: Inputs, number: Callable[[str], Column]) -> DataFrame:
    schema_acl = c.schema_acl.withColumn("grantor_oid", F.col("owner_oid"))
    schemas = c.namespace_states.join(_acl_texts(schema_acl, ["schema_oid"], c.roles, number), "schema_oid", "left")
    return schemas.select(
        "db_id", F.col("schema_oid").alias("oid"), F.col("schema_name").alias("nspname"),
        F.col("owner_oid").alias("nspowner"), F.when(F.col("has_acl"), F.coalesce("acl", F.lit("{}"))).alias("nspacl"),
    )


def _pg_attribute(c: Inputs, number: Callable[[str], Column]) -> DataFrame:
    on_columns = c.column_acl.join(c.objects.select("obj_oid", F.col("owner_oid").alias("grantor_oid")), "obj_oid")
    return _acl_texts(on_columns, ["db_id", "obj_oid", "column_name"], c.roles, number).select(
        "db_id", F.col("obj_oid").alias("attrelid"), F.col("column_name").alias("attname"), F.col("acl").alias("attacl")
    )


def _pg_default_acl(c: Inputs, number: Callable[[str], Column]) -> DataFrame:
    defaults = c.default_acl.withColumn("grantable", F.lit(False))
    of_default = ["db_id", "schema_oid", "defaclrole", "obj_type"]
    defaults = _acl_texts(defaults.withColumn("defaclrole", F.col("grantor_oid")), of_default, c.roles, number)
    return defaults.select(
        "db_id", F.col("schema_oid").alias("defaclnamespace"), "defaclrole",
        F.col("obj_type").alias("defaclobjtype"), F.col("acl").alias("defaclacl"),
    )


def _pg_roles(c: Inputs) -> DataFrame:
    return c.roles.select(
        F.col("role_oid").alias("oid"), F.col("role_name").alias("rolname"), F.col("can_login").alias("rolcanlogin"),
        F.col("is_super").alias("rolsuper"), F.col("can_create_role").alias("rolcreaterole"), F.col("inherits").alias("rolinherit"),
    )


def _pg_rewrite(c: Inputs) -> DataFrame:
    return c.objects.where("obj_kind in ('v', 'm')").select(
        "db_id", F.col("obj_oid").alias("oid"), F.col("obj_oid").alias("ev_class"), F.lit("_RETURN").alias("rulename"),
        F.lit("1").alias("ev_type"), F.lit("O").alias("ev_enabled"), F.lit(True).alias("is_instead"),
    )


def _pg_shdepend(c: Inputs) -> DataFrame:
    # what depends on a role in database 0 is the database itself: 0 stands for no database there
    return c.role_dependencies.select(
        F.col("db_id").alias("dbid"), F.when(F.col("db_id") == 0, "pg_database").otherwise("pg_class").alias("classid"),
        F.col("db_id").alias("objid"), F.lit("pg_authid").alias("refclassid"), F.col("role_oid").alias("refobjid"),
    )


def _of_members(c: Inputs) -> DataFrame:
    return c.memberships.select(F.col("role_oid").alias("roleid"), F.col("member_oid").alias("member"), "admin_option")


def _catalogs(
    c: Inputs, objects: Callable[[], DataFrame], number: Callable[[str], Column] = F.col
) -> dict[str, Callable[[], DataFrame]]:
    """How each catalog is made. ``objects`` gives the objects with their ACL texts."""
    domain = F.when(F.col("obj_kind") == "d", "d").otherwise("c").alias("typtype")
    out = {
        "pg_class": lambda: _pg_class(c, objects()),
        "pg_proc": lambda: _of_kind(objects(), "pro", ("X",)),
        "pg_type": lambda: _of_kind(objects(), "typ", ("T", "d"), domain),
        "pg_namespace": lambda: _pg_namespace(c, number),
        "pg_attribute": lambda: _pg_attribute(c, number),
        "pg_default_acl": lambda: _pg_default_acl(c, number),
        "pg_roles": lambda: _pg_roles(c),
        "pg_auth_members": lambda: _of_members(c),
        "pg_depend": lambda: _pg_depend(c),
        "pg_rewrite": lambda: _pg_rewrite(c),
        "pg_shdepend": lambda: _pg_shdepend(c),
    }
    without = lambda d: _of_kind(
        c.objects.withColumn("acl", F.lit(None).cast("string")), d.prefix, tuple(code for _, code in d.kinds)
    ).drop(f"{d.prefix}acl")
    for d in DESCRIPTORS:
        if d.catalog not in out:  # kinds of objects that the given tables do not have
            out[d.catalog] = lambda d=d: without(d)
    return out


# What a snapshot is read from; see read_snapshot.
OF_SNAPSHOT = (*[d.catalog for d in DESCRIPTORS], "pg_attribute", "pg_default_acl", "pg_roles")


def _written(c: Inputs, fleet: str, catalogs: dict[str, Callable[[], DataFrame]], names: tuple[str, ...]) -> str:
    """Folder with the catalogs ``names``; one that is not there yet is written, once in a session."""
    root = c._paths.setdefault(fleet, f"{shared_folder(c.spark)}/{uuid.uuid4().hex}/{fleet}")
    for name in names:
        key = f"{fleet}/{name}"
        if key not in c._paths:
            catalogs[name]().write.parquet(f"{root}/{name}", compression="zstd")
            c._paths[key] = f"{root}/{name}"
    return root


SECOND_SERVER = "db_id % 2 = 1"  # databases that lie on server 1 in the fleet of two


def mirror(c: Inputs) -> int:
    """Server 1 has the ids of server 0 in reverse: equal ids are different roles there."""
    return c.roles.agg(F.min("role_oid") + F.max("role_oid")).first()[0]


def databases(c: Inputs) -> DataFrame:
    """(db_id, server_id, oid): both servers use the same database ids."""
    server = F.when(F.expr(SECOND_SERVER), 1).otherwise(0).alias("server_id")
    return c.namespace_states.select("db_id").distinct().select("db_id", server, F.expr("db_id div 2 + 1").alias("oid"))


def server_root(c: Inputs, *names: str) -> str:
    """Folder with the catalogs ``names`` of two servers (none: all that a snapshot is read from)."""
    names = names or OF_SNAPSHOT
    if all(f"servers/{name}" in c._paths for name in names):
        return c._paths["servers"]
    sum_ = mirror(c)

    def there(name: str) -> Column:
        return F.when(F.expr(SECOND_SERVER), sum_ - F.col(name)).otherwise(F.col(name))

    def twice(df: DataFrame, *ids: str) -> DataFrame:
        second = df.withColumns({x: sum_ - F.col(x) for x in ids})
        return df.withColumn("server_id", F.lit(0)).unionByName(second.withColumn("server_id", F.lit(1)))

    def dependencies(df: DataFrame) -> DataFrame:
        itself = F.col("classid") == "pg_database"
        shared = df.withColumn("db_id", F.when(itself, F.col("objid")).otherwise(F.col("dbid")))
        return shared.join(databases(c), "db_id").select(
            "server_id", F.when(itself, 0).otherwise(F.col("oid")).alias("dbid"), "classid", F.col("oid").alias("objid"),
            "refclassid", there("refobjid").alias("refobjid"),
        )

    made = _catalogs(c, lambda: c.land("objects_on_servers", lambda: _objects(c, there)), there)
    changes = {
        "pg_default_acl": lambda df: df.withColumn("defaclrole", there("defaclrole")),
        "pg_roles": lambda df: twice(df, "oid"),
        "pg_auth_members": lambda df: twice(df, "roleid", "member"),
        "pg_shdepend": dependencies,
    } | {d.catalog: lambda df, owner=f"{d.prefix}owner": df.withColumn(owner, there(owner)) for d in DESCRIPTORS}
    out = {name: (lambda name=name: changes.get(name, lambda df: df)(made[name]())) for name in made}
    return _written(c, "servers", out, names)


def catalog_root(c: Inputs, *names: str) -> str:
    """Folder with the catalogs ``names`` (none: all that a snapshot is read from)."""
    out = _catalogs(c, lambda: c.land("objects_as_text", lambda: _objects(c, F.col)))
    return _written(c, "pg", out, names or OF_SNAPSHOT)
