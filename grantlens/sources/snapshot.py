"""Catalog snapshots whole: objects, columns, default privileges, and what their ACL texts grant.

One table of descriptors says of each catalog what its columns are called and which kinds of objects it
holds; every reader below goes by it. The catalogs are Parquet folders with the server's own columns and
a ``db_id``; an ACL is an array of item texts, or the text of such an array.

ACL texts repeat: most objects of a schema carry the same one. So texts are taken apart, and their role
names looked up, once for each distinct text of a server; objects then meet their entries by text.

Roles belong to servers. With more than one, ``databases`` (db_id, server_id) says on which server a database
is, and roles come with their ``server_id``; role ids are then those of ``fleet_role``. What lies in a database
that is not listed has no owner, and its ACL items are rejected unless they are for public.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlens.functions.acltext import array_items, by_option, item_parts
from grantlens.model import ALL_ACL, ALL_OBJECTS, KINDS, PUBLIC_OID
from grantlens.scaling import attach, computed, cut_lineage, union_all
from grantlens.sources.catalog import fleet_oid, fleet_role


@dataclass(frozen=True)
class Descriptor:
    """Where the objects of some kinds are found.

    ``kinds`` gives the kind for each value of the column ``<prefix><kind_of>``; ``None`` stands for any
    other value, and for all rows where no column tells kinds apart.
    """

    catalog: str
    prefix: str
    kinds: tuple[tuple[str | None, str], ...]
    kind_of: str | None = None
    has_acl: bool = False

    def column(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")

    def kind(self) -> Column:
        out = F.lit(dict(self.kinds).get(None)).cast("string")
        for value, code in self.kinds:
            if value is not None:
                out = F.when(self.column(self.kind_of) == value, F.lit(code)).otherwise(out)
        return out


# The catalogs of the server, their column prefixes and what tells kinds apart.
DESCRIPTORS = (
    Descriptor("pg_class", "rel", tuple((k, k) for k in ("r", "p", "v", "m", "f", "S")), "kind", True),
    Descriptor("pg_proc", "pro", ((None, "X"),), None, True),
    Descriptor("pg_type", "typ", (("d", "d"), (None, "T")), "type", True),
    Descriptor("pg_conversion", "con", ((None, "C"),)),
    Descriptor("pg_operator", "opr", ((None, "O"),)),
    Descriptor("pg_collation", "coll", ((None, "L"),)),
    Descriptor("pg_ts_dict", "dict", ((None, "D"),)),
    Descriptor("pg_ts_config", "cfg", ((None, "G"),)),
    Descriptor("pg_opfamily", "opf", ((None, "F"),)),
    Descriptor("pg_opclass", "opc", ((None, "K"),)),
    Descriptor("pg_statistic_ext", "stx", ((None, "E"),)),
    Descriptor("pg_namespace", "nsp", ((None, "N"),), None, True),
)
_SINCE = {k.code: k.min_version for k in KINDS}

def acl_array(df: DataFrame, column: str) -> Column:
    """An ACL column as an array of item texts, whether it is one or the text of one."""
    kind = df.schema[column].dataType
    return array_items(F.col(column)) if isinstance(kind, T.StringType) else F.col(column)


def objects_of(d: Descriptor, df: DataFrame) -> DataFrame:
    """The rows of one catalog in the common shape, ACLs as they are."""
    oid = fleet_oid(F.col("db_id"), F.col("oid"))
    schema = oid if d.catalog == "pg_namespace" else fleet_oid(F.col("db_id"), d.column("namespace"))
    acl = acl_array(df, f"{d.prefix}acl") if d.has_acl else F.lit(None)
    return df.select(
        F.col("db_id").cast("bigint").alias("db_id"),
        schema.alias("schema_oid"),
        d.kind().alias("obj_kind"),
        oid.alias("obj_oid"),
        d.column("name").cast("string").alias("obj_name"),
        d.column("owner").cast("bigint").alias("owner_oid"),
        (d.column("acl").isNotNull() if d.has_acl else F.lit(False)).alias("has_acl"),
        acl.cast("array<string>").alias("acl"),
    ).where(F.col("obj_kind").isNotNull())


def on_servers(df: DataFrame, databases: DataFrame | None, role: str | None = None) -> DataFrame:
    """``df`` with the ``server_id`` of its databases and the ids in ``role`` unique over the servers."""
    if databases is None:
        return df
    out = attach(df, databases.select("db_id", F.col("server_id").cast("bigint").alias("server_id")), "db_id")
    return out if role is None else out.withColumn(role, fleet_role(F.col("server_id"), F.col(role)))


def snapshot_objects(
    spark: SparkSession, root: str, server_version: int = 150000, databases: DataFrame | None = None
) -> DataFrame:
    """All objects and schemas below ``root`` with their ACL texts.

    A catalog without a folder that the server's version does not have is left out; kinds newer than the
    version are, too. A relation kind that nobody manages (indexes, toast tables) gives no row.
    """
    known = [d for d in DESCRIPTORS if any(_SINCE[code] <= server_version for _, code in d.kinds)]
    found = union_all([objects_of(d, spark.read.parquet(f"{root}/{d.catalog}")) for d in known])
    return on_servers(found, databases, "owner_oid")


def read_catalog_jdbc(
    spark: SparkSession, url: str, catalog: str, db_id: int, server_id: int = 0, **options: str
) -> DataFrame:
    """The objects of one catalog of one live server, read-only, in the same shape."""
    source = spark.read.format("jdbc").option("url", url).option("dbtable", f"pg_catalog.{catalog}")
    (descriptor,) = [d for d in DESCRIPTORS if d.catalog == catalog]
    found = objects_of(descriptor, source.options(**options).load().withColumn("db_id", F.lit(db_id)))
    return found.withColumn("owner_oid", fleet_role(F.lit(server_id), F.col("owner_oid")))


def snapshot_columns(attributes: DataFrame, classes: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Columns that carry an ACL of their own, in the objects' shape, with ``column_name``.

    Columns without one are never read into a shuffle; a column of a relation that is gone gives no row.
    """
    with_acl = attributes.where(F.col("attacl").isNotNull())
    relation = classes.select("db_id", F.col("oid").alias("attrelid"), "relnamespace")
    found = with_acl.join(relation, ["db_id", "attrelid"]).select(
        F.col("db_id").cast("bigint").alias("db_id"),
        fleet_oid(F.col("db_id"), F.col("relnamespace")).alias("schema_oid"),
        F.lit("A").alias("obj_kind"),
        fleet_oid(F.col("db_id"), F.col("attrelid")).alias("obj_oid"),
        F.col("attname").cast("string").alias("column_name"),
        F.lit(None).cast("bigint").alias("owner_oid"),
        acl_array(attributes, "attacl").cast("array<string>").alias("acl"),
    )
    return on_servers(found, databases)


def _role_of(name: Column, found: Column, server: Column) -> Column:
    """Id of a named role: 0 for public; a role that is gone is written as its number."""
    number = F.when(F.regexp_like(name, F.lit(r"\A[0-9]{1,18}\z")), fleet_role(server, name.cast("bigint")))
    return F.when(name == "", F.lit(PUBLIC_OID).cast("bigint")).otherwise(F.coalesce(found, number))


def _text_keys(texts: DataFrame) -> list[str]:
    return ["server_id", "acl"] if "server_id" in texts.columns else ["acl"]


def acl_dictionary(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """(server_id, acl, entries, rejected): what each distinct ``acl`` of ``texts`` grants on its server.

    ``entries`` are (grantor_oid, grantee_oid, codes, grantable), ``rejected`` the items that are no items
    or name a role that does not exist. Nulls and empty arrays are not in it. ``server_id`` is there if
    ``texts`` and ``roles`` have it; one without the other is an error.
    """
    keys = _text_keys(texts)
    if ("server_id" in roles.columns) != ("server_id" in keys):
        raise ValueError("servers need both roles with server_id and the list of databases")
    of_server, server = keys[:-1], F.col("server_id") if len(keys) > 1 else F.lit(0)
    distinct = texts.where(F.size("acl") > 0).select(*keys).distinct()
    items = distinct.select(*keys, F.posexplode("acl").alias("at", "item"))
    items = computed(items, part=item_parts(F.col("item")))
    items = items.select(*keys, "at", "item", "part.*")
    names = roles.select(*of_server, F.col("role_name").alias("_name"), F.col("role_oid").alias("_oid"))
    items = items.join(names.toDF(*of_server, "grantee", "_grantee"), [*of_server, "grantee"], "left")
    items = items.join(names.toDF(*of_server, "grantor", "_grantor"), [*of_server, "grantor"], "left")
    items = items.withColumn("grantee_oid", _role_of(F.col("grantee"), F.col("_grantee"), server))
    good = F.col("is_valid") & F.col("grantee_oid").isNotNull()
    entries = F.transform(
        by_option(F.col("codes")),
        lambda x: F.struct(
            _role_of(F.col("grantor"), F.col("_grantor"), server).alias("grantor_oid"),
            F.col("grantee_oid").alias("grantee_oid"),
            x["codes"].alias("codes"),
            x["grantable"].alias("grantable"),
        ),
    )
    # an ACL has as many items as there are grantees and grantors: few
    return items.groupBy(*keys).agg(
        F.flatten(F.collect_list(F.when(good, entries))).alias("entries"),
        F.collect_list(F.when(~good, F.col("item"))).alias("rejected"),
    )


def _meet(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows with the dictionary's entry of their text; a database of no known server meets by null."""
    if "server_id" not in rows.columns:
        return rows.join(dictionary, "acl")
    other = dictionary.withColumnsRenamed({"server_id": "_server", "acl": "_acl"})
    same = F.col("server_id").eqNullSafe(F.col("_server")) & (F.col("acl") == F.col("_acl"))
    return rows.join(other, same).drop("_server", "_acl")


def snapshot_acl(objects: DataFrame, columns: DataFrame, roles: DataFrame) -> DataFrame:
    """ACL entries of objects, schemas and columns in the ALL_ACL shape; see :func:`rejected_acl`.

    An object without an ACL (built-in defaults) and one with an empty ACL give no entry; ``has_acl`` of
    the object tells them apart.
    """
    every = _every_acl(objects, columns)
    met = _meet(every, acl_dictionary(every, roles))
    return met.select(*[c for c in ALL_ACL if c not in ("grantee_oid", "codes", "grantable")], F.inline("entries")).select(*ALL_ACL)


def rejected_acl(objects: DataFrame, columns: DataFrame, roles: DataFrame) -> DataFrame:
    """(db_id, obj_kind, obj_oid, column_name, item): ACL items that could not be read or resolved."""
    every = _every_acl(objects, columns)
    met = _meet(every, acl_dictionary(every, roles).where(F.size("rejected") > 0))
    return met.select("db_id", "obj_kind", "obj_oid", "column_name", F.explode("rejected").alias("item"))


def _every_acl(objects: DataFrame, columns: DataFrame) -> DataFrame:
    keys = [c for c in ALL_ACL if c not in ("grantee_oid", "codes", "grantable")] + _text_keys(objects)
    own = objects.where(F.size("acl") > 0).withColumn("column_name", F.lit(None).cast("string"))
    return own.select(*keys).unionByName(columns.where(F.size("acl") > 0).select(*keys))


def snapshot_default_acl(defaults: DataFrame, roles: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """(db_id, schema_oid, grantor_oid, obj_type, grantee_oid, codes): entries of default privileges.

    ``schema_oid`` is null for those that hold in every schema. Codes with and without grant option come
    in rows of their own.
    """
    schema = F.when(F.col("defaclnamespace") != 0, fleet_oid(F.col("db_id"), F.col("defaclnamespace")))
    rows = defaults.select(
        F.col("db_id").cast("bigint").alias("db_id"),
        schema.alias("schema_oid"),
        F.col("defaclrole").cast("bigint").alias("_role"),
        F.col("defaclobjtype").alias("obj_type"),
        acl_array(defaults, "defaclacl").alias("acl"),
    ).where(F.size("acl") > 0)
    rows = on_servers(rows, databases, "_role")
    met = _meet(rows, acl_dictionary(rows, roles))
    met = met.select("db_id", "schema_oid", "_role", "obj_type", F.inline("entries"))
    return met.select("db_id", "schema_oid", F.col("_role").alias("grantor_oid"), "obj_type", "grantee_oid", "codes")


@dataclass
class Snapshot:
    """What the operators read, of a whole snapshot; ACLs are worked out once, when first asked for, and written."""

    objects: DataFrame
    entries: DataFrame
    default_acl: DataFrame
    rejected: DataFrame

    @cached_property
    def acl(self) -> DataFrame:
        return cut_lineage(self.entries)


def read_snapshot(
    spark: SparkSession, root: str, roles: DataFrame, server_version: int = 150000, databases: DataFrame | None = None
) -> Snapshot:
    """All catalogs below ``root`` as the tables of the operators; ``databases`` where there are several servers."""
    objects = snapshot_objects(spark, root, server_version, databases)
    attributes, classes = spark.read.parquet(f"{root}/pg_attribute"), spark.read.parquet(f"{root}/pg_class")
    columns = snapshot_columns(attributes, classes, databases)
    return Snapshot(
        objects.select(*ALL_OBJECTS),
        snapshot_acl(objects, columns, roles),
        snapshot_default_acl(spark.read.parquet(f"{root}/pg_default_acl"), roles, databases),
        rejected_acl(objects, columns, roles),
    )
