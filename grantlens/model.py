"""Shapes of the tables the operators read, and the vocabulary of the domain.

Ids (``schema_oid``, ``obj_oid``) are unique over the whole fleet of databases: the catalog
reader qualifies server oids with ``db_id`` (see :func:`grantlens.sources.catalog.fleet_oid`).
Role ids are server-wide and carry no ``db_id``; with several servers the reader qualifies them with
``server_id`` (:func:`grantlens.sources.catalog.fleet_role`).
"""

from __future__ import annotations

from dataclasses import dataclass

PUBLIC_OID = 0
SUPERUSER_KEY = -1

# Privilege codes and names.
PRIVILEGES = (
    ("r", "SELECT"),
    ("a", "INSERT"),
    ("w", "UPDATE"),
    ("d", "DELETE"),
    ("D", "TRUNCATE"),
    ("x", "REFERENCES"),
    ("t", "TRIGGER"),
    ("U", "USAGE"),
    ("C", "CREATE"),
    ("X", "EXECUTE"),
    ("c", "CONNECT"),
    ("T", "TEMPORARY"),
)


@dataclass(frozen=True)
class Kind:
    """One kind of object: how it is named in commands and who is expected to hold what."""

    code: str
    label: str
    grant_class: str | None
    alter_class: str
    owner: str | None = None
    editor: str | None = None
    reader: str | None = None
    public: str | None = None
    base: bool = False
    min_version: int = 0


# Expected rights by kind of object.
KINDS = (
    Kind("r", "table", "TABLE", "TABLE", "rawdDxt", "rawd", "r", base=True),
    Kind("p", "partitioned table", "TABLE", "TABLE", "rawdDxt", "rawd", "r", base=True),
    Kind("v", "view", "TABLE", "VIEW", "rawdDxt", "rawd", "r"),
    Kind("m", "materialized view", "TABLE", "MATERIALIZED VIEW", "rawdDxt", "rawd", "r", base=True),
    Kind("f", "foreign table", "TABLE", "FOREIGN TABLE", "rawdDxt", "rawd", "r", base=True),
    Kind("S", "sequence", "SEQUENCE", "SEQUENCE", "rwU", "rU", "r"),
    Kind("X", "routine", "ROUTINE", "ROUTINE", "X", public="X"),
    Kind("d", "domain", "TYPE", "DOMAIN", "U", public="U"),
    Kind("T", "type", "TYPE", "TYPE", "U", public="U"),
    Kind("N", "schema", "SCHEMA", "SCHEMA", "UC", "U", "U"),
    Kind("A", "column", "TABLE", "TABLE"),
    Kind("C", "conversion", None, "CONVERSION"),
    Kind("O", "operator", None, "OPERATOR"),
    Kind("L", "collation", None, "COLLATION"),
    Kind("D", "text search dictionary", None, "TEXT SEARCH DICTIONARY"),
    Kind("G", "text search configuration", None, "TEXT SEARCH CONFIGURATION"),
    Kind("F", "operator family", None, "OPERATOR FAMILY"),
    Kind("K", "operator class", None, "OPERATOR CLASS"),
    Kind("E", "extended statistics", None, "STATISTICS", min_version=100000),
)

RELATION_KINDS = ("r", "p", "v", "m", "f")
RIGHTS_KINDS = tuple(k.code for k in KINDS if k.grant_class)

# Object types a caller may name, and the class of objects each is looked up in.
OBJECT_TYPES = {
    "table": "TABLE",
    "partitioned table": "TABLE",
    "view": "TABLE",
    "materialized view": "TABLE",
    "foreign table": "TABLE",
    "sequence": "SEQUENCE",
    "function": "ROUTINE",
    "aggregate": "ROUTINE",
    "procedure": "ROUTINE",
    "routine": "ROUTINE",
    "type": "TYPE",
    "domain": "TYPE",
}
PUBLIC_OBJECT_CLASSES = ("TABLE", "SEQUENCE")

# Object types of default privileges and the words used for them.
DEFAULT_ACL_TYPES = {"r": "TABLES", "S": "SEQUENCES", "f": "ROUTINES", "T": "TYPES", "n": "SCHEMAS"}
DIAGNOSED_DEFAULT_ACL_TYPES = ("r", "S", "f", "T")

# Schemas that belong to the server.
SYSTEM_SCHEMA_PATTERN = (
    "^pg_toast|^pg_temp|^pg_catalog$|^public$|^information_schema$|^topology$"
)

ROLES = (
    "role_oid bigint, role_name string, can_login boolean, is_super boolean, "
    "can_create_role boolean, inherits boolean"
)
MEMBERSHIPS = "role_oid bigint, member_oid bigint, admin_option boolean"
REGISTRY = (
    "db_id bigint, block string, in_nomenclature boolean, level1 string, level2 string, "
    "schema_name string, schema_oid bigint, is_created boolean, producer string, "
    "producer_oid bigint, editor string, editor_oid bigint, reader string, reader_oid bigint"
)
NAMESPACES = (
    "db_id bigint, schema_oid bigint, schema_name string, owner_oid bigint"
)
OBJECTS = (
    "db_id bigint, obj_oid bigint, schema_oid bigint, obj_kind string, obj_name string, "
    "owner_oid bigint, has_acl boolean"
)
ACL_ITEMS = (
    "db_id bigint, obj_oid bigint, schema_oid bigint, obj_kind string, owner_oid bigint, "
    "grantor_oid bigint, grantee_oid bigint, codes string, grantable boolean"
)
DDL_EVENTS = (
    "db_id bigint, event_id bigint, ts timestamp_ntz, tag string, object_type string, schema_oid bigint, "
    "schema_name string, owner_oid bigint, obj_oid bigint, obj_kind string"
)
# Every kind of object in one shape; a schema is an object of kind 'N' inside itself.
ALL_OBJECTS = (
    "db_id", "schema_oid", "obj_kind", "obj_oid", "obj_name", "owner_oid", "has_acl",
)
# Every ACL entry in one shape; column_name is set for entries of columns (kind 'A') only.
ALL_ACL = (
    "db_id", "schema_oid", "obj_kind", "obj_oid", "column_name", "owner_oid", "grantee_oid",
    "codes", "grantable",
)
