import pytest
from pyspark.sql import functions as F

from grantlens.operators import acl
from grantlens.operators.diagnostics import (
    default_acl_anomalies,
    describe_anomalies,
    diagnose_rights,
    effective_privileges,
    owner_anomalies,
    privilege_anomalies,
)
from grantlens.sources import catalog, stores
from tests.test_roles import ROLES

OBJ = "db_id bigint, schema_oid bigint, obj_kind string, obj_oid bigint, obj_name string, owner_oid bigint, has_acl boolean"
ACL = "db_id bigint, schema_oid bigint, obj_kind string, obj_oid bigint, column_name string, owner_oid bigint, grantee_oid bigint, codes string, grantable boolean"


def test_text_acl(spark, rows):
    items = ['"o=x ""y"""=r*w/own', "=r/own", "bob=/own", "amy=rZ/\"a/b\"", "nograntor=d"]
    df = spark.createDataFrame([(1, items), (2, []), (3, None)], "obj_oid int, acl array<string>")
    assert rows(acl.explode_acl(df), "obj_oid", "grantor", "grantee", "privilege", "grantable") == [
        (1, "", "nograntor", "DELETE", False),
        (1, '"a/b"', "amy", "SELECT", False),
        (1, "own", '"o=x ""y"""', "SELECT", True),
        (1, "own", '"o=x ""y"""', "UPDATE", False),
        (1, "own", "0", "SELECT", False),
    ]


def test_struct_acl(spark, rows):
    df = spark.createDataFrame(
        [(1, [(10, 0, "SELECT", False), (10, 5, "UPDATE", True)]), (2, None)],
        "obj_oid int, acl array<struct<grantor:bigint,grantee:bigint,privilege:string,grantable:boolean>>",
    )
    assert rows(acl.explode_acl(df)) == [(1, 10, 0, "SELECT", False), (1, 10, 5, "UPDATE", True)]


@pytest.fixture(scope="module")
def small(spark):
    roles = spark.createDataFrame(
        [(1, "prod", False, False, False, True), (2, "edit", False, False, False, True),
         (3, "read", False, False, False, True), (4, "other", False, False, False, True)], ROLES)
    objects = spark.createDataFrame(
        [
            (0, 50, "r", 100, "nullacl", 1, False),
            (0, 50, "r", 101, "emptyacl", 1, True),
            (0, 50, "X", 102, "fun", 1, True),
            (0, 50, "N", 50, "s", 1, False),
            (0, 51, "r", 103, "elsewhere", 4, True),
        ],
        OBJ,
    )
    entries = spark.createDataFrame(
        [
            (0, 50, "X", 102, None, 1, 4, "X", True),
            (0, 50, "X", 102, None, 1, 4, "X", False),
            (0, 50, "A", 101, "c", None, 4, "r", False),
            (0, 51, "r", 103, None, 4, 0, "r", False),
        ],
        ACL,
    )
    registry = spark.createDataFrame(
        [(0, "a", False, None, None, "s", 50, True, "prod", 1, "edit", 2, "public", 0),
         (0, "b", False, None, None, "t", None, False, "prod", None, None, None, None, None)],
        "db_id bigint, block string, in_nomenclature boolean, level1 string, level2 string, schema_name string, "
        "schema_oid bigint, is_created boolean, producer string, producer_oid bigint, editor string, editor_oid bigint, "
        "reader string, reader_oid bigint",
    )
    return roles, objects, entries, registry


def test_null_acl_is_not_an_empty_acl(small, rows):
    _, objects, entries, _ = small
    lost = rows(acl.owner_missing_privileges(objects, entries), "obj_oid", "privilege")
    assert {o for o, _ in lost} == {101, 102, 103}
    assert [p for o, p in lost if o == 102] == ["EXECUTE"]
    assert len([p for o, p in lost if o == 101]) == 7


def test_fused_aggregation_equals_its_parts(small, rows):
    _, objects, entries, _ = small
    parts = acl.role_privileges(entries).unionByName(
        acl.owner_missing_privileges(objects, entries)
    ).unionByName(acl.public_privileges(entries))
    columns = ["obj_kind", "obj_oid", "column_name", "role_oid", "verb", "privilege"]
    assert rows(acl.all_privileges(objects, entries, True), *columns) == rows(parts, *columns)


def test_anomalies(small, rows):
    roles, objects, entries, registry = small
    got = rows(
        privilege_anomalies(objects, entries, registry, roles), "obj_kind", "obj_oid", "role_oid", "function", "privilege", "anomaly"
    )
    # nothing expected from the owner where the ACL is NULL, but the functions still count
    assert [g for g in got if g[1] == 100] == [
        ("r", 100, 0, "reader", "SELECT", "missing"),
        ("r", 100, 2, "editor", "DELETE", "missing"), ("r", 100, 2, "editor", "INSERT", "missing"),
        ("r", 100, 2, "editor", "SELECT", "missing"), ("r", 100, 2, "editor", "UPDATE", "missing"),
    ]
    assert {g for g in got if g[1] == 102} == {
        ("X", 102, 4, None, "EXECUTE", "extra"), ("X", 102, 4, None, "EXECUTE", "extra with grant option"),
        ("X", 102, 0, "public", "EXECUTE", "missing"), ("X", 102, 1, "owner", "EXECUTE", "missing"),
    }
    assert ("A", 101, 4, None, "SELECT", "extra") in got
    assert not [g for g in got if g[1] == 103]  # the schema is not registered
    assert ("N", 50, 2, "editor", "USAGE", "missing") in got


def test_missing_fixed_right_is_critical(small, rows, spark):
    roles, objects, entries, registry = small
    fixed = spark.createDataFrame([("s", "s", "N", 4, "U")], "schema_name string, obj_name string, obj_kind string, role_oid bigint, codes string")
    got = rows(privilege_anomalies(objects, entries, registry, roles, fixed).where("is_critical"), "obj_kind", "role_oid", "privilege", "anomaly")
    assert got == [("N", 4, "USAGE", "missing")]


def test_effective_privileges_walk_the_smaller_side(small, rows, spark):
    roles, objects, _, _ = small
    crowd = [(0, 51, "r", 103, None, 4, 1000 + i, "r", False) for i in range(500)]
    entries = spark.createDataFrame(crowd + [(0, 51, "r", 103, None, 4, 3, "w", False)], ACL)
    closure = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (4, 4)] + [(9, i) for i in range(2000)], "member_oid bigint, role_oid bigint")
    asked = spark.createDataFrame([(2, 103), (4, 103), (9, 103), (1, 100), (2, 100)], "user_oid bigint, obj_oid bigint")
    got = {(u, o): m for u, o, m in rows(effective_privileges(asked, objects, entries, roles, closure))}
    assert got[(2, 103)] == 4 and (4, 103) not in got and got[(9, 103)] & 5 == 5
    assert got[(1, 100)] == 127 and (2, 100) not in got


def test_relation_names(small, rows, spark):
    _, objects, _, _ = small
    namespaces = spark.createDataFrame([(0, 50, "s", 1)], "db_id bigint, schema_oid bigint, schema_name string, owner_oid bigint")
    asked = spark.createDataFrame([(100,), (102,), (103,), (999,)], "obj_oid bigint")
    assert rows(acl.resolve_relation_names(asked, objects, namespaces)) == [
        (100, ["s", "nullacl"]), (102, None), (103, None), (999, None),
    ]


def test_unsupported_types(small, rows, spark):
    _, objects, entries, _ = small
    asked = spark.createDataFrame([(100, "index"), (102, "function"), (102, "table")], "obj_oid bigint, obj_type string")
    assert rows(acl.object_privileges(objects, entries, asked), "obj_oid", "error", "privilege") == [
        (100, "FSR0", None), (102, None, "EXECUTE"), (102, None, "EXECUTE"),
    ]
    assert [r[1] for r in rows(acl.object_public_privileges(entries, asked), "obj_oid", "error")] == ["FSP0", "FSP0"]


def test_command_words_follow_the_server_version(small, rows, spark):
    roles, objects, entries, _ = small
    namespaces = spark.createDataFrame([(0, 50, "My s", 1)], "db_id bigint, schema_oid bigint, schema_name string, owner_oid bigint")
    grants = acl.role_privileges(entries)
    old = rows(acl.render_commands(grants, objects, namespaces, roles, 100000), "command")
    new = rows(acl.render_commands(grants, objects, namespaces, roles), "command")
    assert ('GRANT EXECUTE ON FUNCTION "My s".fun() TO other',) in old
    assert new == [
        ('GRANT EXECUTE ON ROUTINE "My s".fun() TO other',),
        ('GRANT SELECT (c) ON TABLE "My s".emptyacl TO other',),
    ]


def test_dependencies(spark, rows):
    depend = spark.createDataFrame(
        [
            (1, "pg_rewrite", 40, "pg_class", 7, 0, "n"),
            (1, "pg_rewrite", 40, "pg_class", 5, 0, "n"),  # the view itself
            (1, "pg_class", 8, "pg_class", 7, 1, "a"),
            (1, "pg_class", 8, "pg_class", 7, 0, "a"),
            (1, "pg_type", 30, "pg_class", 7, 0, "i"),
        ],
        "db_id bigint, classid string, objid bigint, refclassid string, refobjid bigint, refobjsubid int, deptype string",
    )
    rewrite = spark.createDataFrame([(1, 40, 5, "_RETURN", "1", "O", True), (1, 41, 6, "_RETURN", "1", "D", True)],
        "db_id bigint, oid bigint, ev_class bigint, rulename string, ev_type string, ev_enabled string, is_instead boolean")
    classes = spark.createDataFrame([(1, 8, "seq", "S")], "db_id bigint, oid bigint, relname string, relkind string")
    base = 1 << 32
    assert rows(catalog.read_view_sources(depend, rewrite)) == [(base + 5, base + 7)]
    assert rows(catalog.read_owned_relations(depend, classes, "S")) == [(base + 7, base + 8, "seq")]
    assert rows(catalog.read_auto_types(depend)) == [(base + 30,)]
    shared = spark.createDataFrame(
        [(3, "pg_class", 1, "pg_authid", 9), (0, "pg_database", 4, "pg_authid", 9), (3, "pg_class", 1, "pg_tablespace", 9)],
        "dbid bigint, classid string, objid bigint, refclassid string, refobjid bigint")
    assert rows(catalog.read_role_dependencies(shared)) == [(3, 9), (4, 9)]


def test_report_for_targets(small, rows, spark):
    roles, objects, entries, registry = small
    default_acl = spark.createDataFrame([(0, 50, 1, "r", 4, "r"), (0, 50, 1, "n", 4, "U")],
        "db_id bigint, schema_oid bigint, grantor_oid bigint, obj_type string, grantee_oid bigint, codes string")
    sources = spark.createDataFrame([], "view_oid bigint, source_oid bigint")
    closure = roles.select(F.col("role_oid").alias("member_oid"), "role_oid")
    inputs = (objects, entries, default_acl, sources, registry, roles, closure)
    targets = spark.createDataFrame([("s",), ("t",), ("nowhere",), (None,)], "schema_name string")
    everything = diagnose_rights(*inputs)
    report = diagnose_rights(*inputs, targets=targets, view_access=True)
    assert rows(report.where("anomaly = 'FDD1'"), "schema_name") == [("nowhere",), ("t",)]
    assert rows(report.where("anomaly <> 'FDD1'")) == rows(everything)
    assert rows(everything.where("anomaly = 'default privilege'"), "obj_kind") == [("default r",)]
    texts = rows(describe_anomalies(report, objects, roles), "message")
    assert ("privilege USAGE missing for the editor (edit)",) in texts and (None,) not in texts


def test_targets_of_one_database(small, rows, spark, tmp_path):
    """The same name in two databases: only the database asked about is read and reported."""
    roles, objects, entries, registry = small
    names = registry.schema.names
    other = registry.select(*[
        (F.lit(1).cast("bigint") if c == "db_id" else F.col(c) + 1000 if c == "schema_oid" else F.col(c)).alias(c) for c in names
    ])

    def elsewhere(df):
        moved = {"db_id": F.lit(1).cast("bigint"), "schema_oid": F.col("schema_oid") + 1000, "obj_oid": F.col("obj_oid") + 1000}
        return df.unionByName(df.select(*[moved.get(c, F.col(c)).alias(c) for c in df.columns]))

    filed = []
    for name, table in (("objects", elsewhere(objects)), ("acl", elsewhere(entries))):
        stores.write_by_schema(table, f"{tmp_path}/{name}")
        filed.append(spark.read.parquet(f"{tmp_path}/{name}"))
    default_acl = spark.createDataFrame([], "db_id bigint, schema_oid bigint, grantor_oid bigint, obj_type string, grantee_oid bigint, codes string")
    sources = spark.createDataFrame([], "view_oid bigint, source_oid bigint")
    closure = roles.select(F.col("role_oid").alias("member_oid"), "role_oid")
    both = registry.unionByName(other)
    targets = spark.createDataFrame([(1, "s"), (7, "s"), (1, None)], "db_id bigint, schema_name string")
    report = diagnose_rights(*filed, default_acl, sources, both, roles, closure, targets=targets)
    assert rows(report.where("anomaly = 'FDD1'"), "db_id", "schema_name") == [(7, "s")]
    whole = diagnose_rights(elsewhere(objects), elsewhere(entries), default_acl, sources, both, roles, closure)
    found = report.where("anomaly <> 'FDD1'")
    assert rows(found) == rows(whole.where("db_id = 1 and schema_name = 's'")) and rows(found)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "schema_piece" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    none = diagnose_rights(*filed, default_acl, sources, both, roles, closure, targets=targets.where("false"))
    assert rows(none) == []


def test_checks_of_views_are_planned_apart(small, spark):
    """The plan of the report is that of its other checks: the driver holds what all joins of one plan broadcast."""
    roles, objects, entries, registry = small
    default_acl = spark.createDataFrame([(0, 50, 1, "r", 4, "r")],
        "db_id bigint, schema_oid bigint, grantor_oid bigint, obj_type string, grantee_oid bigint, codes string")
    sources = spark.createDataFrame([(102, 100)], "view_oid bigint, source_oid bigint")
    closure = roles.select(F.col("role_oid").alias("member_oid"), "role_oid")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    report = diagnose_rights(objects, entries, default_acl, sources, registry, roles, closure, view_access=True)
    others = (
        owner_anomalies(objects, registry, roles), default_acl_anomalies(default_acl, registry),
        privilege_anomalies(objects, entries, registry, roles),
    )
    assert joins(report) <= sum(joins(part) for part in others)
