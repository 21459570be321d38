import itertools
import random

import pytest
from pyspark.sql import functions as F

from grantlens.operators import policies
from grantlens.operators.roles import role_closure
from grantlens.plans import defaults, grants, move, ownership, reassign, reset
from tests.test_acl import ACL, OBJ
from tests.test_registry import REGISTRY
from tests.test_roles import ROLES

NAMESPACES = "db_id bigint, schema_oid bigint, schema_name string, owner_oid bigint"
NAMES = {1: "p1", 2: "p2", 3: "r3", 4: "r4", 5: "r5", 6: "r6", 10: "g_admin", 11: "other", 12: "g_consult"}
TABLE = {"r": "SELECT", "w": "UPDATE", "a": "INSERT", "d": "DELETE", "D": "TRUNCATE", "x": "REFERENCES", "t": "TRIGGER"}


@pytest.fixture(scope="module")
def roles(spark):
    return spark.createDataFrame(
        [(oid, name, False, False, oid == 10, True) for oid, name in NAMES.items()]
        + [(20, "boss", False, True, False, True), (21, "login", True, False, False, True)],
        ROLES,
    )


@pytest.fixture(scope="module")
def nobody(spark):
    return spark.createDataFrame([], "role_oid bigint, member_oid bigint, admin_option boolean")


def registry_row(oid, producer, editor=None, reader=None, created=True, block="s", name=None):
    def ref(r):
        return None if r is None else "public" if r == 0 else NAMES.get(r, {20: "boss", 21: "login"}.get(r, "gone"))

    name = name or f"s_{oid}"
    if not created:
        return (0, block, False, None, None, name, None, False, ref(producer), None, ref(editor), None, ref(reader), None)
    return (0, block, False, None, None, name, oid, True, ref(producer), producer, ref(editor), editor, ref(reader), reader)


def moved_by_hand(v, old, new, held, owner):
    """Actions on one table, rule by rule. ``held``: role → privileges (public: 0)."""
    (p, e, l), (np_, ne, nl) = old, new
    owned = set(TABLE.values())
    rows = {r: [("GRANT", x) for x in sorted(xs)] for r, xs in held.items() if r != owner}
    rows[owner] = [("REVOKE", x) for x in sorted(owned - held.get(owner, set()))]
    flip = {"GRANT": "REVOKE", "REVOKE": "GRANT"}
    out = []

    def revert(step, who, to):
        out.extend((step, flip[verb], x, to) for verb, x in rows.get(who, []))

    def copy(step, who, to):
        out.extend((step, verb, x, to) for verb, x in rows.get(who, []))

    if owner != np_:
        out.append((1, "OWNER", None, np_))
    if v in (2, 6):
        revert(2, p, np_)
    if ne is not None and (e is None or e != ne) and p != ne and v != 4:
        revert(3, ne, ne)
    if e is not None and e != np_ and (ne is None or e != ne or v not in (1, 3)) and v != 4:
        revert(4, e, e)
    if e is not None and ne is not None and v in (1, 3) and e != ne:
        copy(5, e, ne)
    if ne is not None and (v in (2, 5, 6) or e is None) and v != 4:
        out.append((6, "GRANT", "SELECT, INSERT, UPDATE, DELETE", ne))
    if nl is not None and (l is None or l != nl) and p != nl and (e is None or e != nl) and v != 4:
        revert(7, nl, nl)
    if l is not None and l != np_ and (ne is None or l != ne) and (nl is None or l != nl or v not in (1, 3)) and v != 4:
        revert(8, l, l)
    if l is not None and nl is not None and v in (1, 3) and l != nl:
        copy(9, l, nl)
    if nl is not None and (v in (2, 5, 6) or l is None) and v != 4:
        out.append((10, "GRANT", "SELECT", nl))
    if v in (2, 3, 5):
        for who in rows:
            if who not in (p, e, l, np_, ne, nl):
                revert(11, who, who)
    return out


def test_moves_by_variant(spark, rows, roles):
    rnd = random.Random(3)
    functions = []
    for p in (1, 2):
        for e, l in itertools.product((None, 0, 3, 4, 5), repeat=2):
            if e is None or e != l:
                functions.append((p, e, l))
    registry, moves, objects, entries, expected = [], [], [], [], []
    for i in range(180):
        old, new = rnd.choice(functions), rnd.choice(functions)
        source, target, obj, v = 1000 + 2 * i, 1001 + 2 * i, 50000 + i, 1 + i % 6
        owner = rnd.choice([old[0], new[0], 6])
        registry += [registry_row(source, *old), registry_row(target, *new)]
        moves.append((obj, source, target, v))
        objects.append((0, source, "r", obj, f"t{i}", owner, True))
        held = {}
        for who in rnd.sample([0, 1, 2, 3, 4, 5, 6, 11], 4):
            codes = "".join(rnd.sample("rawdDxt", 2))
            held[who] = {TABLE[c] for c in codes}
            entries.append((0, source, "r", obj, None, owner, who, codes, rnd.random() < 0.2))
        expected += [(obj, step, verb, x, to) for step, verb, x, to in moved_by_hand(v, old, new, held, owner)]
    registry = spark.createDataFrame(registry, REGISTRY)
    namespaces = registry.select("db_id", "schema_oid", "schema_name", F.col("producer_oid").alias("owner_oid"))
    plan = move.move_object_plan(
        spark.createDataFrame(moves, "obj_oid bigint, source_schema_oid bigint, target_schema_oid bigint, variant bigint"),
        spark.createDataFrame(objects, OBJ), spark.createDataFrame(entries, ACL), registry, namespaces, roles,
        spark.createDataFrame([], "table_oid bigint, sequence_oid bigint"),
    )
    got = rows(plan.where("step > 0"), "obj_oid", "step", "verb", "privilege", "role_oid")
    assert got == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert plan.where("step = 0").count() == 180 and plan.where("command IS NULL").count() == 0


def test_owned_sequence_follows_and_conflicts_stop(spark, rows, roles):
    registry = spark.createDataFrame([registry_row(100, 1, 3), registry_row(101, 2, None, 12), registry_row(102, 2, created=False)], REGISTRY)
    namespaces = spark.createDataFrame([(0, 100, "s_100", 1), (0, 101, "s_101", 2)], NAMESPACES)
    objects = spark.createDataFrame(
        [(0, 100, "p", 1, "t", 1, False), (0, 100, "S", 2, "t_seq", 1, False), (0, 100, "r", 3, "dup", 1, False), (0, 101, "v", 4, "dup", 2, False),
         (0, 100, "X", 5, "dup", 1, False), (0, 100, "r", 6, "u", 1, False)], OBJ)
    owned = spark.createDataFrame([(1, 2)], "table_oid bigint, sequence_oid bigint")
    indexes = spark.createDataFrame([(6, 100, "pk", True), (9, 101, "pk", False), (1, 100, "ix", False)], "table_oid bigint, schema_oid bigint, index_name string, is_constraint boolean")
    moves = spark.createDataFrame([(1, 100, 101, 2), (3, 100, 101, 1), (5, 100, 101, 1), (6, 100, 101, 1), (7, 100, 101, 1), (1, 100, 102, 1)],
                                  "obj_oid bigint, source_schema_oid bigint, target_schema_oid bigint, variant bigint")
    conflicts = move.move_conflicts(moves, objects, owned, indexes)
    assert rows(conflicts, "obj_oid", "error", "name") == [(3, "FDO8", "dup"), (6, "FDO9", "pk")]
    plan = move.move_object_plan(moves, objects, spark.createDataFrame([], ACL), registry, namespaces, roles, owned, conflicts)
    assert rows(plan.where("error IS NOT NULL"), "obj_oid", "error") == [(1, "FDO3"), (3, "FDO8"), (6, "FDO9"), (7, "FDO5")]
    assert rows(plan.where("moved_oid = 1 AND error IS NULL"), "command") == sorted([
        ("ALTER SEQUENCE s_101.t_seq OWNER TO p2",), ("ALTER TABLE s_100.t SET SCHEMA s_101",), ("ALTER TABLE s_101.t OWNER TO p2",),
        ("GRANT SELECT ON SEQUENCE s_101.t_seq TO g_consult",), ("GRANT SELECT ON TABLE s_101.t TO g_consult",),
    ])


@pytest.fixture(scope="module")
def held(spark):
    registry = spark.createDataFrame(
        [registry_row(100, 1, 2, 3), registry_row(101, 3, 1, 2), registry_row(102, 3, 4, 1), registry_row(103, 2, 1, 3), registry_row(104, 1, 10, 4), registry_row(105, 1, None, 2, created=False)],
        REGISTRY,
    )
    return registry


def functions_after(rows, registry, roles, spark, x, y, **options):
    pairs = spark.createDataFrame([(x, y)], "role_oid bigint, target_oid bigint")
    return rows(reassign.reassigned_functions(pairs, registry, roles, **options), "schema_name", "new_producer", "new_editor", "new_reader")


def test_functions_of_a_replaced_role(spark, rows, roles, held):
    assert functions_after(rows, held, roles, spark, 1, 2) == [
        ("s_100", "p2", None, "r3"),  # the target leaves editor to become producer
        ("s_101", "r3", "p2", None),  # and leaves reader to become editor
        ("s_102", "r3", "r4", "p2"),
        ("s_103", "p2", None, "r3"),  # it is producer already
        ("s_104", "p2", "g_admin", "r4"),
        ("s_105", "p2", None, None),
    ]
    nobody = functions_after(rows, held, roles, spark, 1, None)
    assert nobody[0] == ("s_100", "g_admin", "p2", "r3") and nobody[1] == ("s_101", "r3", None, "p2")
    assert nobody[4] == ("s_104", "g_admin", None, "r4")


def test_target_is_forgotten_without_privileges(spark, rows, roles, held):
    got = functions_after(rows, held, roles, spark, 1, 2, with_privileges=False)
    # producers go to the admin role, yet it is the target that leaves editor and reader
    assert got[0] == ("s_100", "g_admin", None, "r3")
    assert got[1] == ("s_101", "r3", None, "p2") and got[5] == ("s_105", "g_admin", None, None)


def reassign_inputs(spark, roles, held, nobody):
    objects = spark.createDataFrame([(0, 100, "r", 1, "t", 1, True), (0, 900, "r", 2, "u", 1, True), (0, 900, "v", 3, "w", 4, True)], OBJ)
    entries = spark.createDataFrame([(0, 100, "r", 1, None, 1, 1, "rawdDx", False), (0, 900, "v", 3, None, 4, 1, "r", False)], ACL)
    default_acl = spark.createDataFrame([(0, 100, 10, "r", 1, "r"), (0, 0, 2, "S", 1, "U"), (0, 100, 10, "r", 3, "r")],
        "db_id bigint, schema_oid bigint, grantor_oid bigint, obj_type string, grantee_oid bigint, codes string")
    outer = spark.createDataFrame([("DATABASE", "Db", 1, "CT"), ("LANGUAGE", "l", 3, "U")], "obj_class string, obj_name string, grantee_oid bigint, codes string")
    namespaces = spark.createDataFrame([(0, 100, "s_100", 1), (0, 900, "free", 4)], NAMESPACES)
    return objects, entries, default_acl, outer, held, namespaces, roles, role_closure(roles, nobody)


def test_replacing_a_role(spark, rows, roles, held, nobody):
    inputs = reassign_inputs(spark, roles, held, nobody)
    pairs = spark.createDataFrame([(1, 2), (77, 2), (3, 78)], "role_oid bigint, target_oid bigint")
    plan = reassign.reassign_role_plan(pairs, *inputs)
    assert rows(plan.where("step = 'check'"), "replaced_oid", "error") == [(3, "FRR2"), (77, "FRR1")]
    assert rows(plan.where("step IN ('owned', 'grants', 'outer')"), "command") == sorted([
        ("ALTER TABLE free.u OWNER TO p2",), ("ALTER TABLE s_100.t OWNER TO p2",),
        ("GRANT TRIGGER ON TABLE s_100.t TO p1",), ("REVOKE TRIGGER ON TABLE s_100.t FROM p2",),
        ("REVOKE SELECT ON TABLE free.w FROM p1",), ("GRANT SELECT ON TABLE free.w TO p2",),
        *[(f"GRANT {x} ON TABLE free.u TO p1",) for x in TABLE.values()], *[(f"REVOKE {x} ON TABLE free.u FROM p2",) for x in TABLE.values()],
        *[(f"REVOKE {x} ON DATABASE \"Db\" FROM p1",) for x in ("CREATE", "TEMPORARY")], *[(f"GRANT {x} ON DATABASE \"Db\" TO p2",) for x in ("CREATE", "TEMPORARY")],
    ])
    assert rows(plan.where("step = 'default_acl'"), "command", "error") == [
        (None, "FRR3"), (None, "FRR3"),
        ("ALTER DEFAULT PRIVILEGES FOR ROLE g_admin IN SCHEMA s_100 GRANT SELECT ON TABLES TO p2", None),
        ("ALTER DEFAULT PRIVILEGES FOR ROLE g_admin IN SCHEMA s_100 REVOKE SELECT ON TABLES FROM p1", None),
    ]


def test_replacing_a_role_inside_the_registry_only(spark, rows, roles, held, nobody):
    inputs = reassign_inputs(spark, roles, held, nobody)
    pairs = spark.createDataFrame([(1, 2)], "role_oid bigint, target_oid bigint")
    plan = reassign.reassign_role_plan(pairs, *inputs, outside=False, with_privileges=False, with_default_acl=False)
    assert rows(plan.where("step <> 'functions'"), "command") == [("GRANT TRIGGER ON TABLE s_100.t TO p1",)]


def test_default_privileges_for_all_schemas(spark, rows, roles, nobody):
    default_acl = spark.createDataFrame([(0, 0, 10, "f", 0, "X"), (0, 5, 10, "q", 3, "r")],
        "db_id bigint, schema_oid bigint, grantor_oid bigint, obj_type string, grantee_oid bigint, codes string")
    namespaces = spark.createDataFrame([], NAMESPACES)
    plan = defaults.default_acl_plan(default_acl, namespaces, roles, role_closure(roles, nobody), "g_admin")
    assert rows(plan, "command") == [("ALTER DEFAULT PRIVILEGES FOR ROLE g_admin REVOKE EXECUTE ON ROUTINES FROM public",)]


@pytest.fixture(scope="module")
def place(spark):
    registry = spark.createDataFrame(
        [registry_row(100, 1, 3, 0), registry_row(101, 20), registry_row(102, 21), registry_row(103, 2, name="s_old"), registry_row(104, 2, 3, created=False)], REGISTRY)
    namespaces = spark.createDataFrame(
        [(0, 100, "s_100", 2), (0, 101, "s_101", 20), (0, 102, "s_102", 21), (0, 103, "s_renamed", 2), (0, 204, "s_104", 4), (0, 205, "new", 5), (0, 206, "pg_catalog", 5)], NAMESPACES)
    objects = spark.createDataFrame(
        [(0, 100, "r", 1, "t", 2, False), (0, 100, "v", 2, "w", 1, False), (0, 100, "T", 3, "t", 2, False), (0, 205, "r", 4, "n", 6, False), (0, 204, "S", 5, "q", 4, False),
         (0, 100, "N", 100, "s_100", 2, False), (0, 205, "N", 205, "new", 5, False), (0, 204, "N", 204, "s_104", 4, False), (0, 101, "N", 101, "s_101", 20, False), (0, 102, "N", 102, "s_102", 21, False)], OBJ)
    default_acl = spark.createDataFrame([], "db_id bigint, schema_oid bigint, grantor_oid bigint, obj_type string, grantee_oid bigint, codes string")
    return objects, spark.createDataFrame([], ACL), default_acl, registry, namespaces


def test_reset_of_schemas(spark, rows, roles, nobody, place):
    objects, acl, default_acl, registry, namespaces = place
    closure = role_closure(roles, nobody)
    targets = spark.createDataFrame([(0, n) for n in ("s_100", "s_old", "pg_catalog", "new", "s_104")], "db_id bigint, schema_name string")
    auto = spark.createDataFrame([(3,)], "obj_oid bigint")
    full = reset.reset_schema_plan(targets, objects, acl, default_acl, registry, namespaces, roles, closure, auto_types=auto)
    assert rows(full.where("step = 0"), "schema_name", "error") == [("pg_catalog", "FIS1"), ("s_old", "FIS2")]
    assert rows(full.where("step = 1"), "schema_name", "verb", "role_oid") == [("new", "insert", 5), ("s_104", "update", 4)]
    assert rows(full.where("step = 2"), "command") == [
        ("ALTER SCHEMA s_100 OWNER TO p1",), ("ALTER TABLE new.n OWNER TO r5",), ("ALTER TABLE s_100.t OWNER TO p1",),
    ]
    assert ("GRANT SELECT ON ALL TABLES IN SCHEMA s_100 TO public",) in rows(full.where("step = 5"), "command")
    assert ("GRANT USAGE ON SCHEMA s_104 TO r3",) in rows(full.where("step = 5"), "command")
    kept = reset.reset_schema_plan(targets, objects, acl, default_acl, registry, namespaces, roles, closure, preserve=True, keep_registered=True)
    assert rows(kept.where("step = 1"), "schema_name", "role_oid") == [("new", 5), ("s_104", 2)]
    assert {r[0] for r in rows(kept.where("step > 1"), "schema_name")} == {"s_100"}


def test_reset_of_all_schemas(spark, rows, roles, nobody, place):
    objects, acl, default_acl, registry, namespaces = place
    closure = role_closure(roles, nobody)
    inputs = (objects, acl, default_acl, registry, namespaces, roles, closure)
    plan = reset.reset_all_plan(*inputs, own_schemas=("s_100",))
    assert rows(plan.where("error = 'FAS0'"), "schema_name", "privilege") == [
        ("s_101", "super"), ("s_102", "login"), ("s_old", "missing schema"),
    ]
    assert rows(plan.where("step = 0 AND verb = 'GRANT'"), "command") == [("GRANT p1 TO g_admin",), ("GRANT p2 TO g_admin",)]
    assert {r[0] for r in rows(plan.where("schema_name = 's_100'"), "rank")} == {0}
    owners = reset.reset_all_plan(*inputs, variant=1)
    assert {r[0] for r in rows(owners.where("step > 0"), "step")} == {2}
    own = reset.reset_all_plan(*inputs, variant=2, own_schemas=("s_100", "new"))
    assert {r[0] for r in rows(own, "schema_name")} == {"s_100", "new"}
    assert ("new", "FIS3") in rows(own, "schema_name", "error")
    edges = spark.createDataFrame([(5, 10, False)], "role_oid bigint, member_oid bigint, admin_option boolean")
    own = reset.reset_all_plan(*inputs[:-1], role_closure(roles, edges), variant=2, own_schemas=("s_100", "new"))
    assert ("new", "insert") in rows(own.where("step = 1"), "schema_name", "verb")


def test_reset_of_objects(spark, rows, roles, place):
    objects, acl, _, registry, namespaces = place
    asked = spark.createDataFrame([(1, "table"), (2, "index"), (4, "table"), (1, "sequence"), (77, "view")], "obj_oid bigint, obj_type string")
    plan = reset.reset_object_plan(asked, objects, acl, registry, namespaces, roles)
    assert rows(plan.where("error IS NOT NULL"), "obj_oid", "error") == [(1, "FIO4"), (2, "FIO3"), (4, "FIO2"), (77, "FIO4")]
    assert rows(plan.where("error IS NULL"), "command") == [
        ("ALTER TABLE s_100.t OWNER TO p1",), ("GRANT SELECT ON TABLE s_100.t TO public",),
        ("GRANT SELECT, INSERT, UPDATE, DELETE ON TABLE s_100.t TO r3",),
    ]


def test_plans_of_an_actor(spark, rows, roles, place):
    objects, acl, default_acl, registry, namespaces = place
    edges = spark.createDataFrame([(1, 10, False), (5, 10, False)], "role_oid bigint, member_oid bigint, admin_option boolean")
    closure = role_closure(roles, edges)
    asked = spark.createDataFrame([(1, "table"), (2, "view")], "obj_oid bigint, obj_type string")
    plan = reset.reset_object_plan(asked, objects, acl, registry, namespaces, roles, closure, "g_admin")
    assert rows(plan.where("error IS NOT NULL"), "obj_oid", "error") == [(1, "FIO6")]
    plan = reset.reset_object_plan(asked, objects, acl, registry, namespaces, roles, closure, "r4")
    assert rows(plan, "obj_oid", "error") == [(1, "FIO5"), (2, "FIO5")]
    targets = spark.createDataFrame([(0, "s_100"), (0, "new"), (0, "s_104")], "db_id bigint, schema_name string")
    inputs = (targets, objects, acl, default_acl, registry, namespaces, roles, closure)
    plan = reset.reset_schema_plan(*inputs, as_actor=True)
    assert rows(plan.where("step = 0"), "schema_name", "error") == [("s_100", "FIS3"), ("s_104", "FIS3")]
    plan = reset.reset_schema_plan(*inputs, actor="p2", as_actor=True)
    assert rows(plan.where("step = 0"), "schema_name", "error") == [("new", "FIS3"), ("s_100", "FIS4"), ("s_104", "FIS3")]
    lent = spark.createDataFrame([(2,), (4,)], "role_oid bigint")
    assert reset.reset_schema_plan(*inputs, as_actor=True, helpers=lent).where("step = 0").count() == 0
    moves = spark.createDataFrame([(1, 100, 103, 1), (2, 100, 103, 1), (2, 103, 100, 1), (1, 103, 100, 1)], "obj_oid bigint, source_schema_oid bigint, target_schema_oid bigint, variant bigint")
    plan = move.move_object_plan(moves, objects, acl, registry, namespaces, roles, spark.createDataFrame([], "table_oid bigint, sequence_oid bigint"), None, closure, "g_admin")
    assert rows(plan.where("error IS NOT NULL"), "obj_oid", "error") == [(1, "FDO6"), (1, "FDO7"), (2, "FDO6")]


def test_ownership(spark, rows, roles, place):
    objects, _, _, registry, namespaces = place
    plan = ownership.ownership_plan(objects, registry, roles, namespaces)
    assert rows(plan, "obj_kind", "obj_oid", "is_base") == [("N", 100, False), ("T", 3, False), ("r", 1, True)]
    assert rows(ownership.ownership_counts(plan)) == [(0, "s_100", 3)]
    assert ownership.ownership_plan(objects, registry, roles, namespaces, include_schema=False).count() == 2
    renamed = ownership.rename_owner_plan(registry, namespaces, roles, objects.select("schema_oid"))
    assert ("s_old", "rename", "ALTER SCHEMA s_renamed RENAME TO s_old") in rows(renamed, "schema_name", "action", "command")
    assert ("s_100", "schema and objects", "ALTER SCHEMA s_100 OWNER TO p1") in rows(renamed, "schema_name", "action", "command")


def test_switch_of_functions(spark, rows, roles):
    objects = spark.createDataFrame([(0, 100, "r", 1, "t", 1, False), (0, 101, "r", 2, "t", 1, False)], OBJ)
    entries = spark.createDataFrame([(0, 100, "r", 1, None, 1, 3, "rw", False), (0, 101, "r", 2, None, 1, 0, "r", False)], ACL)
    namespaces = spark.createDataFrame([(0, 100, "s_100", 1), (0, 101, "s_101", 1)], NAMESPACES)
    switches = spark.createDataFrame(
        [(0, 100, "s_100", "editor", 3, 4), (0, 101, "s_101", "reader", 0, None), (0, 101, "s_101", "editor", 5, 6), (0, 100, "s_100", "reader", None, 0)],
        "db_id bigint, schema_oid bigint, schema_name string, function string, old_oid bigint, new_oid bigint")
    plan = grants.function_switch_plan(switches, objects, entries, namespaces, roles)
    assert rows(plan.where("action <> 'standard'"), "command") == sorted([
        ("GRANT SELECT ON TABLE s_100.t TO r4",), ("GRANT UPDATE ON TABLE s_100.t TO r4",), ("REVOKE SELECT ON TABLE s_100.t FROM r3",),
        ("REVOKE UPDATE ON TABLE s_100.t FROM r3",), ("REVOKE SELECT ON TABLE s_101.t FROM public",),
    ])
    assert {r[:2] for r in rows(plan.where("action = 'standard'"), "schema_name", "function")} == {("s_101", "editor"), ("s_100", "reader")}


def test_style_rules(spark, rows, roles):
    edges = spark.createDataFrame([(12, 3, False), (12, 4, False), (12, 5, False), (12, 1, False), (10, 6, False)], "role_oid bigint, member_oid bigint, admin_option boolean")
    closure = role_closure(roles, edges)
    registry = spark.createDataFrame([registry_row(100, 1, 3, 4)], REGISTRY)
    styles = spark.createDataFrame([(1, "s_100", "r3", False), (2, "s_100", "r3", True), (3, "s_100", "r4", False), (4, "nowhere", "r3", False)],
        "style_id bigint, f_table_schema string, owner string, use_as_default boolean")
    users = [1, 2, 3, 4, 5, 6, 10, 20]
    asked = spark.createDataFrame([(u, s) for u in users for s in (1, 2, 3, 4)], "user_oid bigint, style_id bigint")
    got = rows(policies.style_row_permissions(asked, styles, registry, roles, closure))
    assert len(got) == len(users) * 4 * 7
    writes = {(u, s, v) for u, s, v, _, w, _, _ in got if w}
    reads = {(u, v) for u, s, v, r, *_ in got if r}
    assert {v for u, v in reads if u == 5} == {0, 1, 2, 3, 4, 5} and not [v for u, v in reads if u == 2]
    assert {(s, v) for u, s, v in writes if u == 1} == {(s, v) for s in (1, 2, 3) for v in range(1, 6)}
    assert {(s, v) for u, s, v in writes if u == 3} == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (3, 4)}
    assert {(s, v) for u, s, v in writes if u == 4} == {(3, 5)}
    assert {(s, v) for u, s, v in writes if u == 6} == {(s, 0) for s in (1, 2, 3, 4)}  # a member of the admin role
    assert {v for u, s, v in writes if u == 10} == {0, 1, 2, 3, 4, 5}
    assert {v for u, s, v in writes if u == 20} == {0, 1, 2, 3, 4, 5, 99}
