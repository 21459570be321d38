import pytest
from pyspark.sql import functions as F

from grantlens.operators import maintenance, registry as G
from grantlens.operators.roles import role_closure
from tests.test_roles import ROLES

REGISTRY = (
    "db_id bigint, block string, in_nomenclature boolean, level1 string, level2 string, schema_name string, "
    "schema_oid bigint, is_created boolean, producer string, producer_oid bigint, editor string, editor_oid bigint, "
    "reader string, reader_oid bigint"
)
CHANGES = (
    "change_id bigint, db_id bigint, op string, target_schema_oid bigint, actor_oid bigint, new_schema_name string, "
    "new_block string, new_producer string, new_editor string, new_reader string, new_created boolean, "
    "new_nomenclature boolean, new_schema_oid bigint, trusted boolean, is_exit boolean"
)

# op, old name, old block, new name, new block → name, block, code
ALIGNMENT = [
    # a prefix d_ sends a schema to the trash
    ("INSERT", None, None, "d_x", None, "x", "d", None),
    ("INSERT", None, None, "d_x", "d", "x", "d", None),
    ("INSERT", None, None, "d_x", "w", "w_x", "w", None),
    ("UPDATE", "c_x", "c", "d_x", "d", "c_x", "d", None),
    ("UPDATE", "c_x", "c", "d_x", None, "c_x", "d", None),
    ("UPDATE", "c_x", "d", "d_x", "d", "c_x", "d", None),
    ("UPDATE", "x", "d", "d_x", "d", "x", "d", None),
    ("UPDATE", "d_x", "d", "d_y", "d", "d_y", "d", None),
    ("UPDATE", "x", None, "d_x", None, "x", "d", None),
    ("UPDATE", "x", None, "d_x", "d", "x", "d", None),
    ("UPDATE", "c_x", "c", "d_x", "c", "c_x", "d", None),
    ("UPDATE", "c_x", "c", "d_x", "w", "w_x", "w", None),
    # no block: taken from the name, or the prefix is dropped with it
    ("INSERT", None, None, "w_x", None, "w_x", "w", None),
    ("INSERT", None, None, "plain", None, "plain", None, None),
    ("UPDATE", "c_x", "c", "c_y", None, "y", None, None),
    ("UPDATE", "c_x", "c", "w_x", None, "w_x", "w", None),
    ("UPDATE", "x", None, "w_x", None, "w_x", "w", None),
    ("UPDATE", "x", "d", "d_x", None, "d_x", "d", None),
    # the block and the prefix differ
    ("UPDATE", "c_x", "c", "w_x", "c", "w_x", "w", None),
    ("UPDATE", "c_x", "c", "_x", "c", "_x", None, None),
    ("UPDATE", "c_x", "c", "c_x", "w", "w_x", "w", None),
    ("UPDATE", "c_x", "c", "c_x", "W", "c_x", "W", "TB14"),
    ("INSERT", None, None, "c_x", "W", "c_x", "W", "TB15"),
    ("INSERT", None, None, "c_x", "w", "w_x", "w", None),
    ("INSERT", None, None, "_x", "w", "w_x", "w", None),
    ("INSERT", None, None, "x", "W", "x", "W", "TB16"),
    ("INSERT", None, None, "x", "w", "w_x", "w", None),
    ("UPDATE", "c_x", "c", "x", "c", "x", None, None),
    ("UPDATE", "x", "d", "x", "w", "w_x", "w", None),
    ("UPDATE", "c_x", "d", "c_x", "d", "c_x", "d", None),
    ("INSERT", None, None, None, "w", None, "w", None),
    ("DELETE", "c_x", "c", "d_x", None, "d_x", None, None),
]


def test_block_and_name(spark):
    df = spark.createDataFrame(
        [(i, *case[:5]) for i, case in enumerate(ALIGNMENT)],
        "i int, op string, old_name string, old_block string, schema_name string, block string",
    )
    got = {r.i: (r.schema_name, r.block, r.align_code) for r in G.align_block_and_name(df).collect()}
    for i, case in enumerate(ALIGNMENT):
        assert got[i] == case[5:], case


@pytest.fixture(scope="module")
def world(spark):
    roles = spark.createDataFrame(
        [
            (10, "g_admin", False, False, True, True),
            (1, "prod", False, False, False, True),
            (2, "edit_new_name", False, False, False, True),
            (3, "boss", True, True, False, True),
            (4, "ann", True, False, False, True),
            (5, "zed", True, False, False, True),
            (6, "makers", False, False, False, True),
            (7, "owner_now", False, False, False, True),
        ],
        ROLES,
    )
    edges = spark.createDataFrame([(10, 4, False), (1, 10, False), (6, 4, False)], "role_oid bigint, member_oid bigint, admin_option boolean")
    registry = spark.createDataFrame(
        [
            (0, "c", False, "L1", "L2", "c_one", 100, True, "prod", 1, "edit", 2, "gone", 900),
            (0, "d", False, None, None, "c_trash", 101, True, "prod", 1, None, None, None, None),
            (0, "w", True, None, None, "w_tax", 102, True, "prod", 1, None, None, None, None),
            (0, "w", False, None, None, "w_super", 103, True, "boss", 3, None, None, None, None),
            (0, "w", False, None, None, "w_lost", 104, True, "lost", 901, None, None, None, None),
            (0, "w", False, None, None, "w_future", None, False, "prod", None, None, None, None, None),
        ],
        REGISTRY,
    )
    namespaces = spark.createDataFrame(
        [(0, 100, "c_one", 1), (0, 101, "c_trash", 1), (0, 102, "w_tax", 1), (0, 103, "w_super", 3), (0, 104, "w_lost", 7), (0, 200, "w_real", 3), (0, 201, "pg_temp_1", 3), (0, 202, "w_future", 7)],
        "db_id bigint, schema_oid bigint, schema_name string, owner_oid bigint",
    )
    creators = spark.createDataFrame([(0, 6)], "db_id bigint, role_oid bigint")
    return roles, edges, registry, namespaces, creators


def review(spark, world, edits):
    roles, edges, registry, namespaces, creators = world
    base = dict(
        db_id=0, op="UPDATE", target_schema_oid=100, actor_oid=4, new_schema_name="c_one", new_block="c",
        new_producer="prod", new_editor="edit", new_reader="gone", new_created=True, new_nomenclature=False,
        new_schema_oid=None, trusted=False, is_exit=False,
    )
    names = [c.split()[0] for c in CHANGES.split(", ")]
    data = [tuple({**base, "change_id": i, **e}[n] for n in names) for i, e in enumerate(edits)]
    changes = spark.createDataFrame(data, CHANGES)
    return G.review_changes(
        changes, registry, roles, namespaces, creators, role_closure(roles, edges), role_closure(roles, edges, "member")
    )


def test_a_review_is_planned_in_parts(spark, world):
    """A plan holds a part of the joins: the driver holds what all joins of one plan broadcast."""
    plan = review(spark, world, [dict()])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Join ") <= 6


def test_rules(spark, world):
    new = dict(op="INSERT", target_schema_oid=None, new_editor=None, new_reader=None)
    cases = [
        (dict(), []),
        ({**new, "new_schema_name": "w_n", "new_block": "w", "actor_oid": 5}, ["TB1"]),
        (dict(op="DELETE"), ["TB2"]),
        (dict(op="DELETE", is_exit=True), []),
        (dict(op="DELETE", target_schema_oid=102), ["TB2", "TB3"]),
        (dict(op="DELETE", target_schema_oid=102, is_exit=True), ["TB26"]),
        (dict(op="DELETE", target_schema_oid=555), ["NO_ROW"]),
        (dict(new_created=False), ["TB4"]),
        (dict(target_schema_oid=101, new_schema_name="c_trash", new_block="d", new_created=False, actor_oid=5), ["TB23"]),
        (dict(target_schema_oid=101, new_schema_name="c_trash", new_block="d", new_created=False), []),
        (dict(target_schema_oid=102, new_schema_name="w_tax", new_block="w", new_nomenclature=False, actor_oid=5), ["TB18"]),
        ({**new, "new_schema_name": "w_n", "new_block": "w", "new_nomenclature": True, "actor_oid": 5}, ["TB1", "TB19"]),
        (dict(new_schema_name=""), ["TB8"]),
        ({**new, "new_schema_name": "w_n", "new_block": "w", "new_schema_oid": 100, "trusted": True}, ["TB11"]),
        ({**new, "new_schema_name": "w_n", "new_block": "w", "new_schema_oid": 100}, []),
        (dict(new_schema_oid=103, trusted=True), ["TB12"]),
        (dict(new_editor="prod"), ["TB13"]),
        (dict(new_block="Z"), ["TB14"]),
        ({**new, "new_schema_name": "w_tax", "new_block": "w"}, ["TB9"]),
        (dict(new_schema_name="w_tax"), ["TB10"]),
        (dict(target_schema_oid=103, new_schema_name="w_super", new_block="w", new_producer="boss", new_editor=None, new_reader="prod"), ["TB20"]),
        (dict(target_schema_oid=103, new_schema_name="w_super", new_block="w", new_producer="boss", new_editor=None, new_reader="prod", actor_oid=3), []),
        (dict(new_producer="boss"), ["TB24"]),
        ({**new, "new_schema_name": "w_n", "new_block": "w", "new_producer": "boss"}, ["TB22"]),
        ({**new, "new_schema_name": "w_real", "new_block": "w", "new_producer": "boss"}, ["TB25"]),
    ]
    rows = {r.change_id: r for r in review(spark, world, [c for c, _ in cases]).collect()}
    for i, (case, codes) in enumerate(cases):
        assert list(rows[i].codes) == codes, case
    assert rows[9].asks_drop and not rows[7].asks_drop
    # roles that did not change follow their ids: renamed, dropped, and a producer that is gone
    assert (rows[0].editor, rows[0].reader, rows[0].clean_editor, rows[0].clean_reader) == ("edit_new_name", None, True, True)


def test_lost_producer_gives_way_to_the_owner(spark, world):
    edit = dict(target_schema_oid=104, new_schema_name="w_lost", new_block="w", new_producer="lost", new_editor=None, new_reader=None)
    row = review(spark, world, [edit]).collect()[0]
    assert (row.producer, row.producer_oid, row.clean_producer) == ("owner_now", 7, True)


def test_apply(spark, world, rows):
    roles, _, registry, namespaces, _ = world
    edits = [
        dict(new_editor="makers", new_reader=""),
        dict(op="DELETE", target_schema_oid=104, is_exit=True),
        dict(op="INSERT", target_schema_oid=None, new_schema_name="w_real", new_block="", new_producer="", new_editor="", new_reader="public"),
        dict(op="INSERT", target_schema_oid=None, new_schema_name="x", new_block="w", new_producer="", new_editor=None, new_reader=None),
        dict(op="INSERT", target_schema_oid=None, new_schema_name="w_x", new_block=None, new_producer="prod", new_editor=None, new_reader=None),
        dict(target_schema_oid=103, new_schema_name="w_super", new_block="W"),
    ]
    after = G.apply_registry_changes(registry, review(spark, world, edits), namespaces)
    got = {r[0]: r[1:] for r in rows(after, "schema_name", "schema_oid", "block", "producer_oid", "editor_oid", "reader_oid", "level1")}
    assert set(got) == {"c_one", "c_trash", "w_tax", "w_super", "w_future", "w_real", "w_x"}
    assert got["c_one"] == (100, "c", 1, 6, None, "L1")
    assert got["w_real"] == (200, "w", 10, None, 0, None)
    assert got["w_x"] == (None, "w", 10, None, None, None)  # the first of two edits keeps the name


def test_rows_that_are_not_created_are_edited_by_name(spark, world, rows):
    roles, edges, registry, namespaces, creators = world
    future = spark.createDataFrame(
        [
            (0, "w", False, "L", None, "w_wait", None, False, "prod", None, None, None, None, None),
            (0, "w", True, None, None, "w_plan", None, False, "prod", None, None, None, None, None),
            (1, "w", False, None, None, "w_wait", None, False, "prod", None, None, None, None, None),
        ],
        REGISTRY,
    )
    registry = registry.unionByName(future)
    base = dict(
        db_id=0, op="UPDATE", target_schema_name="w_wait", actor_oid=4, new_schema_name="w_wait", new_block="w",
        new_producer="prod", new_editor=None, new_reader=None, new_created=True, new_nomenclature=False,
        new_schema_oid=None, trusted=False, is_exit=False,
    )
    names = [c.split()[0] for c in CHANGES.split(", ")]
    names[names.index("target_schema_oid")] = "target_schema_name"
    edits = [
        (dict(op="DELETE"), []),
        (dict(op="DELETE", target_schema_name="w_plan"), ["TB3"]),
        (dict(op="DELETE", target_schema_name="w_nowhere"), ["NO_ROW"]),
        (dict(new_producer="boss"), ["TB21", "TB24"]),
        (dict(), []),
        (dict(op="DELETE", target_schema_name="c_one"), ["TB2"]),
        (dict(target_schema_name="w_nowhere", new_schema_name="w_fresh"), []),
    ]
    schema = CHANGES.replace("target_schema_oid bigint", "target_schema_name string")
    closures = role_closure(roles, edges), role_closure(roles, edges, "member")

    def reviewed(cases):
        data = [tuple({**base, "change_id": i, **e}[n] for n in names) for i, e in cases]
        return G.review_changes(spark.createDataFrame(data, schema), registry, roles, namespaces, creators, *closures)

    got = {r.change_id: list(r.codes) for r in reviewed([(i, e) for i, (e, _) in enumerate(edits)]).collect()}
    assert got == {i: codes for i, (_, codes) in enumerate(edits)}
    shown = lambda df: rows(df.where("schema_name like 'w_wait'"), "db_id", "is_created", "producer", "level1")
    # a deletion of the row of one database leaves the other's
    gone = G.apply_registry_changes(registry, reviewed([(0, edits[0][0])]), namespaces)
    assert shown(gone) == [(1, False, "prod", None)]
    raised = G.apply_registry_changes(registry, reviewed([(4, edits[4][0])]), namespaces)
    assert shown(raised) == [(0, True, "prod", "L"), (1, False, "prod", None)]


def test_latest_change_of_a_schema(spark, rows):
    df = spark.createDataFrame([(1, 7), (5, 7), (2, 8)], "change_id bigint, target_schema_oid bigint")
    last, older = G.latest_changes(df)
    assert rows(last, "change_id") == [(2,), (5,)] and rows(older, "change_id") == [(1,)]
    df = spark.createDataFrame([(1, 0, "a"), (5, 0, "a"), (2, 1, "a")], "change_id bigint, db_id bigint, target_schema_name string")
    assert rows(G.latest_changes(df)[0], "change_id") == [(2,), (5,)]


def test_duplicates_and_checks(spark, rows):
    df = spark.createDataFrame(
        [(0, "a", 1, None, 1, None, None), (0, "a", 2, "a", 1, 1, None), (1, "a", 2, "d", 1, 2, 2), (0, "b_x", None, "B", 1, 2, 3), (0, "c_x", 9, "c", None, None, None)],
        "db_id bigint, schema_name string, schema_oid bigint, block string, producer_oid bigint, editor_oid bigint, reader_oid bigint",
    )
    assert rows(G.registry_duplicates(df), "db_id", "kind", "key", "copies") == [(0, "name", "a", 2)]
    assert rows(G.block_name_violations(df), "schema_name", "block") == [("a", "a"), ("b_x", "B")]
    assert rows(G.role_repetition(df), "editor_oid", "reader_oid") == [(1, None), (2, 2)]


def test_registration(spark, world, rows):
    roles, _, registry, namespaces, _ = world
    got = rows(maintenance.register_unlisted_schemas(namespaces, registry, roles), "schema_name", "action", "producer")
    assert got == [("w_future", "update", "owner_now"), ("w_real", "insert", "boss")]
    kept = maintenance.register_unlisted_schemas(namespaces, registry, roles, keep_registered=True)
    assert rows(kept, "schema_name", "producer") == [("w_future", "prod"), ("w_real", "boss")]
    but = spark.createDataFrame([("w_real",)], "schema_name string")
    assert rows(maintenance.register_unlisted_schemas(namespaces, registry, roles, but), "schema_name") == [("w_future",)]


def test_deregistration(spark, world, rows):
    registry = world[2]
    asked = spark.createDataFrame([(0, "c_one"), (0, "w_tax"), (0, "nope"), (1, "c_trash")], "db_id bigint, schema_name string")
    remaining, answers = maintenance.deregister_schemas(registry, asked)
    assert rows(answers, "db_id", "schema_name", "answer") == [
        (0, "c_one", "removed"), (0, "nope", "unknown"), (0, "w_tax", "TB26"), (1, "c_trash", "unknown"),
    ]
    assert remaining.count() == registry.count() - 1


def test_taxonomy(spark, world, rows, tmp_path):
    from grantlens.sources.taxonomy import TAXONOMY, limit_domains, read_taxonomy

    data = [
        ("c", "L1", "l1", "L2", "l2", "c_one", "g_admin", None, "g_consult"),
        ("w", "", None, None, None, "w_tax", "g_admin", None, "g_consult"),
        ("p", "Other", "oth", "Z", "z", "p_new", "g_admin", None, "g_consult"),
    ]
    spark.createDataFrame(data, TAXONOMY).write.parquet(f"{tmp_path}/tax")
    taxonomy = read_taxonomy(spark, f"{tmp_path}/tax")
    one = world[2]
    got = maintenance.import_taxonomy(one, taxonomy)
    assert rows(got, "schema_name", "action") == [("c_one", "update"), ("p_new", "insert"), ("w_tax", "none")]
    other = one.limit(1).withColumn("db_id", F.lit(7).cast("bigint")).withColumn("schema_name", F.lit("p_new"))
    got = maintenance.import_taxonomy(one.unionByName(other), taxonomy).where("db_id = 7")
    assert rows(got, "schema_name", "action") == [("c_one", "insert"), ("p_new", "update"), ("w_tax", "insert")]
    assert limit_domains(taxonomy, ["oth"]).count() == 1 and limit_domains(taxonomy, ["L1"]).count() == 1
    assert limit_domains(taxonomy).count() == 3 and limit_domains(taxonomy, []).count() == 3
    assert taxonomy.where(~F.col("in_nomenclature")).count() == 0
