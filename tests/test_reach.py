"""A closure kept by classes holds no pairs and answers as the pairs do."""

from pyspark.sql import functions as F

from grantlens.operators import roles as R
from grantlens.operators.diagnostics import effective_privileges
from grantlens.operators.registry import _creators_reached

ROLES = "role_oid bigint, role_name string, can_login boolean, is_super boolean, can_create_role boolean, inherits boolean"
EDGES = "role_oid bigint, member_oid bigint, admin_option boolean"


def crowd(spark, n):
    """n logins in a group, which holds a hub, which holds n roles, some of which hold the hub again."""
    ids = [1, 2, 3] + [100 + i for i in range(n)] + [10_000 + i for i in range(n)]
    roles = [(i, f"r{i}", i >= 10_000, i == 10_005, i in (2, 104, 10_001), i != 10_007) for i in ids]
    edges = [(2, 1, False)] + [(100 + i, 2, i == 3) for i in range(n)] + [(1, 10_000 + i, False) for i in range(n)]
    edges += [(2, 100, False), (2, 100, True), (77, 1, False), (3, 88, False)]  # a circle, a role and a member that are gone
    return spark.createDataFrame(roles, ROLES), spark.createDataFrame(edges, EDGES)


def walked(roles, edges, mode):
    held = {r["role_oid"]: r["inherits"] for r in roles.collect()}
    onward = {}
    for e in edges.collect():
        if held.get(e["member_oid"]) or (mode == "member" and e["member_oid"] in held):
            onward.setdefault(e["member_oid"], set()).add(e["role_oid"])
    pairs = set()
    for start in held:
        seen, todo = {start}, [start]
        while todo:
            new = onward.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        pairs |= {(start, x) for x in seen}
    return sorted(pairs)


def test_pairs_are_those_of_a_walk(spark, rows):
    roles, edges = crowd(spark, 20)
    for mode in ("usage", "member"):
        assert sorted(rows(R.role_closure(roles, edges, mode), "member_oid", "role_oid")) == walked(roles, edges, mode)


def test_rows_grow_with_roles_not_with_pairs(spark):
    roles, edges = crowd(spark, 400)
    reach = R.role_reach(roles, edges)
    kept = reach.members.count() + reach.classes.count()
    assert kept < 4 * roles.count() < reach.pairs().count() / 20


def test_operators_answer_as_with_pairs(spark, rows):
    roles, edges = crowd(spark, 12)
    reach = R.role_reach(roles, edges)
    pairs = spark.createDataFrame(walked(roles, edges, "usage"), "member_oid bigint, role_oid bigint").cache()
    ids = roles.select("role_oid").union(spark.createDataFrame([(88,), (77,), (None,), (0,)], "x bigint"))
    asked = ids.select(F.col("role_oid").alias("a")).crossJoin(ids.select(F.col("role_oid").alias("b")))
    asked = asked.withColumn("c", F.col("b") + 1)
    named = asked.select(F.concat(F.lit("r"), "a").alias("parent"), F.concat(F.lit("r"), "b").alias("child"))
    creators = spark.createDataFrame([(1, 2), (2, 104), (2, 10_001), (1, 2)], "db_id bigint, role_oid bigint")
    edits = ids.select(F.col("role_oid").alias("actor_oid")).crossJoin(spark.range(1, 3).withColumnRenamed("id", "db_id"))
    registry = roles.select(
        (F.col("role_oid") % 3).alias("db_id"), F.concat(F.lit("s"), "role_oid").alias("schema_name"),
        F.col("role_oid").alias("schema_oid"), (F.col("role_oid") % 2 == 0).alias("is_created"),
        F.col("role_name").alias("producer"), F.when(F.col("role_oid") % 4 == 0, F.col("role_oid") + 1).alias("producer_oid"),
    )
    objects = spark.createDataFrame(
        [(0, 5, "r", i, f"o{i}", 100 + i, i % 2 == 0) for i in range(8)],
        "db_id bigint, schema_oid bigint, obj_kind string, obj_oid bigint, obj_name string, owner_oid bigint, has_acl boolean",
    )
    grants = [(i, g, "r" if g % 2 else "w") for i in range(0, 8, 2) for g in (0, 1, 2, 100 + i, 103, 10_004)[i // 2:]]
    acl = spark.createDataFrame(grants, "obj_oid bigint, grantee_oid bigint, codes string").withColumns(
        {"obj_kind": F.lit("r"), "column_name": F.lit(None).cast("string")}
    )
    wanted = ids.select(F.col("role_oid").alias("user_oid")).crossJoin(objects.select("obj_oid"))
    some = spark.createDataFrame([(3,), (10_007,)], "role_oid bigint")
    for ask in (
        lambda c: R.has_role(asked, c, roles, "a", "b", "f"),
        lambda c: R.has_roles(asked, c, roles, "a", {"b": "fb", "c": "fc"}),
        lambda c: R.has_role_usage(named, c, roles),
        lambda c: R.has_named_role(asked, c, roles, "a", "r2", "f"),
        lambda c: R.acting_as(ids, "role_oid", "f", c, roles, "r1", some),
        lambda c: R.acting_as(ids, "role_oid", "f", c, roles, "r3"),
        lambda c: R.pick_grantor(ids, roles, edges, c, "r103"),
        lambda c: R.pick_grantor(ids, roles.withColumn("can_create_role", F.lit(False)), edges, c, "r103"),
        lambda c: R.logins_missing_role(roles, edges, "r104", False, c),
        lambda c: R.admin_membership_gaps(registry, roles, edges, c, "r2"),
        lambda c: R.visible_registry(ids, registry, roles, c, "r3"),
        lambda c: R.registry_visibility(ids, registry, roles, c, "r3"),
        lambda c: _creators_reached(edits, creators, roles, c),
        lambda c: effective_privileges(wanted, objects, acl, roles, c),
    ):
        got, want = ask(reach), ask(pairs)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
