import pytest

from grantlens.operators import roles as R

ROLES = "role_oid bigint, role_name string, can_login boolean, is_super boolean, can_create_role boolean, inherits boolean"


@pytest.fixture(scope="module")
def graph(spark):
    roles = spark.createDataFrame(
        [
            (1, "a", True, False, False, True),
            (2, "b", False, False, False, True),
            (3, "no_inherit", False, False, False, False),
            (4, "c", False, False, True, True),
            (5, "root", True, True, False, True),
            (6, "x", False, False, False, True),
            (7, "y", False, False, False, True),
        ],
        ROLES,
    )
    edges = spark.createDataFrame(
        [
            (2, 1, False),  # a is member of b
            (3, 2, False),  # b is member of no_inherit
            (4, 3, False),  # no_inherit is member of c
            (6, 7, True), (7, 6, False),  # a cycle
            (2, 2, False),  # a role listed as member of itself
            (4, 99, False),  # an unknown member
            (2, 1, True),  # the same edge twice
        ],
        "role_oid bigint, member_oid bigint, admin_option boolean",
    )
    return roles, edges


def test_closure_stops_at_roles_without_inherit(graph, rows):
    roles, edges = graph
    itself = [(i, i) for i in range(1, 8)]
    usage = itself + [(1, 2), (1, 3), (2, 3), (6, 7), (7, 6)]
    member = usage + [(1, 4), (2, 4), (3, 4)]
    assert rows(R.role_closure(roles, edges), "member_oid", "role_oid") == sorted(usage)
    assert rows(R.role_closure(roles, edges, "member"), "member_oid", "role_oid") == sorted(member)


def test_closure_of_chosen_members(graph, rows, spark):
    roles, edges = graph
    some = spark.createDataFrame([(1,), (7,)], "u bigint")
    got = rows(R.role_closure(roles, edges, "member", some), "member_oid", "role_oid")
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (7, 6), (7, 7)]


def test_long_chain_and_wide_hub(spark):
    n = 40
    roles = spark.createDataFrame([(i, f"r{i}", False, False, False, True) for i in range(n + 300)], ROLES)
    chain = [(i + 1, i, False) for i in range(n - 1)]
    hub = [(0, n + i, False) for i in range(300)]
    edges = spark.createDataFrame(chain + hub, "role_oid bigint, member_oid bigint, admin_option boolean")
    assert R.role_closure(roles, edges).count() == n * (n + 1) // 2 + 300 * (n + 1)


def test_usage_by_name(graph, rows, spark):
    roles, edges = graph
    closure = R.role_closure(roles, edges)
    pairs = spark.createDataFrame(
        [("b", "a"), ("c", "a"), ("a", "a"), ("public", "a"), ("b", "root"), ("nobody", "root"), ("b", "nobody"), (None, "a")],
        "parent string, child string",
    )
    assert rows(R.has_role_usage(pairs, closure, roles), "parent", "child", "has_usage") == [
        (None, "a", False), ("a", "a", True), ("b", "a", True), ("b", "nobody", False), ("b", "root", True),
        ("c", "a", False), ("nobody", "root", False), ("public", "a", False),
    ]


def test_grantors(graph, rows, spark):
    roles, edges = graph
    member = R.role_closure(roles, edges, "member")
    users = roles.select("role_oid")
    got = {r[0]: (r[1], r[2]) for r in rows(R.pick_grantor(users, roles, edges, member, "x"))}
    assert got[4] == (4, "create role") and got[1] == (4, "create role") and got[5] == (4, "create role")
    # y holds the admin option on x, and x is member of y
    assert got[6] == (7, "admin option") and got[7] == (7, "admin option")


def test_logins_missing_a_role(graph, rows):
    roles, edges = graph
    member = R.role_closure(roles, edges, "member")
    assert rows(R.logins_missing_role(roles, edges, "no_inherit")) == [(1, "GRANT no_inherit TO a")]
    assert rows(R.logins_missing_role(roles, edges, "no_inherit", False, member)) == []
    assert rows(R.logins_missing_role(roles, edges, "absent")) == []


def test_role_databases(spark, rows):
    deps = spark.createDataFrame([(3, 1), (1, 1), (3, 1), (2, 5)], "db_id bigint, role_oid bigint")
    assert rows(R.role_databases(deps), "role_oid", "databases") == [(1, [1, 3]), (5, [2])]
