import threading

import pytest
from pyspark.sql import functions as F

from grantlens.operators import roles as R
from grantlens.sources import stores


def table(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_one_of_two_writers_is_refused(spark, rows, tmp_path):
    root = f"{tmp_path}/registry"
    assert stores.read_committed(spark, root) == (None, None)
    assert stores.commit(table(spark, "a"), root, None) == 0
    assert stores.commit(table(spark, "a", "b"), root, 0) == 1
    for late in (0, None, 7):
        with pytest.raises(stores.Conflict):
            stores.commit(table(spark, "a", "c"), root, late)
    version, last = stores.read_committed(spark, root)
    assert version == 1 and rows(last) == [("a",), ("b",)]
    assert rows(stores.read_committed(spark, root, 0)[1]) == [("a",)]
    assert len(list((tmp_path / "registry" / "data").iterdir())) == 2  # nothing is left of what was refused


def test_the_manifest_decides(spark, rows, tmp_path, monkeypatch):
    """Both writers have looked and written their data; the number can be taken once only."""
    root = f"{tmp_path}/registry"
    stores.commit(table(spark, "a"), root, None)
    stores.commit(table(spark, "a", "b"), root, 0)
    monkeypatch.setattr(stores, "committed", lambda *_: 0)  # the second looked before the first was done
    with pytest.raises(stores.Conflict):
        stores.commit(table(spark, "a", "c"), root, 0)
    assert rows(stores.read_committed(spark, root)[1]) == [("a",), ("b",)]
    assert len(list((tmp_path / "registry" / "data").iterdir())) == 2


def test_nothing_is_lost_between_writers(spark, rows, tmp_path):
    root = f"{tmp_path}/registry"
    stores.commit(table(spark), root, None)

    def write(name):
        stores.commit_changes(spark, root, lambda old: old.union(table(spark, name)), attempts=50)

    threads = [threading.Thread(target=write, args=(f"n{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(stores.read_committed(spark, root)[1]) == [(f"n{i}",) for i in range(4)]
    assert stores.committed(spark, root) == 4


ROLES = "role_oid bigint, role_name string, can_login boolean, is_super boolean, can_create_role boolean, inherits boolean"


@pytest.fixture
def graph(spark):
    roles = spark.createDataFrame([(i, f"r{i}", True, i == 9, False, True) for i in range(1, 10)], ROLES)
    closure = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (4, 3)], "member_oid bigint, role_oid bigint")
    return roles, closure


def test_several_roles_in_one_probe(spark, rows, graph):
    roles, closure = graph
    asked = spark.createDataFrame(
        [(1, 2, 5, None, "x"), (1, 2, 5, None, "x"), (4, None, 3, 0, "y"), (9, 2, 0, None, None), (None, 1, 2, 3, "z"), (77, 1, 1, 1, "w")],
        "who bigint, a bigint, b bigint, c bigint, note string",
    )
    many = R.has_roles(asked, closure, roles, "who", {"a": "fa", "b": "fb", "c": "fc"})
    single = asked
    for role, flag in (("a", "fa"), ("b", "fb"), ("c", "fc")):
        single = R.has_role(single, closure, roles, "who", role, flag)
    columns = ["who", "a", "b", "c", "note", "fa", "fb", "fc"]
    assert rows(many, *columns) == rows(single, *columns) and many.count() == 6
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # the closure and the superusers


def test_one_named_role(spark, rows, graph):
    roles, closure = graph
    asked = spark.createDataFrame([(1,), (2,), (4,), (9,), (None,)], "who bigint")
    assert rows(R.has_named_role(asked, closure, roles, "who", "r3", "f")) == [(None, False), (1, True), (2, False), (4, True), (9, True)]
    assert {r["f"] for r in R.has_named_role(asked, closure, roles, "who", "nobody", "f").collect()} == {False}


def test_visibility_in_short(spark, rows, graph):
    roles, closure = graph
    registry = spark.createDataFrame(
        [(0, "s", 50, True, "r2", 2), (1, "s", None, False, "r3", None), (0, "t", 51, True, "r5", 5)],
        "db_id bigint, schema_name string, schema_oid bigint, is_created boolean, producer string, producer_oid bigint",
    )
    found = R.registry_visibility(roles.select("role_oid"), registry, roles, closure, admin="r1")
    assert rows(found.where("sees_all"), "user_oid") == [(1,), (9,)]
    assert rows(found.where(~F.col("sees_all")), "user_oid", "db_id", "schema_name") == [(2, 0, "s"), (4, 1, "s")]
