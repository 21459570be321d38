import random

import pytest
from pyspark.sql import functions as F

from grantlens.operators import registry as G
from grantlens.operators.replay import rename_circles, replay_changes
from grantlens.operators.roles import role_closure
from tests.test_registry import CHANGES, world  # noqa: F401

NAMED = CHANGES.replace("target_schema_oid bigint", "target_schema_name string")
NAMES = [c.split()[0] for c in NAMED.split(", ")]
KEPT = ("db_id", "schema_name", "schema_oid", "block", "producer", "editor", "reader_oid", "is_created")


def edit(i, name, new=None, block="w", op="UPDATE", **more):
    base = dict(
        change_id=i, db_id=0, op=op, target_schema_name=name, actor_oid=4, new_schema_name=name if new is None else new, new_block=block,
        new_producer="prod", new_editor=None, new_reader=None, new_created=False, new_nomenclature=False,
        new_schema_oid=None, trusted=False, is_exit=False,
    )
    return {**base, **more}


@pytest.fixture(scope="module")
def tools(spark, world):  # noqa: F811
    roles, edges, registry, namespaces, creators = world
    closures = [role_closure(roles, edges).cache(), role_closure(roles, edges, "member").cache()]
    row = (0, "w", False, None, None, "w_p", None, False, "prod", None, None, None, None, None)
    more = spark.createDataFrame([(*row[:5], f"w_{n}", *row[6:]) for n in "pqrst"], registry.schema)
    registry = registry.unionByName(more).cache()

    def review(changes, registry):
        return G.review_changes(changes, registry, roles, namespaces, creators, *closures)

    def frame(edits):
        return spark.createDataFrame([tuple(e[n] for n in NAMES) for e in edits], NAMED)

    return registry, namespaces, review, frame


def table(df):
    return sorted(map(tuple, df.select(*KEPT).collect()), key=str)


def test_swap_circle_and_chain(tools):
    registry, namespaces, review, frame = tools
    edits = [
        edit(1, "w_p", "w_q", new_editor="makers"), edit(2, "w_q", "w_p"),  # a swap
        edit(3, "w_r", "w_fresh"), edit(4, "w_fresh", "w_last"), edit(5, "w_s", "w_r"),  # a chain, and a name set free
        edit(6, "w_s", op="DELETE"), edit(7, "w_t", new_editor="makers"), edit(8, "w_t", new_editor="owner_now"),
        edit(9, None, "w_none"), edit(10, "w_t", ""),
    ]
    after, answers = replay_changes(frame(edits), registry, namespaces, review)
    got = {r.schema_name: r for r in after.collect()}
    assert got["w_q"].editor == "makers" and got["w_p"].editor is None
    assert "w_last" in got and "w_fresh" not in got and "w_r" in got and "w_s" not in got
    assert got["w_t"].editor == "owner_now"
    codes = {r.change_id: (r.round, list(r.codes)) for r in answers.collect()}
    assert codes[1] == codes[2] == (1, []) and codes[4] == (2, []) and codes[5][1] == []
    assert codes[6] == (3, ["NO_ROW"]) and codes[8][0] == 2 and len(codes) == 10
    assert after.count() == registry.count() + 1  # w_none


def test_circle_is_refused_as_a_whole(tools):
    registry, namespaces, review, frame = tools
    edits = [edit(1, "w_p", "w_q"), edit(2, "w_q", "w_r", "Z"), edit(3, "w_r", "w_p")]
    after, answers = replay_changes(frame(edits), registry, namespaces, review)
    assert table(after) == table(registry)
    assert {r.change_id: list(r.codes) for r in answers.collect()} == {1: ["TB10"], 2: ["TB14", "TB10"], 3: ["TB10"]}


def test_no_edits(tools):
    registry, namespaces, review, frame = tools
    after, answers = replay_changes(frame([]), registry, namespaces, review)
    assert table(after) == table(registry) and answers.count() == 0


def test_circles(spark, tools):
    frame = tools[3]
    rng, edits, want = random.Random(5), [], {}
    for length in (2, 3, 4, 7, 16, 33):
        ids = rng.sample(range(length * 1000, length * 1000 + 500), length)
        for k, i in enumerate(ids):
            edits.append(edit(i, f"n{length}_{k}", f"n{length}_{(k + 1) % length}"))
            want[i] = min(ids)
    edits += [edit(k, f"path{k}", f"path{k + 1}") for k in range(40)]
    edits += [edit(101, "u", "v"), edit(102, "v", "u"), edit(103, "x", "u")]  # u is taken twice: no circle
    assert {r.change_id: r.unit for r in rename_circles(frame(edits)).collect()} == want


def test_against_one_at_a_time(tools):
    """Without circles: as if every edit had been reviewed and applied alone."""
    registry, namespaces, review, frame = tools
    edits = [
        edit(0, "w_p", "w_new"), edit(1, "w_new", "p", None), edit(2, "w_q", op="INSERT"), edit(3, "w_q", "w_p"),
    ]
    changes = frame(edits)
    assert not rename_circles(changes).count()
    one = registry
    codes = {}
    for i in range(len(edits)):
        reviewed = review(changes.where(F.col("change_id") == i), one)
        codes[i] = list(reviewed.first().codes)
        one = registry.sparkSession.createDataFrame(G.apply_registry_changes(one, reviewed, namespaces).select(*registry.columns).collect(), registry.schema)
    after, answers = replay_changes(changes, registry, namespaces, review)
    assert {r.change_id: list(r.codes) for r in answers.collect()} == codes
    assert table(after) == table(one)
