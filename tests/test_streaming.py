import random

import pytest
from pyspark.sql import functions as F

from grantlens.model import DDL_EVENTS
from grantlens.sources import ddl_log, stores
from grantlens.streaming import events as E

SHOWN = ("schema_name", "schema_oid", "is_created", "producer_oid", "editor_oid", "reader_oid")
KNOWN = "db_id bigint, schema_name string, producer_oid bigint, editor_oid bigint, reader_oid bigint"


def server_log(seed, n=300, names=6):
    """What a server reports: ids are never given twice, names only while they are free."""
    rnd = random.Random(seed)
    live, oid, log, taken = {}, 100, [], {f"c_{i}" for i in range(names)}
    for i in range(n):
        at = i // 3  # events share timestamps
        if len(live) == len(taken) or (live and rnd.random() < 0.7):
            k = rnd.choice(sorted(live))
            if rnd.random() < 0.45:
                log.append((k, at, i, "DROP SCHEMA", live.pop(k), 0))
                continue
            if rnd.random() < 0.4:
                live[k] = f"w_{i}"  # a name that no row has
                taken.add(live[k])
            log.append((k, at, i, "ALTER SCHEMA", live[k], rnd.randrange(20)))
        else:
            name = rnd.choice(sorted(taken - set(live.values())))
            oid += 1
            live[oid] = name
            log.append((oid, at, i, "CREATE SCHEMA", name, rnd.randrange(20)))
    return log


def registry_by_hand(log, known=()):
    """The rules event by event: CREATE and DROP find their row by name, ALTER by id."""
    table = {name: [None, False, producer, editor, reader] for name, producer, editor, reader in known}
    for oid, _, _, tag, name, owner in sorted(log, key=lambda e: (e[1], e[2])):
        if tag == "CREATE SCHEMA":
            row = table.setdefault(name, [None, False, None, None, None])
            if not row[1]:
                row[:3] = [oid, True, owner]
        elif tag == "ALTER SCHEMA":
            for old in [k for k, row in table.items() if row[0] == oid]:
                row = table.pop(old)
                row[2] = owner
                table[name] = row
        elif name in table:
            table[name][:2] = [None, False]
    return sorted(((k, *row) for k, row in table.items()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def frame(spark, log, db_id=0):
    data = [(e, t, tag, oid, name, owner) for oid, t, e, tag, name, owner in log]
    df = spark.createDataFrame(data, "event_id bigint, t bigint, tag string, schema_oid bigint, schema_name string, owner_oid bigint")
    ts = F.timestamp_seconds(F.col("t") * 3600 + 1_700_000_000).cast("timestamp_ntz")
    return df.select(
        F.lit(db_id).cast("bigint").alias("db_id"), "event_id", ts.alias("ts"), "tag", F.lit("schema").alias("object_type"), "schema_oid", "schema_name", "owner_oid",
        F.lit(None).cast("bigint").alias("obj_oid"), F.lit(None).cast("string").alias("obj_kind"),
    )


def known_frame(spark, known, db_id=0):
    return spark.createDataFrame([(db_id, *k) for k in known], KNOWN)


def known_rows(names=6):
    return [(f"c_{i}", 50 + i, 60 + i, None if i % 4 == 0 else 70 + i) for i in range(0, names, 2)] + [("z_wait", 2, None, None)]


@pytest.mark.parametrize("seed", range(5))
def test_rows_go_by_name(spark, rows, seed):
    log, known = server_log(seed), known_rows()
    shuffled = log + log[::7]
    random.Random(seed).shuffle(shuffled)
    frame_known = known_frame(spark, known)
    assert rows(E.registry_from_events(frame(spark, shuffled), frame_known), *SHOWN) == registry_by_hand(log, known)


def test_names_are_those_of_a_database(spark, rows):
    """The same names and even the same ids in three databases: each has its own registry."""
    logs, known = {d: server_log(20 + d, n=120) for d in range(3)}, known_rows()
    every = [frame(spark, [(o, t, 1000 * d + e, *r) for o, t, e, *r in logs[d]], d) for d in logs]
    frame_known = known_frame(spark, known, 0).union(known_frame(spark, known, 2))
    got = E.registry_from_events(every[0].union(every[1]).union(every[2]), frame_known)
    for d in logs:
        assert rows(got.where(F.col("db_id") == d), *SHOWN) == registry_by_hand(logs[d], known if d != 1 else ())


def test_long_chains_of_renamings(spark, rows):
    """A row that goes on through forty schemas, each created under the name the last one left."""
    log, e = [], 0
    for i in range(40):
        for tag, name in (("CREATE SCHEMA", f"n_{i}"), ("ALTER SCHEMA", f"n_{i + 1}"), ("DROP SCHEMA", f"n_{i + 1}")):
            e += 1
            log.append((100 + i, e, e, tag, name, 5))
    known = [("n_0", 1, 8, 9), ("x_wait", 2, 6, 7)]
    assert rows(E.registry_from_events(frame(spark, log), known_frame(spark, known)), *SHOWN) == registry_by_hand(log, known)


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    for part in ([(1, 1, 1, "CREATE SCHEMA", "a", 1), (2, 1, E.BUCKET + 5, "CREATE SCHEMA", "b", 1)], [(3, 1, 7 * E.BUCKET, "CREATE SCHEMA", "c", 1)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        feed = ddl_log.read_ddl_events(spark, f"{tmp_path}/log", streaming=True)
        E.start_object_stream(feed, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    files = lambda buckets, before: [f.split("/seen/")[1].rsplit("/", 1)[0] for f in E.seen_events(spark, f"{tmp_path}/out", buckets, before).inputFiles()]
    assert files([0, 7], 2) == ["version=0/bucket=0", "version=1/bucket=7"]
    assert files([1], 2) == ["version=0/bucket=1"] and E.seen_events(spark, f"{tmp_path}/out", [7, 9], 1) is None


def test_work_is_done_on_new_events_only(spark, rows, tmp_path):
    for part in ([(1, 1, 1, "CREATE SCHEMA", "a", 1)], [(1, 1, 1, "CREATE SCHEMA", "a", 1), (2, 1, 2, "CREATE SCHEMA", "b", 1)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        feed = ddl_log.read_ddl_events(spark, f"{tmp_path}/log", streaming=True)
        E.start_object_stream(feed, f"{tmp_path}/out", f"{tmp_path}/check", work=lambda b: b.select(F.upper("schema_name").alias("n"))).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/rows"), "n") == [("A",), ("B",)]


def test_a_recreated_schema_keeps_one_row(spark, rows):
    log = [(100, 1, 1, "CREATE SCHEMA", "c_a", 5), (100, 2, 2, "DROP SCHEMA", "c_a", 5), (200, 3, 3, "CREATE SCHEMA", "c_a", 6)]
    known = known_frame(spark, [("c_a", 1, 8, 9)])
    assert rows(E.registry_from_events(frame(spark, log), known), *SHOWN) == [("c_a", 200, True, 6, 8, 9)]
    assert rows(E.registry_from_events(frame(spark, log[:2]), known), *SHOWN) == [("c_a", None, False, 5, 8, 9)]


def test_a_renamed_schema_takes_its_row_along(spark, rows):
    log = [
        (1, 1, 1, "CREATE SCHEMA", "c_a", 5), (1, 2, 2, "ALTER SCHEMA", "w_b", 6), (2, 3, 3, "CREATE SCHEMA", "c_a", 7),
        (1, 4, 4, "DROP SCHEMA", "w_b", 6), (3, 5, 5, "CREATE SCHEMA", "w_b", 4), (9, 1, 6, "ALTER SCHEMA", "x_y", 5),
    ]
    known = known_frame(spark, [("c_a", 1, 8, 9), ("z_wait", 2, None, None)])
    got = rows(E.registry_from_events(frame(spark, log), known), *SHOWN, "block")
    assert got == [
        ("c_a", 2, True, 7, None, None, "c"), ("w_b", 3, True, 4, 8, 9, "w"), ("z_wait", None, False, 2, None, None, "z"),
    ]


def test_states_merge_in_any_order(spark, rows):
    log = server_log(11)
    for cut in (1, 57, 299):
        late = E.fold_events(frame(spark, log[cut:]))
        both = E.fold_events(frame(spark, log[: cut + 5]), late)
        assert rows(E.registry_rows(both), *SHOWN) == registry_by_hand(log)


@pytest.mark.parametrize("compact_every", [3, 100])
def test_stream_equals_batch(spark, rows, tmp_path, compact_every):
    log, known = server_log(5, n=140), known_rows()
    # files in any order, hours apart, with copies of events seen before
    rnd = random.Random(1)
    mixed = log + log[::5]
    rnd.shuffle(mixed)
    for i in range(0, len(mixed), 24):
        frame(spark, mixed[i : i + 24]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    for _ in range(2):  # the second run has nothing to do
        feed = ddl_log.read_ddl_events(spark, f"{tmp_path}/log", streaming=True, files_per_trigger=1)
        query = E.start_registry_stream(feed, f"{tmp_path}/out", f"{tmp_path}/check", compact_every=compact_every)
        query.awaitTermination()
    state = E.read_registry_state(spark, f"{tmp_path}/out")
    assert rows(E.registry_rows(state, known_frame(spark, known)), *SHOWN) == registry_by_hand(log, known)
    parts = len(list((tmp_path / "out" / "part").iterdir()))
    assert parts == 7 if compact_every == 100 else parts < 7


def test_late_events_reach_the_state(spark, rows, tmp_path):
    feed = lambda: ddl_log.read_ddl_events(spark, f"{tmp_path}/log", streaming=True, files_per_trigger=1)
    for part in (
        [(1, 100, 1, "CREATE SCHEMA", "a", 1)],
        [(2, 50, 2, "CREATE SCHEMA", "b", 1), (1, 150, 3, "ALTER SCHEMA", "c", 2)],
        [(1, 120, 4, "ALTER SCHEMA", "d", 3), (2, 10, 5, "ALTER SCHEMA", "e", 3)],
    ):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        E.start_registry_stream(feed(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    state = E.read_registry_state(spark, f"{tmp_path}/out")
    assert rows(E.lives(state), "schema_name", "owner_oid", "is_live") == [("b", 1, True), ("c", 2, True)]


def test_object_stream_writes_an_event_once(spark, rows, tmp_path):
    for part in ([(1, 100, 1, "CREATE SCHEMA", "a", 1)], [(1, 100, 1, "CREATE SCHEMA", "a", 1), (2, 1, 2, "CREATE SCHEMA", "b", 1)]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        feed = ddl_log.read_ddl_events(spark, f"{tmp_path}/log", streaming=True)
        E.start_object_stream(feed, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/rows"), "event_id") == [(1,), (2,)]


def test_tags(spark, rows):
    assert "CREATE PROCEDURE" in ddl_log.object_tags("CREATE") and "CREATE PROCEDURE" not in ddl_log.object_tags("CREATE", 100000)
    assert "CREATE STATISTICS" not in ddl_log.object_tags("CREATE", 90600)
    raw = spark.createDataFrame(
        [("CREATE TABLE", "table", 1), ("DROP OWNED", None, None), ("DROP OWNED", None, 777), ("DROP EXTENSION", "function", 778), ("DROP EXTENSION", "function", None),
         ("DROP EXTENSION", "schema", 779), ("ALTER VIEW", "view", 2), ("CREATE ROLE", None, None), ("SELECT INTO", None, 3), ("ALTER SCHEMA", "schema", None)],
        "tag string, object_type string, obj_oid bigint",
    )
    assert rows(ddl_log.normalise_tags(raw), "tag", "obj_oid") == [
        ("ALTER OBJECT", 2), ("ALTER SCHEMA", None), ("CREATE OBJECT", 1), ("CREATE OBJECT", 3), ("DROP SCHEMA", None), ("DROP SCHEMA", 779),
    ]


def test_batch_reader_drops_copies(spark, tmp_path):
    df = frame(spark, [(1, 1, 1, "CREATE SCHEMA", "a", 1), (2, 1, 2, "CREATE ROLE", "a", 1)])
    df.union(df).write.parquet(f"{tmp_path}/log")
    assert ddl_log.read_ddl_events(spark, f"{tmp_path}/log").count() == 1
    df.write.json(f"{tmp_path}/json")
    assert ddl_log.read_ddl_events(spark, f"{tmp_path}/json", fmt="json").count() == 1
    assert set(df.columns) == {c.split()[0] for c in DDL_EVENTS.split(", ")}


def test_versions(spark, rows, tmp_path):
    root = f"{tmp_path}/registry"
    assert stores.latest_version(spark, root) is None
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    stores.write_registry(old, root, 0)
    change = spark.createDataFrame([(2, "B", False), (3, "c", False), (1, "a", True)], "k bigint, v string, _deleted boolean")
    new = stores.upsert(stores.read_version(spark, root, 0), change, "k")
    stores.write_registry(new, root, 7)
    stores.write_registry(new, root, 7)
    assert stores.latest_version(spark, root) == 7 and stores.latest_version(spark, root, before=7) == 0
    assert rows(stores.read_version(spark, root, 7)) == [(2, "B"), (3, "c")]
    stores.drop_versions(spark, root, below=7)
    assert stores.versions(spark, root) == [7]


def test_upsert_keeps_the_name_in_other_databases(spark, rows):
    old = spark.createDataFrame([(0, "s", "a"), (1, "s", "b")], "db_id int, schema_name string, v string")
    new = stores.upsert(old, old.where("db_id = 0").withColumn("v", F.lit("c")), ["db_id", "schema_name"])
    assert rows(new) == [(0, "s", "c"), (1, "s", "b")]


def test_written_plan(spark, rows, tmp_path):
    plan = spark.createDataFrame([(1, 2, 7, "y"), (1, 1, 9, "x"), (0, 5, 1, "z")], "db_id bigint, step int, obj_oid bigint, command string")
    stores.write_plan(plan, f"{tmp_path}/plan")
    back = spark.read.parquet(f"{tmp_path}/plan")
    assert rows(back, "seq", "command") == [(1, "z"), (2, "x"), (3, "y")]


def test_objects_created_in_a_registered_schema(spark, rows):
    from tests.test_acl import ACL, OBJ
    from tests.test_registry import REGISTRY
    from tests.test_roles import ROLES

    roles = spark.createDataFrame([(1, "p1", False, False, False, True), (3, "r3", False, False, False, True), (4, "r4", False, False, False, True)], ROLES)
    registry = spark.createDataFrame(
        [(0, "s", False, None, None, "s", 100, True, "p1", 1, "r3", 3, "public", 0), (0, "t", False, None, None, "t", 101, True, "gone", 9, "r3", 3, None, None), (0, "u", False, None, None, "u", 102, True, "r4", 4, None, None, None, None)],
        REGISTRY,
    )
    events = spark.createDataFrame(
        [(1, "CREATE OBJECT", 100, 3, 11, "v"), (2, "CREATE OBJECT", 100, 1, 12, "X"), (3, "CREATE OBJECT", 101, 3, 13, "r"), (4, "ALTER OBJECT", 100, 3, 11, "v"), (5, "ALTER OBJECT", 101, 3, 13, "r"), (6, "CREATE OBJECT", 555, 3, 14, "r")],
        "event_id bigint, tag string, schema_oid bigint, owner_oid bigint, obj_oid bigint, obj_kind string",
    )
    assert rows(E.grants_on_create_object(events, registry, roles), "event_id", "verb", "privilege", "role_oid") == [
        (1, "GRANT", "SELECT", 0), (1, "GRANT", "SELECT, INSERT, UPDATE, DELETE", 3), (1, "OWNER", None, 1),
    ]
    # an altered object goes back even to a producer that is only an id
    assert rows(E.owner_on_alter_object(events, registry), "event_id", "role_oid") == [(4, 1), (5, 9)]
    objects = spark.createDataFrame([(0, 100, "v", 11, "w", 1, False), (0, 102, "r", 20, "src", 4, False), (0, 100, "r", 21, "mine", 1, False)], OBJ)
    sources = spark.createDataFrame([(11, 20), (11, 21), (99, 20)], "view_oid bigint, source_oid bigint")
    closure = roles.select(F.col("role_oid").alias("member_oid"), "role_oid")
    warnings = E.view_warnings_on_create(events, sources, objects, spark.createDataFrame([], ACL), registry, roles, closure)
    assert rows(warnings, "obj_oid", "other_oid", "role_oid", "function") == [(11, 20, 1, "set reader")]
