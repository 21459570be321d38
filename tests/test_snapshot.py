import pytest
from pyspark.sql import functions as F

from grantlens.functions.acltext import array_items, by_option, item_parts
from grantlens.sources import catalog, snapshot

BASE = 1 << 32


@pytest.fixture
def roles(spark):
    names = ["ann", "b=r/c", 'q"x"', "a,b", "back\\slash", "900", "d/e", "two words", "{curly}", "new\nline"]
    return spark.createDataFrame([(10 + i, n) for i, n in enumerate(names)], "role_oid bigint, role_name string")


def quoted(name):
    return name if name.replace("_", "a").isalnum() and name.isascii() else '"' + name.replace('"', '""') + '"'


def literal(items):
    """An array of texts as the server writes it."""
    out = []
    for x in items:
        if any(c in '"\\{}, \n\t' for c in x) or x == "":
            x = '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
        out.append(x)
    return "{" + ",".join(out) + "}"


def test_items_of_an_array(spark):
    arrays = [["=r/ann"], ['"b=r/c"=rw*/"q""x"""', "ann=a/ann"], ['"a,b"=r/"{curly}"', '"back\\slash"=U/ann'], [], ['"new\nline"=X/ann']]
    df = spark.createDataFrame([(i, literal(a)) for i, a in enumerate(arrays)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", array_items(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(arrays))] == arrays and got[99] is None


@pytest.mark.parametrize(
    "item,want",
    [
        ("ann=r/bob", ("ann", "r", "bob", True)),
        ("=rw*/bob", ("", "rw*", "bob", True)),
        ('"b=r/c"=a*d/"q""x"""', ("b=r/c", "a*d", 'q"x"', True)),
        ('"d/e"=r/"d/e"', ("d/e", "r", "d/e", True)),
        ('""""=r/ann', ('"', "r", "ann", True)),
        ("ann=r", ("ann", "r", None, True)),
        ("ann=/bob", ("ann", "", "bob", True)),
        ("900=r/901", ("900", "r", "901", True)),
        ("two words=r/ann", ("two words", "r", "ann", True)),
        ("nothing", (None, None, None, False)),
        ('"open=r/ann', (None, None, None, False)),
        ("ann=r!/bob", (None, None, None, False)),
        ("ann=**/bob", (None, None, None, False)),
        ("", (None, None, None, False)),
        (None, (None, None, None, False)),
    ],
)
def test_parts_of_an_item(spark, item, want):
    df = spark.createDataFrame([(item,)], "x string")
    assert tuple(df.select(item_parts(F.col("x")).alias("p")).first()["p"]) == want


def test_codes_by_option(spark):
    df = spark.createDataFrame([("rw*a*d",), ("r",), ("U*",), ("",)], "x string")
    got = [[tuple(e) for e in r["y"]] for r in df.select(by_option(F.col("x")).alias("y")).collect()]
    assert got == [[("rd", False), ("wa", True)], [("r", False)], [("U", True)], []]


def test_names_are_resolved_whatever_they_hold(spark, roles):
    by_oid = {r["role_oid"]: r["role_name"] for r in roles.collect()}
    acls = [[f"{quoted(n)}=r*w/{quoted(n)}"] for n in by_oid.values()]
    df = spark.createDataFrame([(i, literal(a)) for i, a in enumerate(acls)], "i int, t string")
    df = df.select("i", array_items(F.col("t")).alias("acl"))
    got = df.join(snapshot.acl_dictionary(df, roles), "acl").select("i", F.inline("entries")).collect()
    want = {(i, o, o, c, g) for i, o in enumerate(by_oid) for c, g in (("w", False), ("r", True))}
    assert {tuple(r) for r in got} == want


def test_numbers_public_and_items_that_are_none(spark, roles):
    acl = ["=r/ann", "900=r/ann", "901=r/902", "gone=r/ann", "ann=r/gone", "junk", None]
    df = spark.createDataFrame([(acl,), ([],), (None,)], "acl array<string>")
    (r,) = snapshot.acl_dictionary(df, roles).collect()
    # a name comes before a number; a grantor that is gone leaves the entry
    assert {tuple(e) for e in r["entries"]} == {
        (10, 0, "r", False), (10, 15, "r", False), (902, 901, "r", False), (None, 10, "r", False)
    }
    assert sorted(map(str, r["rejected"])) == ["gone=r/ann", "junk"]


def write_catalogs(spark, root, acl_type="array<string>"):
    def put(name, schema, data):
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}")

    one = ["ann=X/ann"] if acl_type == "array<string>" else "{ann=X/ann}"
    none = [] if acl_type == "array<string>" else "{}"
    for d in snapshot.DESCRIPTORS:
        space = "" if d.catalog == "pg_namespace" else f", {d.prefix}namespace bigint"
        extra = f", {d.prefix}{d.kind_of} string" if d.kind_of else ""
        acl = f", {d.prefix}acl {acl_type}" if d.has_acl else ""
        row = [1, 7, "n", 3] + ([9] if space else [])
        if d.catalog == "pg_class":
            data = [(*row, "r", None), (1, 8, "i", 3, 9, "i", None), (1, 5, "v", 3, 9, "v", one)]
        elif d.catalog == "pg_type":
            data = [(*row, "d", none), (1, 6, "t", 3, 9, "c", one)]
        else:
            data = [(*row, *([one] if acl else []))]
        put(d.catalog, f"db_id bigint, oid bigint, {d.prefix}name string, {d.prefix}owner bigint{space}{extra}{acl}", data)
    item = lambda x: [x] if acl_type == "array<string>" else literal([x])
    put("pg_attribute", f"db_id bigint, attrelid bigint, attname string, attacl {acl_type}",
        [(1, 7, "col", item('"b=r/c"=rw*/ann')), (1, 7, "plain", None), (1, 99, "lost", item("ann=r/ann")), (2, 7, "other", item("ann=r/ann"))])
    put("pg_default_acl", f"db_id bigint, defaclrole bigint, defaclnamespace bigint, defaclobjtype string, defaclacl {acl_type}",
        [(1, 10, 9, "r", item("=r*a/ann")), (1, 10, 0, "f", item("ann=X/ann"))])


@pytest.mark.parametrize("acl_type", ["array<string>", "string"])
def test_whole_snapshot(spark, rows, roles, tmp_path, acl_type):
    write_catalogs(spark, tmp_path, acl_type)
    found = snapshot.read_snapshot(spark, str(tmp_path), roles)
    got = rows(found.objects, "obj_kind", "obj_oid", "schema_oid", "has_acl")
    assert [g[0] for g in got] == sorted("CDEFGKLNOTXdrv")
    assert ("r", BASE + 7, BASE + 9, False) in got and ("d", BASE + 7, BASE + 9, True) in got
    assert ("N", BASE + 7, BASE + 7, True) in got
    acl = rows(found.acl, "obj_kind", "obj_oid", "column_name", "grantee_oid", "codes", "grantable")
    assert set(acl) == {
        ("N", BASE + 7, None, 10, "X", False), ("X", BASE + 7, None, 10, "X", False), ("T", BASE + 6, None, 10, "X", False),
        ("v", BASE + 5, None, 10, "X", False), ("A", BASE + 7, "col", 11, "r", False), ("A", BASE + 7, "col", 11, "w", True),
    }
    assert rows(found.default_acl) == [
        (1, None, 10, "f", 10, "X"), (1, BASE + 9, 10, "r", 0, "a"), (1, BASE + 9, 10, "r", 0, "r"),
    ]
    assert found.rejected.count() == 0
    lost = snapshot.read_snapshot(spark, str(tmp_path), roles.where("role_name != 'ann'")).rejected
    assert {r["item"] for r in lost.collect()} == {"ann=X/ann"}
    kinds = {g[0] for g in rows(snapshot.snapshot_objects(spark, str(tmp_path), 90500), "obj_kind")}
    assert "E" not in kinds and "r" in kinds


def test_texts_are_taken_apart_once(spark, roles):
    """A million objects with one ACL are one row of the dictionary."""
    objects = spark.range(1000).select(F.array(F.lit("ann=r/ann")).alias("acl"))
    assert snapshot.acl_dictionary(objects, roles).count() == 1


def test_memberships_of_several_grantors(spark, rows):
    df = spark.createDataFrame([(1, 2, False), (1, 2, True), (1, 3, False)], "roleid bigint, member bigint, admin_option boolean")
    assert rows(catalog.read_memberships(df)) == [(1, 2, True), (1, 3, False)]


def test_roles_of_several_servers(spark, rows):
    """Equal ids and equal names on two servers are different roles; public is one."""
    pg = spark.createDataFrame(
        [(s, 10, f"only{s}", True, False, False, True) for s in (0, 1)] + [(s, 11, "both", False, False, False, True) for s in (0, 1)],
        "server_id int, oid bigint, rolname string, rolcanlogin boolean, rolsuper boolean, rolcreaterole boolean, rolinherit boolean",
    )
    known = catalog.read_roles(pg)
    assert rows(known, "role_oid", "role_name") == sorted(
        [(10, "only0"), (11, "both"), (BASE + 10, "only1"), (BASE + 11, "both")], key=lambda r: (str(r[0]), r[1])
    )
    members = spark.createDataFrame(
        [(0, 11, 10, False), (1, 11, 10, True), (1, 11, 10, False)], "server_id int, roleid bigint, member bigint, admin_option boolean"
    )
    assert rows(catalog.read_memberships(members)) == [(11, 10, False), (BASE + 11, BASE + 10, True)]
    texts = spark.createDataFrame(
        [(0, ["both=r/only0", "only1=r/both", "=r/both", "77=r/both"]), (1, ["both=r/only1", "77=r/both"]), (None, ["both=r/both", "=U/both"])],
        "server_id bigint, acl array<string>",
    )
    got = {r["server_id"]: r for r in snapshot.acl_dictionary(texts, known).collect()}
    entries = {s: {tuple(e) for e in r["entries"]} for s, r in got.items()}
    assert entries[0] == {(10, 11, "r", False), (11, 0, "r", False), (11, 77, "r", False)}
    assert entries[1] == {(BASE + 10, BASE + 11, "r", False), (BASE + 11, BASE + 77, "r", False)}
    assert entries[None] == {(None, 0, "U", False)}
    assert {s: r["rejected"] for s, r in got.items()} == {0: ["only1=r/both"], 1: [], None: ["both=r/both"]}
    with pytest.raises(ValueError):
        snapshot.acl_dictionary(texts.drop("server_id"), known)


def test_databases_of_several_servers(spark, rows, roles, tmp_path):
    write_catalogs(spark, tmp_path)
    two = roles.withColumn("server_id", F.lit(1)).withColumn("role_oid", F.col("role_oid") + F.lit(BASE))
    two = two.unionByName(roles.withColumn("server_id", F.lit(0)))
    databases = spark.createDataFrame([(1, 1)], "db_id bigint, server_id int")
    found = snapshot.read_snapshot(spark, str(tmp_path), two, databases=databases)
    assert {r["owner_oid"] for r in found.objects.collect()} == {BASE + 3}
    assert {r["grantee_oid"] for r in found.acl.collect()} == {BASE + 10, BASE + 11}
    assert {(r["grantor_oid"], r["grantee_oid"]) for r in found.default_acl.collect()} == {(BASE + 10, 0), (BASE + 10, BASE + 10)}
    assert found.rejected.count() == 0
    # a database that is not listed has no server: nothing is guessed
    nowhere = snapshot.read_snapshot(spark, str(tmp_path), two, databases=databases.where("db_id = 5"))
    assert nowhere.acl.count() == 0 and {r["item"] for r in nowhere.rejected.collect()} == {"ann=X/ann", '"b=r/c"=rw*/ann'}
    assert {r["owner_oid"] for r in nowhere.objects.collect()} == {None}


def test_dependencies_of_several_servers(spark, rows):
    shared = spark.createDataFrame(
        [(0, 5, "pg_class", 1, "pg_authid", 9), (1, 5, "pg_class", 1, "pg_authid", 9), (1, 0, "pg_database", 6, "pg_authid", 9),
         (1, 7, "pg_class", 1, "pg_authid", 9)],
        "server_id int, dbid bigint, classid string, objid bigint, refclassid string, refobjid bigint",
    )
    databases = spark.createDataFrame([(100, 0, 5), (101, 1, 5), (102, 1, 6)], "db_id bigint, server_id int, oid bigint")
    assert rows(catalog.read_role_dependencies(shared, databases)) == [(100, 9), (101, BASE + 9), (102, BASE + 9)]
    with pytest.raises(ValueError):
        catalog.read_role_dependencies(shared)
