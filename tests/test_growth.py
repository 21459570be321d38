"""What keeps time and bytes low at size gives the same rows as the plain way."""

import re

import pytest
from pyspark.sql import functions as F

from grantlens.functions.acltext import ITEM, array_items, by_option, item_parts
from grantlens.functions.privileges import BIT
from grantlens.functions.sqltext import invert_command
from grantlens.operators import acl

ROLES = "role_oid bigint, role_name string"


def test_inverted_as_by_patterns(spark):
    """The first link between white space of any kind is turned; nothing else is."""
    commands = [
        'GRANT SELECT ON TABLE a."x TO y" TO b', "GRANT SELECT ON TABLE a.b TO c TO d", "GRANT\tSELECT ON TABLE a\nTO\tb TO c",
        "REVOKE SELECT ON TABLE a.b FROM c FROM d", "REVOKE x\x0bFROM y", "GRANT", "REVOKE", "GRANTED TO x", "REVOKE a TO b",
        "GRANT é TO ü", "grant a TO b", "ALTER TABLE a OWNER TO b", "", None, "GRANT a TOb TO", "GRANT TO x", " GRANT a TO b",
    ]

    def by_pattern(c):
        for verb, link, to_verb, to_link in (("GRANT", "TO", "REVOKE", "FROM"), ("REVOKE", "FROM", "GRANT", "TO")):
            if c is not None and c.startswith(verb):
                turned = to_verb + c.removeprefix(verb)
                return re.sub(rf"(?s)\A(.*?)[ \t\n\x0b\f\r]{link}[ \t\n\x0b\f\r]", rf"\1 {to_link} ", turned)
        return None

    df = spark.createDataFrame([(c,) for c in commands], "c string")
    assert [r[0] for r in df.select(invert_command(F.col("c"))).collect()] == [by_pattern(c) for c in commands]


def test_items_as_by_patterns(spark):
    items = [
        "a=r/b", "=r*w/b", "a=/b", "a=r", "a=r/", "a=r*/b/c", "a=r=w/b", "a", "", None, "a=r1/b", "a=**/b", "é=U/ü", "a=rw\n/b",
        'a="r"/b', '"a=b"=r/"c""d"', "a=r/b=c", "=/", "a b=r/c d", "a=r/b\nc",
    ]

    def parts(x):
        found = x is not None and re.match(ITEM.replace(r"\z", r"\Z"), x)
        if not found:
            return None, None, None, False
        bare = lambda n: n[1:-1].replace('""', '"') if n.startswith('"') else n
        return bare(found[1]), found[2], bare(found[3]) if found[3] else None, True

    df = spark.createDataFrame([(x,) for x in items], "x string")
    assert [tuple(r[0]) for r in df.select(item_parts(F.col("x"))).collect()] == [parts(x) for x in items]


@pytest.mark.parametrize(
    "text, items",
    [("{a=r/b,c=w/d}", ["a=r/b", "c=w/d"]), ("{}", []), ("", []), (None, None), ("{a}{,b,,c}", ["a", "b", "c"]),
     ('{"a\\"=r/b",c=w/d}', ['a"=r/b', "c=w/d"]), ("{é=r/b}", ["é=r/b"]), ("a,b", ["a", "b"])],
)
def test_elements_of_a_text(spark, text, items):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(array_items(F.col("x"))).first()[0] == items


def test_codes_by_option(spark):
    df = spark.createDataFrame([("rw",), ("r*w",), ("r*",), ("",), ("*",), ("1",), (None,)], "x string")
    found = [r[0] and [tuple(x) for x in r[0]] for r in df.select(by_option(F.col("x"))).collect()]
    assert found == [[("rw", False)], [("w", False), ("r", True)], [("r", True)], [], [("*", False)], [("1", False), ("1", True)], []]


def test_masks_are_spelled_after_the_names_are_joined(spark, rows):
    objects = spark.createDataFrame([(0, 1, "r", 5, "t", 9, True)], "db_id bigint, schema_oid bigint, obj_kind string, obj_oid bigint, obj_name string, owner_oid bigint, has_acl boolean")
    entries = spark.createDataFrame(
        [(0, 1, "r", 5, None, 9, 7, "rw", False), (0, 1, "r", 5, None, 9, 7, "wd", False), (0, 1, "r", 5, None, 9, 9, "r", False)],
        "db_id bigint, schema_oid bigint, obj_kind string, obj_oid bigint, column_name string, owner_oid bigint, grantee_oid bigint, codes string, grantable boolean",
    )
    namespaces = spark.createDataFrame([(1, "s")], "schema_oid bigint, schema_name string")
    roles = spark.createDataFrame([(7, "a"), (9, "o")], ROLES)
    masked = acl.all_privileges(objects, entries, spelled=False)
    assert rows(masked.where("verb = 'GRANT'"), "role_oid", "_mask") == [(7, BIT["r"] | BIT["w"] | BIT["d"])]
    early = acl.render_commands(acl.all_privileges(objects, entries), objects, namespaces, roles)
    late = acl.render_commands(masked, objects, namespaces, roles)
    assert rows(late, *early.columns) == rows(early) and late.count() > masked.count()
