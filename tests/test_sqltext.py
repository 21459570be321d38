from pyspark.sql import functions as F

from grantlens.functions.privileges import expand_privilege_codes, mask_of
from grantlens.functions.sqltext import first_group, invert_command, quote_ident, quote_literal


def one_by_one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_identifiers_are_quoted_only_when_needed(spark):
    names = ["abc", "a_1", "Abc", "1a", "a b", 'a"b', "select", "user", "", "é", None, "name", "a\n"]
    assert one_by_one(spark, names, quote_ident) == [
        "abc", "a_1", '"Abc"', '"1a"', '"a b"', '"a""b"', '"select"', '"user"', '""', '"é"', None, "name",
        '"a\n"',
    ]


def test_literals(spark):
    assert one_by_one(spark, ["a", "a'b", "a\\b", None], quote_literal) == [
        "'a'", "'a''b'", " E'a\\\\b'", None,
    ]


def test_commands_are_inverted_at_the_first_link_word_only(spark):
    commands = [
        "GRANT SELECT ON TABLE s.t TO r",
        "REVOKE USAGE ON SCHEMA s FROM r",
        'GRANT SELECT ON TABLE s."a TO b" TO r',
        "REVOKE SELECT ON TABLE s.t\tFROM r",
        "grant select on table s.t to r",
        "ALTER TABLE s.t OWNER TO r",
        "",
        None,
    ]
    assert one_by_one(spark, commands, invert_command) == [
        "REVOKE SELECT ON TABLE s.t FROM r",
        "GRANT USAGE ON SCHEMA s TO r",
        'REVOKE SELECT ON TABLE s."a FROM b" TO r',
        "GRANT SELECT ON TABLE s.t TO r",
        None, None, None, None,
    ]


def test_first_group(spark):
    pattern = "^([a-z])_"
    assert one_by_one(spark, ["a_x", "ab", "_x", None], lambda c: first_group(c, pattern)) == [
        "a", None, None, None,
    ]


def test_privilege_codes(spark, rows):
    df = spark.createDataFrame([("rw",), ("rr?",), ("X",), ("",), (None,), ("R",)], "codes string")
    assert rows(expand_privilege_codes(df), "codes", "privilege") == [
        ("X", "EXECUTE"), ("rr?", "SELECT"), ("rw", "SELECT"), ("rw", "UPDATE"),
    ]
    assert mask_of("rr") == mask_of("r") and mask_of(None) == 0
