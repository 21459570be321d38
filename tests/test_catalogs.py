"""Catalogs are written one by one, as they are asked for."""

import os

from grantlens.sources.snapshot import Snapshot
from harness.catalogs import _written


class Session:
    def __init__(self, spark):
        self.spark, self._paths = spark, {}


def test_only_what_is_read_is_written(spark):
    made, c = [], Session(spark)

    def catalog(name):
        def make():
            made.append(name)
            return spark.createDataFrame([(name, 1)], "name string, oid bigint")

        return make

    all_of_them = {name: catalog(name) for name in ("pg_class", "pg_depend", "pg_rewrite")}
    root = _written(c, "pg", all_of_them, ("pg_depend",))
    assert made == ["pg_depend"] and os.listdir(root.removeprefix("file:")) == ["pg_depend"]
    assert _written(c, "pg", all_of_them, ("pg_rewrite", "pg_depend")) == root
    assert made == ["pg_depend", "pg_rewrite"]
    assert spark.read.parquet(f"{root}/pg_rewrite").collect() == [("pg_rewrite", 1)]


def test_acl_entries_are_written_when_asked_for_and_once(spark):
    entries = spark.createDataFrame([(1, "r")], "obj_oid bigint, codes string")
    found = Snapshot(objects=entries, entries=entries, default_acl=entries, rejected=entries)
    assert found.acl is found.acl
    assert found.acl.collect() == entries.collect() and found.acl.inputFiles()
