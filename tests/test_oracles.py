"""Every registered query against its oracle SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from harness import check, oracles
from harness.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = oracles.all_oracles()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(name, spark, con):
    good, text = check.compare(name, spark, SF, con, QUERIES[name], ORACLES[name])
    assert good, text


def test_flagship_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
