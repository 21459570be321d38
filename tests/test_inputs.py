"""Derived catalog tables take all rows of what they are derived from."""

import pytest

from harness.inputs import Inputs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "derived, source", [("default_acl", "orders"), ("object_moves", "objects")]
)
def test_every_row_enters(spark, derived, source):
    inputs = Inputs(spark, SF)
    all_rows = spark.read.parquet(f"{SF}/orders.parquet") if source == "orders" else getattr(inputs, source)
    assert getattr(inputs, derived).count() == all_rows.count()
