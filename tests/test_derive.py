"""Input tables at sizes where another side of a join is broadcast."""

from harness.inputs import DEFINITIONS, Inputs


def test_tables_derive_whatever_side_is_broadcast(spark, tmp_path):
    """A subquery in the key of the smaller side: Spark did not wait for it ("Subquery has not finished")."""
    tables = {
        "part": spark.range(3000).selectExpr("id as p_partkey", "'B' as p_brand", "repeat(sha2(cast(id as string), 256), 4) as p_type", "cast(1 + id % 50 as int) as p_size"),
        "supplier": spark.range(5).selectExpr("id as s_suppkey"),
        "customer": spark.range(7).selectExpr("id as c_custkey"),
        "documents": spark.range(3).selectExpr("id as doc_id"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = Inputs(spark, str(tmp_path)).layer_styles
    assert "(select count(*)" in DEFINITIONS["layer_styles"] and found.count() == 3
    assert {r.owner for r in found.collect()} == {"usr_0", "usr_1", "usr_2"}
