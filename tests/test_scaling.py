import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantlens.scaling import attach, computed, number_rows
from harness.inputs import Inputs


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = spark.conf.get(names[0])
    for n in names:
        spark.conf.set(n, "-1")
    yield
    spark.conf.set(names[0], old)
    spark.conf.unset(names[1])


@pytest.fixture
def small_skew(spark):
    """Partitions count as skewed from a few kilobytes on."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_hot_key_is_split(spark, no_broadcast, small_skew, how):
    # one key holds two thirds of the rows, some keys are missing or NULL
    key = F.when(F.col("id") % 3 != 0, F.lit(7)).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 11)
    facts = spark.range(0, 60_000, 1, 12).select("id", key.alias("k"))
    dim = spark.createDataFrame([(7, "hot"), (1, "one"), (2, "two"), (50, "none")], "k long, v string")
    joined = attach(facts, dim, "k", how)
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    hot, known = 40_000, [x for x in range(0, 60_000, 3) if x % 5 and x % 11 in (1, 2, 7)]
    matched = hot + len(known)
    assert joined.count() == {"inner": matched, "left": 60_000, "left_semi": matched, "left_anti": 60_000 - matched}[how]


def test_small_dimension_is_broadcast(spark):
    facts, dim = spark.range(100).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    assert "Broadcast" in attach(facts, dim, "k", "inner")._jdf.queryExecution().sparkPlan().toString()


def test_row_numbers_without_a_single_task(spark, rows):
    df = spark.range(5000).select(F.expr("concat('n', id * 7919 % 5000)").alias("name"))
    expected = df.withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))
    assert rows(number_rows(df, [F.col("name")]), "name", "id") == rows(expected, "name", "id")
    assert number_rows(df.limit(0), [F.col("name")]).count() == 0


def test_computed_columns_are_not_copied_into_filters(spark):
    df = spark.range(10).select((F.col("id") * 2).alias("a"))
    out = computed(df, a=F.col("a") + 1, b=F.col("a") * 3).where("a > 5 AND b > 3")
    assert sorted(map(tuple, out.collect())) == [(7, 18), (9, 24), (11, 30), (13, 36), (15, 42), (17, 48), (19, 54)]


def test_next_marked(spark):
    import random

    from grantlens.scaling import next_marked

    rng = random.Random(3)
    data = [(rng.choice("aaaab"), t, rng.random() < 0.2, t) for t in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(data, "k string, t int, m boolean, v int")
    got = {(r["k"], r["t"]): r["n"] for r in next_marked(df, ["k"], "t", "m", "v", "n").collect()}
    want = {(k, t): min((u for j, u, m, _ in data if j == k and m and u > t), default=None) for k, t, _, _ in data}
    assert got == want
    assert next_marked(df.limit(0), ["k"], "t", "m", "v", "n").count() == 0


def test_files_are_weighed_by_their_rows(spark, tmp_path):
    """A file that is small only because ids and names compress well is not broadcast; a small table is."""
    inputs = Inputs(spark, str(tmp_path))
    name = F.concat(F.lit("usr_"), F.col("id").cast("string")).alias("name")
    many = inputs.land("many_names", lambda: spark.range(0, 300_000, 1, 4).select("id", name))
    few = inputs.land("few_names", lambda: spark.range(0, 100, 1, 1).select("id", name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4m")  # the rows take 12 MB, their files 0.5
    try:
        plans = [spark.range(0, 5_000_000).join(t, "id", "left")._jdf.queryExecution().sparkPlan().toString() for t in (many, few)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert ["BroadcastHashJoin" in p for p in plans] == [False, True]
