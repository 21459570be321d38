"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.llm.tables import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Stars grow in turns: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours. Every turn is two aggregations and two joins of links, written to the shared folder; a
    node with many links is a hot join key only, which adaptive execution splits.
    """
    links = edges.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    )
    links = cut_lineage(links.distinct())
    state = _state(links)
    while True:
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = cut_lineage(large.distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .where("lo != m")
            .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .union(least.select(F.col("m").alias("lo"), "hi"))
        )
        links = cut_lineage(small.distinct())
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
