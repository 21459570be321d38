"""The taxonomy of schemas: a table of block, levels, name and default functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAXONOMY = (
    "block string, level1 string, level1_abbr string, level2 string, level2_abbr string, "
    "schema_name string, producer string, editor string, reader string"
)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy from Parquet, or from CSV with a header; every row belongs to the taxonomy."""
    reader = spark.read.schema(TAXONOMY)
    rows = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)
    return rows.withColumn("in_nomenclature", F.lit(True))


def limit_domains(taxonomy: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Rows of some domains, given by level1 or by its abbreviation; all without ``domains``."""
    if not domains:
        return taxonomy
    chosen = F.col("level1").isin(domains)
    if "level1_abbr" in taxonomy.columns:
        chosen = chosen | F.col("level1_abbr").isin(domains)
    return taxonomy.where(chosen)
