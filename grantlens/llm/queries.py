"""Registered queries of the corpus operators, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm import (
    decontaminate,
    embeddings,
    language,
    lines,
    minhash,
    mixing,
    neighbours,
    quality,
    sharding,
    spelling,
    suffixes,
    urls,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight shards; row counts differ by one at most."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    return sharding.shard_rows(docs, shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that lie in a benchmark window."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE_OP2 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
places AS (
  SELECT r, p, m, array_to_string(w[p:p + m - 1], ' ') AS key
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM dw, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT r, p, m, item FROM places JOIN windows USING (m, key)),
marked AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by models of the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    known = docs.select("doc_id", "text", "lang")
    model = language.train(known, F.col("doc_id").isNotNull() & ~held_out)
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in passages of 50 words that another document holds as well."""
    return suffixes.find_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.95 and its component."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    linked = embeddings.link_embeddings(vectors)
    return linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


QUALITY_LIMIT = 0.3


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.train(docs, _table(spark, sf_dir, "labels"), remainder != 0)
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= QUALITY_LIMIT).cast("int").alias("predicted"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    judged = urls.judge_urls(
        _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    )
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class of lines within two edits."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in a mix of one and a half times the input."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.select("doc_id", "source", mixing.word_count().alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite embedding on the 16 leading components of the distinct ones, whitened."""
    return whitening.whiten_embeddings(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found, among all embeddings, of every embedding whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents that is long and frequent enough, with its form and root."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filters": op8_url_filters,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {"op2_decontamination": ORACLE_OP2, "op8_url_filters": urls.ORACLE}
