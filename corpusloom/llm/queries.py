"""Queries of the dealt operators: name → (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    context_mixing,
    decontamination,
    fingerprints,
    hard_negatives,
    html_text,
    language,
    neardup,
    packing,
    periodic,
    secret_scan,
    shards,
    substring_dedup,
    toxicity,
)
from corpusloom.llm.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op6_fast_similarity_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


@query
def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted_documents(documents(spark, sf_dir))


@query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return toxicity.scored_documents(documents(spark, sf_dir), labels, chain)


@query
def op9_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.sharded_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


@query
def op1_host_suffix_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op2_containment_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contained_items(documents(spark, sf_dir), benchmark)


@query
def op3_curve_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_confirmed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned_documents(documents(spark, sf_dir))


@query
def op5_context_tree_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted_documents(documents(spark, sf_dir))


@query
def op10_anchored_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.without_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed",
                          F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query
def op11_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored_documents(documents(spark, sf_dir))


@query
def op12_residue_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(
        spark.read.parquet(f"{sf_dir}/embeddings.parquet"), anchor=vec_id % 100 == 0, label=shifted)


ORACLES["op12_residue_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
              AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    planted = docs.withColumn("text", periodic.with_planted_periods(F.col("doc_id"), F.col("text")))
    return periodic.summary(periodic.periodic_runs(planted))
