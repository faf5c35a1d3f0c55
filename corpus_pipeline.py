"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

``run`` applies the stages to the documents table. Each stage's result is written
to the cluster's shared folder and read again, so a lost executor costs tasks of
one stage only. All stages but the last return the columns of documents. Null and
empty texts: the first stage rejects them. Rows that repeat an id: near-dedup keeps
one. Rows without an id cannot be named as duplicates and stay. An empty table
gives an empty result, and columns that the stages do not know pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, language, neardup, packing, secret_scan
from corpusloom.llm.shipping import ship
from corpusloom.llm.tables import kept, maybe_among

# SQL has no context trees, sketches or tokenizers; tests hold each stage against plain Python.
ORACLE_SQL = None
# Bits a byte costs if a model knows nothing of it.
UNKNOWN = 8.0


def in_a_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and texts that no learned language codes in under 8 bits a byte."""
    ship(spark)
    counts = language.train(docs.where(~language.held_out(F.col("doc_id"))).select("lang", "text"))
    guess = language.predictor(docs, counts)(F.col("text"))
    return docs.where((guess["lang_pred"] != language.UNDETERMINED)
                      & (guess["bits_per_byte"] < UNKNOWN))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the smallest id stays, once."""
    ship(spark)
    near = kept(neardup.near_duplicates(docs).where(F.col("doc_id").isNotNull()).select("doc_id", "kept"), "near")
    others = near.where(~F.col("kept")).select("doc_id").distinct()
    again = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    # Documents that surely stay are not shuffled: only the others are joined.
    doubtful = F.col("doc_id").isNotNull() & maybe_among(others.union(again))(F.col("doc_id"))
    place = "place"
    while place in docs.columns:
        place += "_"
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    judged = docs.where(doubtful).join(others, "doc_id", "left_anti").withColumn(
        place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return judged.select(docs.columns).union(docs.where(~doubtful))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    ship(spark)
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    ship(spark)
    return secret_scan.redacted_documents(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    ship(spark)
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", in_a_known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secret_scan", without_secrets),
    ("packing", in_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
