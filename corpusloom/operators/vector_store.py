"""Vectors by content: a model embeds each text once, however often chunks are made anew."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import text_hash
from corpusloom.functions.vectors import Embedder
from corpusloom.session import written

STORE = "text_hash string, embedding_model string, embedding array<float>"


class Embedded(NamedTuple):
    added: DataFrame             # rows to append to the store
    chunk_embeddings: DataFrame  # chunk_id, embedding, embedding_model


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STORE)


def embed_by_content(chunks: DataFrame, store: DataFrame, embedder: Embedder, model: str) -> Embedded:
    """Vectors of all chunks; only texts that ``store`` has no vector of reach the embedder.

    A text counts once, whoever has it. Texts travel only if they are new: chunks
    meet the store by hash. New vectors are written before they are used, so a
    retry does not call the model again. Chunks without a text have no vector.
    """
    hashed = chunks.where(F.col("text").isNotNull()).select("chunk_id", text_hash(F.col("text")).alias("text_hash"), "text")
    known = store.where(F.col("embedding_model") == model).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    fresh = hashed.join(known.select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(
        F.first("text").alias("text"))
    added = written(fresh.select(
        "text_hash", F.lit(model).alias("embedding_model"),
        F.element_at(embedder(F.array("text")), 1).cast("array<float>").alias("embedding")), "vectors")
    every = known.unionByName(added.select("text_hash", "embedding"))
    return Embedded(added, hashed.select("chunk_id", "text_hash").join(every, "text_hash").select(
        "chunk_id", "embedding", F.lit(model).alias("embedding_model")))
