"""Label scoring: centroids, nearest-centroid agreement, composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, vectors
from corpusloom.functions.vectors import Embedder
from corpusloom.operators.responses import mean_logprob, parse_responses


def embed_chunks(chunks: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """The chunk_embeddings rows of a chunk table."""
    return chunks.select(
        "chunk_id",
        F.element_at(embedder(F.array("text")), 1).cast("array<float>").alias("embedding"),
        F.lit(model).alias("embedding_model"),
    )


def exemplar_centroids(exemplars: DataFrame) -> DataFrame:
    """Mean vector per category from ``(rubric_id, category, rubric_pos, embedding)``.

    Averaged component by component with partial sums, so a category with very
    many exemplars is no bottleneck. Categories without exemplars have no row.
    """
    parts = exemplars.select(
        "rubric_id", "category", "rubric_pos", F.posexplode("embedding").alias("i", "x")
    )
    means = parts.groupBy("rubric_id", "category", "rubric_pos", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    return means.groupBy("rubric_id", "category", "rubric_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid")
    )


def pack_centroids(centroids: DataFrame) -> DataFrame:
    """One row per rubric: its centroids in rubric order, each with its norm.

    A rubric is written by hand, so the row holds tens of vectors.
    """
    entry = F.struct(
        F.col("rubric_pos"), F.col("category"), F.col("centroid"),
        vectors.norm(F.col("centroid")).alias("norm"),
    )
    return centroids.groupBy("rubric_id").agg(F.array_sort(F.collect_list(entry)).alias("centroids"))


def nearest_category(embedding: Column, centroids: Column) -> Column:
    """Category of the most similar centroid; the first in rubric order wins ties."""

    def similarities(vec: Column, length: Column) -> Column:
        return F.transform(
            centroids,
            lambda c: F.struct(
                (vectors.dot(vec, c["centroid"]) / (length * c["norm"] + F.lit(1e-8))).alias("sim"),
                (-c["rubric_pos"]).alias("rank"),
                c["category"].alias("category"),
            ),
        )

    sims = arrays.let_all([embedding, vectors.norm(embedding)], similarities)
    return F.array_max(sims)["category"]


def knn_agreement(rows: DataFrame, centroids: DataFrame, *, rubric_id: int | None = None) -> DataFrame:
    """Adds ``nearest`` and ``knn_agreement`` to rows with
    ``rubric_id, embedding, predicted_categories``.

    1.0 if the nearest category is among the predicted ones, else 0.0; 0.0 for
    a rubric without centroids; null for a row without a vector. If all rows
    are of one rubric, name it: its centroids then come from a scalar subquery
    and the rows are not shuffled. Otherwise rows and centroids meet by rubric.
    """
    if rubric_id is not None:
        mine = pack_centroids(centroids.where(F.col("rubric_id") == rubric_id))
        met = rows.withColumn("centroids", mine.select("centroids").scalar())
    else:
        met = rows.join(pack_centroids(centroids), "rubric_id", "left")
    joined = met.withColumn(
        "nearest", nearest_category(F.col("embedding"), F.col("centroids"))
    )
    agrees = F.coalesce(F.array_contains("predicted_categories", F.col("nearest")), F.lit(False))
    return joined.withColumn(
        "knn_agreement", F.when(F.col("embedding").isNotNull(), agrees.cast("double"))
    ).drop("centroids")


def composite_confidence(confidence: Column, knn: Column, logprob: Column) -> Column:
    """One confidence from the model's own, the centroids and the log-probabilities."""
    top = F.array_max(F.map_values(confidence))
    sure = top > 0.8
    with_knn = (
        F.when(knn.isNull(), top)
        .when(sure & (knn > 0.5), F.least(F.lit(1.0), top * 1.05))
        .when(sure & (knn == 0.0), top * 0.7)
        .otherwise(top * 0.85)
    )
    with_logprob = (
        F.when(logprob > -0.5, F.least(F.lit(1.0), with_knn * 1.03))
        .when(logprob < -1.5, with_knn * 0.92)
        .otherwise(with_knn)
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), with_logprob))
    return F.when(F.size(confidence) > 0, clamped).otherwise(0.0)


def score_responses(responses: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None,
                    centroids: DataFrame | None = None, *, rubric_id: int) -> DataFrame:
    """Replies ``(chunk_id, response[, logprobs])`` to scored predictions.

    Replies to unknown chunks are dropped. Without embeddings the agreement is
    null, as it is for chunks that have no vector.
    """
    parsed = parse_responses(responses).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    logprob = (
        mean_logprob(F.col("logprobs"))
        if "logprobs" in responses.columns
        else F.lit(None).cast("double")
    )
    rows = parsed.withColumn("rubric_id", F.lit(rubric_id).cast("long")).withColumn(
        "logprob_signal", logprob
    )
    if embeddings is not None and centroids is not None:
        rows = knn_agreement(
            rows.join(embeddings.select("chunk_id", "embedding"), "chunk_id", "left"), centroids,
            rubric_id=rubric_id,
        )
    else:
        rows = rows.withColumn("knn_agreement", F.lit(None).cast("double"))
    return rows.withColumn(
        "composite_confidence",
        composite_confidence(F.col("confidence"), F.col("knn_agreement"), F.col("logprob_signal")),
    ).select(
        "chunk_id", "predicted_categories", "confidence", "rationale", "knn_agreement",
        "logprob_signal", "composite_confidence",
    )
