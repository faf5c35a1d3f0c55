"""Labeled-corpus records, manifests and merges."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import __version__
from corpusloom.functions.identity import uuid5
from corpusloom.operators.analytics import labeling_totals
from corpusloom.operators.reviews import with_reviews

# How consumers join the parts of an export.
PRIMARY_KEY = "chunk_uuid"
FALLBACK_KEYS = ("project_uuid", "chunk_id")
JOIN_NOTE = (
    "Join on chunk_uuid: derived from project and chunk number, it is the same in every export. "
    "Chunk numbers repeat from project to project."
)
SIDECAR_COLUMNS = (
    "chunk_uuid", "project_uuid", "chunk_id", "document_id", "document_filename", "embedding",
    "embedding_model",
)


def chunk_uuid(project_uuid: str, chunk_id: Column) -> Column:
    """The export key of a chunk."""
    return uuid5(project_uuid, chunk_id.cast("string"))


def chunk_records(labels: DataFrame, chunks: DataFrame, docs: DataFrame, current: DataFrame,
                  embeddings: DataFrame, *, rubric_id: int, rubric_version: int,
                  project_uuid: str, inline_embeddings: bool = False,
                  limit: int | None = None) -> DataFrame:
    """G1: one nested record per label of the rubric.

    Labels without a chunk are left out; a chunk without its document names it
    "unknown". Vectors are read only when they go into the record. ``limit``
    picks the first labels before anything wide is joined to them.
    """
    vector_cols = ["embedding", "embedding_model"] if inline_embeddings else ["embedding_model"]
    mine = labels.where(F.col("rubric_id") == rubric_id)
    if limit is not None:
        mine = mine.join(chunks.select("chunk_id"), "chunk_id", "left_semi").orderBy("label_id").limit(limit)
    # All wide joins are on chunk_id, so texts and vectors are shuffled once.
    joined = (
        with_reviews(mine, current)
        .join(chunks, "chunk_id")
        .join(_names_of_chunks(chunks, docs), "chunk_id")
        .join(embeddings.select("chunk_id", *vector_cols), "chunk_id", "left")
    )
    review = F.when(
        F.col("review").isNotNull(),
        F.struct(*[F.col(f"review.{c}").alias(c)
                   for c in ("action", "final_categories", "reviewer", "notes", "reviewed_at")]),
    )
    return joined.select(
        "label_id",
        "chunk_id",
        chunk_uuid(project_uuid, F.col("chunk_id")).alias("chunk_uuid"),
        "text",
        F.struct(
            F.coalesce("filename", F.lit("unknown")).alias("document"),
            F.col("doc_id").alias("document_id"),
            "section_path", "char_start", "char_end",
        ).alias("source"),
        "token_count", "chunk_type", "boundary_confidence", "manual_override", "embedding_model",
        F.struct(
            F.lit(rubric_version).alias("rubric_version"),
            F.col("predicted_categories").alias("categories"),
            "confidence", "rationale", "composite_confidence", "knn_agreement",
            "logprob_signal", "llm_model",
            review.alias("human_review"),
        ).alias("label"),
        *(["embedding"] if inline_embeddings else []),
    )


def _names_of_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``chunk_id, filename``: the one join by document, on narrow rows."""
    return chunks.select("chunk_id", "doc_id").join(
        docs.select("doc_id", "filename"), "doc_id", "left"
    ).select("chunk_id", "filename")


def sidecar_rows(labels: DataFrame, chunks: DataFrame, docs: DataFrame, embeddings: DataFrame, *,
                 rubric_id: int, project_uuid: str) -> DataFrame:
    """The vector of every labeled chunk that has one, with its join keys; one row a chunk."""
    mine = labels.where(F.col("rubric_id") == rubric_id).select("chunk_id").distinct()
    named = chunks.select("chunk_id", "doc_id").join(docs.select("doc_id", "filename"), "doc_id", "left")
    return (
        mine.join(named, "chunk_id")
        .join(embeddings.where("embedding is not null"), "chunk_id")
        .select(
            chunk_uuid(project_uuid, F.col("chunk_id")).alias("chunk_uuid"),
            F.lit(project_uuid).alias("project_uuid"),
            "chunk_id",
            F.coalesce("doc_id", F.lit(0)).alias("document_id"),
            F.coalesce("filename", F.lit("")).alias("document_filename"),
            F.col("embedding").cast("array<float>").alias("embedding"),
            F.coalesce("embedding_model", F.lit("")).alias("embedding_model"),
        )
    )


def sidecar_manifest(rows: DataFrame, path: str) -> DataFrame:
    """What the sidecar holds, in one row.

    ``dims_differ`` warns of vectors of different lengths in one sidecar.
    """
    models = F.array_sort(F.collect_set(F.nullif(F.col("embedding_model"), F.lit(""))))
    return rows.agg(
        F.count("*").alias("rows"),
        F.max(F.size("embedding")).alias("dim"),
        models.alias("models"),
        (F.min(F.size("embedding")) != F.max(F.size("embedding"))).alias("dims_differ"),
    ).select(
        F.lit(path).alias("path"), "rows", "dim", "models",
        F.array(*[F.lit(k) for k in (PRIMARY_KEY, *FALLBACK_KEYS)]).alias("join_keys"),
        F.lit("parquet").alias("format"),
        "dims_differ",
    )


def manifest(labels: DataFrame, reviews: DataFrame, chunks: DataFrame, *, rubric_id: int,
             rubric_name: str, rubric_version: int, project_uuid: str,
             inline_embeddings: bool = False, sidecar: DataFrame | None = None,
             exported_at=None) -> DataFrame:
    """The export's head, one row; ``total_chunks`` counts exported records."""
    totals = labeling_totals(labels, reviews, rubric_id)
    exported = (
        labels.where(F.col("rubric_id") == rubric_id)
        .join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        .agg(F.count("*").alias("n"))
    )
    when = F.current_timestamp() if exported_at is None else F.lit(exported_at).cast("timestamp")
    side = (
        sidecar.select(F.struct("*").alias("s")).scalar()
        if sidecar is not None
        else F.lit(None).cast("string")
    )
    return totals.select(
        F.lit(project_uuid).alias("project_uuid"),
        F.lit(rubric_version).alias("rubric_version"),
        F.lit(rubric_name).alias("rubric_name"),
        exported.scalar().alias("total_chunks"),
        F.col("total_labels").alias("labeled_chunks"),
        F.col("reviewed").alias("reviewed_chunks"),
        when.alias("export_timestamp"),
        F.lit(__version__).alias("tool_version"),
        F.struct(F.lit(inline_embeddings).alias("inline"), side.alias("sidecar")).alias("embeddings"),
        F.struct(
            F.lit(PRIMARY_KEY).alias("primary"),
            F.array(*[F.lit(k) for k in FALLBACK_KEYS]).alias("fallback"),
            F.lit(JOIN_NOTE).alias("note"),
        ).alias("join_keys"),
    )


def preview(labels: DataFrame, chunks: DataFrame, docs: DataFrame, current: DataFrame,
            embeddings: DataFrame, *, rubric_id: int, rubric_version: int, project_uuid: str,
            max_chunks: int = 1) -> DataFrame:
    """The first records beside the totals of the whole corpus; writes nothing."""
    totals = labeling_totals(labels, current, rubric_id)
    vectors = sidecar_rows_count(labels, embeddings, rubric_id)
    records = chunk_records(
        labels, chunks, docs, current, embeddings, rubric_id=rubric_id,
        rubric_version=rubric_version, project_uuid=project_uuid, limit=max_chunks,
    )
    return records.select(
        "*",
        totals.select("total_labels").scalar().alias("total_chunks"),
        vectors.scalar().alias("sidecar_rows"),
    )


def sidecar_rows_count(labels: DataFrame, embeddings: DataFrame, rubric_id: int) -> DataFrame:
    """How many rows the sidecar will have, counted on ids alone."""
    mine = labels.where(F.col("rubric_id") == rubric_id).select("chunk_id").distinct()
    return mine.join(embeddings.where("embedding is not null").select("chunk_id"), "chunk_id", "left_semi").agg(
        F.count("*").alias("n"))


def preview_manifest(labels: DataFrame, reviews: DataFrame, chunks: DataFrame, embeddings: DataFrame, *,
                     rubric_id: int, rubric_name: str, rubric_version: int, project_uuid: str,
                     max_chunks: int = 1, path: str = "preview_embeddings.parquet", exported_at=None) -> DataFrame:
    """The manifest a full export would have, with a ``preview`` block; writes nothing.

    The sidecar is described as it would be written, marked ``preview_only``.
    """
    mine = labels.where(F.col("rubric_id") == rubric_id).select("chunk_id").distinct()
    vectors = embeddings.where("embedding is not null").join(mine, "chunk_id", "left_semi")
    side = sidecar_manifest(vectors.select("embedding", F.coalesce("embedding_model", F.lit("")).alias(
        "embedding_model")), path).withColumn("preview_only", F.lit(True))
    head = manifest(labels, reviews, chunks, rubric_id=rubric_id, rubric_name=rubric_name,
                    rubric_version=rubric_version, project_uuid=project_uuid, sidecar=side, exported_at=exported_at)
    return head.withColumn("preview", F.struct(
        F.least(F.col("total_chunks"), F.lit(max_chunks)).alias("rendered_chunks"),
        F.col("labeled_chunks").alias("total_chunks")))


def join_sidecar(records: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Records with their vectors, by ``chunk_uuid``; as many rows as records."""
    vectors = sidecar.groupBy("chunk_uuid").agg(
        F.min(F.struct("project_uuid", "embedding")).alias("v")).select("chunk_uuid", "v.*")
    return records.drop("embedding").join(vectors, "chunk_uuid", "left")


def merge_exports(exports: Iterable[DataFrame]) -> DataFrame:
    """Records of several projects; a record exported twice counts once.

    A record is a label: a chunk, the rubric version and the label's id name it. Of
    its versions the one reviewed last counts; where reviews do not tell them apart,
    the one of the later export in the list; in one export, the greater content.
    """
    frames = [frame.withColumn("_export", F.lit(i)) for i, frame in enumerate(exports)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    columns = [c for c in merged.columns if c != "_export"]
    record = F.struct(*columns)
    age = F.struct(F.col("label.human_review.reviewed_at"), "_export", F.xxhash64(F.to_json(record)))
    return merged.groupBy("chunk_uuid", F.col("label.rubric_version").alias("_version"), "label_id").agg(
        F.max_by(record, age).alias("_record")).select("_record.*")
