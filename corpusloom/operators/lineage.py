"""Cascades, in-place replacement, moves and status changes.

Tables are immutable: each job returns what survives, and the caller writes it
to a new place. Deletes are anti-joins from a set of document ids downwards,
so null foreign keys never empty a result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "chunk_embeddings"


def _without_children(tables: Mapping[str, DataFrame], doomed_docs: DataFrame) -> dict[str, DataFrame]:
    ids = doomed_docs.select("doc_id")
    chunks = tables["chunks"]
    doomed_chunks = chunks.select("chunk_id", "doc_id").join(ids, "doc_id", "left_semi")
    doomed_labels = tables["labels"].select("label_id", "chunk_id").join(
        doomed_chunks, "chunk_id", "left_semi"
    )
    out = {
        "chunking_runs": tables["chunking_runs"].join(ids, "doc_id", "left_anti"),
        "chunks": chunks.join(ids, "doc_id", "left_anti"),
        "labels": tables["labels"].join(doomed_chunks, "chunk_id", "left_anti"),
        "human_reviews": tables["human_reviews"].join(doomed_labels, "label_id", "left_anti"),
    }
    if VECTORS in tables:
        out[VECTORS] = tables[VECTORS].join(doomed_chunks, "chunk_id", "left_anti")
    return out


def drop_of_chunks(tables: Mapping[str, DataFrame], touched: DataFrame) -> dict[str, DataFrame]:
    """Vectors, labels and their reviews of ``touched`` chunks go (C16, C17); chunks stay.

    What described the text before an edit does not describe it after.
    """
    ids = touched.select("chunk_id").distinct()
    gone = tables["labels"].select("label_id", "chunk_id").join(ids, "chunk_id", "left_semi")
    out = {
        "labels": tables["labels"].join(ids, "chunk_id", "left_anti"),
        "human_reviews": tables["human_reviews"].join(gone, "label_id", "left_anti"),
    }
    if VECTORS in tables:
        out[VECTORS] = tables[VECTORS].join(ids, "chunk_id", "left_anti")
    return out


def delete_documents(tables: Mapping[str, DataFrame], doomed_docs: DataFrame) -> dict[str, DataFrame]:
    """H1: documents and all that hangs on them; returns the surviving tables."""
    out = _without_children(tables, doomed_docs)
    out["documents"] = tables["documents"].join(
        doomed_docs.select("doc_id"), "doc_id", "left_anti"
    )
    return out


def drop_chunking(tables: Mapping[str, DataFrame], docs: DataFrame) -> dict[str, DataFrame]:
    """H2: as H1, but the documents stay."""
    out = _without_children(tables, docs)
    if "documents" in tables:
        out["documents"] = tables["documents"]
    return out


CONTENT_COLUMNS = (
    "filename", "format", "full_text", "headings", "pages", "sections", "metadata",
    "status", "warnings", "source_hash",
)


def replace_content(tables: Mapping[str, DataFrame], conversions: DataFrame) -> dict[str, DataFrame]:
    """H3: new content for known ``doc_id``s, ids kept, derived rows dropped.

    Documents without a new conversion (their source is gone) stay untouched. A
    conversion without a hash keeps the hash on record.
    """
    docs = tables["documents"]
    fields = [c for c in CONTENT_COLUMNS if c in docs.columns and c in conversions.columns]
    new = conversions.select("doc_id", F.struct(*fields).alias("_new"))
    joined = docs.join(new, "doc_id", "left")
    hit = F.col("_new").isNotNull()

    def pick(c: str):
        if c not in fields:
            return F.col(c)
        value = F.col(f"_new.{c}")
        if c == "source_hash":
            value = F.coalesce(F.nullif(value, F.lit("")), F.col(c))
        return F.when(hit, value).otherwise(F.col(c)).alias(c)

    replaced = docs.select("doc_id").join(new.select("doc_id"), "doc_id", "left_semi")
    out = _without_children(tables, replaced)
    out["documents"] = joined.select(*[pick(c) for c in docs.columns])
    return out


def changed_conversions(docs: DataFrame, conversions: DataFrame) -> DataFrame:
    """H3: only conversions whose bytes differ from the document on record."""
    known = docs.select("doc_id", F.col("source_hash").alias("_known"))
    return conversions.join(known, "doc_id").where(
        ~F.col("source_hash").eqNullSafe(F.col("_known"))
    ).drop("_known")


def move_documents(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """H4: ``moves(doc_id, path, filename)`` refresh where a document lives."""
    new = moves.select("doc_id", F.col("path").alias("_path"), F.col("filename").alias("_name"))
    meta = F.map_concat(
        F.map_filter("metadata", lambda k, _: k != "source"),
        F.create_map(F.lit("source"), F.col("_path")),
    )
    base = docs.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return (
        base.join(new, "doc_id", "left")
        .withColumn("metadata", F.when(F.col("_path").isNotNull(), meta).otherwise(F.col("metadata")))
        .withColumn("filename", F.coalesce("_name", "filename"))
        .select(docs.columns)
    )


def apply_status(docs: DataFrame, events: DataFrame) -> DataFrame:
    """The latest status event ``(doc_id, event_id, status)`` of each document wins."""
    latest = events.groupBy("doc_id").agg(F.max_by("status", "event_id").alias("_status"))
    return docs.join(latest, "doc_id", "left").withColumn(
        "status", F.coalesce("_status", "status")
    ).select(docs.columns)
