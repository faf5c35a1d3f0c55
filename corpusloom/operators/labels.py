"""The label table: resume set, assembly, clean-up, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.positions import fresh_ids
from corpusloom.functions.text import is_dnb
from corpusloom.operators.runs import in_latest_run


def unlabeled_chunks(chunks: DataFrame, runs: DataFrame, labels: DataFrame, rubric_id: int,
                     doc_id: int | None = None, *, ordered: bool = False) -> DataFrame:
    """Chunks of the latest runs that the rubric has not labeled; the resume set.

    The set is worked out on ids; texts are shuffled once, to meet it.
    """
    if doc_id is not None:
        chunks = chunks.where(F.col("doc_id") == doc_id)
        runs = runs.where(F.col("doc_id") == doc_id)
    done = labels.where(F.col("rubric_id") == rubric_id).select("chunk_id")
    ids = in_latest_run(chunks.select("chunk_id", "run_id"), runs).join(done, "chunk_id", "left_anti")
    todo = chunks.join(ids.select("chunk_id"), "chunk_id", "left_semi").select(chunks.columns)
    return todo.orderBy("char_start") if ordered else todo


def label_stage_report(docs: DataFrame, chunks: DataFrame, runs: DataFrame, labels: DataFrame,
                       responses: DataFrame, rubric_id: int, *, cancelled: bool = False) -> DataFrame:
    """Per document, what the labeling stage found, did and left.

    ``responses(chunk_id, ok)`` are this job's attempts. Counts are built per
    chunk before they meet the documents.
    """
    done = labels.where(F.col("rubric_id") == rubric_id).select("chunk_id").distinct()
    tried = responses.groupBy("chunk_id").agg(F.max("ok").alias("ok"))
    per_chunk = (
        in_latest_run(chunks, runs).select("chunk_id", "doc_id")
        .join(done.withColumn("_had", F.lit(True)), "chunk_id", "left")
        .join(tried, "chunk_id", "left")
    )
    had = F.coalesce("_had", F.lit(False))
    counts = per_chunk.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(had).alias("already"),
        F.count_if(~had & F.col("ok")).alias("fresh"),
        F.count_if(~had & ~F.col("ok")).alias("failed"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id",
        zero("total").alias("total"),
        zero("already").alias("already"),
        (zero("already") + zero("fresh")).alias("done"),
        zero("failed").alias("failed"),
    ).withColumn("remaining", F.col("total") - F.col("done") - F.col("failed"))
    outcome = (
        F.when(F.col("total") == 0, "no chunks")
        .when(F.lit(cancelled) & (F.col("remaining") > 0), "cancelled")
        .when((F.col("failed") > 0) & (F.col("done") == 0), "failed")
        .otherwise("done")
    )
    return rows.withColumn("outcome", outcome)


def label_stage_totals(report: DataFrame) -> DataFrame:
    """Labels succeeded and failed over the whole stage."""
    return report.agg(F.sum("done").alias("succeeded"), F.sum("failed").alias("failed"))


def assemble_labels(scored: DataFrame, *, rubric_id: int, llm_model: str, llm_run_id: str,
                    existing: DataFrame | None = None, created_at=None) -> DataFrame:
    """Label rows from scored replies, one reply a chunk; one model and run id per job.

    Label ids follow the largest one among the ``existing`` labels.
    """
    when = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    return fresh_ids(scored.drop("label_id"), ["chunk_id"], existing, "label_id", out="label_id").select(
        "label_id", "chunk_id",
        F.lit(rubric_id).cast("long").alias("rubric_id"),
        "predicted_categories", "confidence", "rationale", "knn_agreement",
        "logprob_signal", "composite_confidence",
        F.lit(llm_model).alias("llm_model"),
        F.lit(llm_run_id).alias("llm_run_id"),
        when.alias("created_at"),
    )


def delete_labels(labels: DataFrame, reviews: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove labels (``doomed.label_id``) and their reviews."""
    ids = doomed.select("label_id")
    return labels.join(ids, "label_id", "left_anti"), reviews.join(ids, "label_id", "left_anti")


def labels_of_documents(labels: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The labels, under any rubric, of chunks of the given documents."""
    scope = chunks.select("chunk_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    return labels.join(scope, "chunk_id", "left_semi")


def labels_of_rubric(labels: DataFrame, rubric_id: int) -> DataFrame:
    """The labels of one rubric version."""
    return labels.where(F.col("rubric_id") == rubric_id)


def labels_of_chunks(labels: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """The labels of given chunks, such as those an edit touched."""
    return labels.join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")


def dnb_labels(labels: DataFrame, rubric_id: int, chunks: DataFrame | None = None,
               docs: DataFrame | None = None) -> DataFrame:
    """Labels that say "does not belong"; feed them to ``delete_labels``."""
    hits = labels.where((F.col("rubric_id") == rubric_id) & is_dnb(F.col("predicted_categories")))
    if docs is None:
        return hits
    return labels_of_documents(hits, chunks, docs)


def latest_labels(labels: DataFrame, rubric_id: int) -> DataFrame:
    """Each chunk's last label under a rubric.

    The newest id is found by aggregation, so a chunk with very many labels
    sends one row per task.
    """
    mine = labels.where(F.col("rubric_id") == rubric_id)
    newest = mine.groupBy("chunk_id").agg(F.max("label_id").alias("label_id"))
    return mine.join(newest.select("label_id"), "label_id", "left_semi").select(labels.columns)


def find_labels(labels: DataFrame, *, chunk_id: int | None = None, rubric_id: int | None = None,
                ordered: bool = False) -> DataFrame:
    """Labels of a chunk, in order of time, or of a rubric."""
    if rubric_id is not None:
        labels = labels.where(F.col("rubric_id") == rubric_id)
    if chunk_id is not None:
        labels = labels.where(F.col("chunk_id") == chunk_id)
    order = [c for c in ("created_at", "label_id") if c in labels.columns]
    return labels.orderBy(*order) if ordered else labels
