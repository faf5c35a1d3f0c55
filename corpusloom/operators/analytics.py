"""Corpus analytics.

All counts are partial aggregates that combine before the shuffle. Tables are
reduced to one row per key before they are joined, so joins do not fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.reviews import effective_confidence, effective_status, with_reviews

# When a category's statistics call for attention.
LOW_CONFIDENCE = 0.6
HIGH_DISAGREEMENT = 0.3
MIN_REVIEWS = 3
# Upper bounds of the low and middle confidence bands.
BANDS = ((0.3, "low"), (0.7, "medium"))
TOP_BAND = "high"


def confidence_band(c: Column) -> Column:
    """band of a confidence clamped to [0, 1]."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    band = F.lit(TOP_BAND)
    for bound, name in reversed(BANDS):
        band = F.when(value < bound, name).otherwise(band)
    return band


def labeling_totals(labels: DataFrame, reviews: DataFrame, rubric_id: int) -> DataFrame:
    """F1, F8: labels, review rows and mean confidence of a rubric, in one row."""
    mine = labels.where(F.col("rubric_id") == rubric_id)
    reviewed = reviews.join(mine.select("label_id"), "label_id", "left_semi").agg(
        F.count("*").alias("n")
    )
    return mine.agg(
        F.count("*").alias("total_labels"),
        F.coalesce(F.avg(F.coalesce("composite_confidence", F.lit(0.0))), F.lit(0.0)).alias(
            "avg_confidence"
        ),
    ).select("total_labels", reviewed.scalar().alias("reviewed"), "avg_confidence")


def category_counts(labels: DataFrame, rubric_id: int) -> DataFrame:
    """labels per predicted category."""
    return (
        labels.where(F.col("rubric_id") == rubric_id)
        .select(F.explode("predicted_categories").alias("category"))
        .groupBy("category").agg(F.count("*").alias("n_labels"))
    )


def confidence_histogram(labels: DataFrame, rubric_id: int, bins: int = 20) -> DataFrame:
    """the list of confidences as counts per bin and band (nulls count as 0)."""
    value = F.coalesce("composite_confidence", F.lit(0.0))
    return (
        labels.where(F.col("rubric_id") == rubric_id)
        .groupBy(
            F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int").alias("bin"),
            confidence_band(value).alias("band"),
        )
        .agg(F.count("*").alias("n_labels"))
    )


def document_label_status(docs: DataFrame, chunks: DataFrame, labels: DataFrame,
                          reviews: DataFrame, *, ordered: bool = False) -> DataFrame:
    """chunks, labels and reviewed labels per document, zeros included."""
    reviewed = reviews.select("label_id").distinct().withColumn("_r", F.lit(1))
    per_chunk = (
        labels.select("label_id", "chunk_id").join(reviewed, "label_id", "left")
        .groupBy("chunk_id")
        .agg(F.count("*").alias("n_labels"), F.count("_r").alias("n_reviewed"))
    )
    per_doc = (
        chunks.select("chunk_id", "doc_id").join(per_chunk, "chunk_id", "left")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("chunk_count"),
            F.sum("n_labels").alias("label_count"),
            F.sum("n_reviewed").alias("reviewed_count"),
        )
    )
    counts = ("chunk_count", "label_count", "reviewed_count")
    out = docs.select("doc_id", "filename", "status").join(per_doc, "doc_id", "left").select(
        "doc_id", "filename", "status",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
    )
    return out.orderBy("filename") if ordered else out


def corpus_totals(status: DataFrame) -> DataFrame:
    """totals over F2."""
    return status.agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum("label_count"), F.lit(0)).alias("n_labels"),
    )


def category_coverage(labels: DataFrame, chunks: DataFrame | None, current: DataFrame | None,
                      categories: DataFrame, rubric_id: int, *, ordered: bool = False) -> DataFrame:
    """use of each rubric category, and of categories outside the rubric.

    ``categories`` is the exploded rubric (``rubric_id, pos, name``). Statistics
    are first reduced to category and document, so the distinct document count
    is a plain count and one category with most labels is spread by document.
    Without ``chunks``, the labels must carry ``doc_id`` themselves; without
    ``current``, nothing has been reviewed.
    """
    mine = labels.where(F.col("rubric_id") == rubric_id)
    if chunks is not None:
        mine = mine.select(
            "label_id", "chunk_id", "predicted_categories", "composite_confidence"
        ).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    if current is None:
        mine = mine.withColumn("action", F.lit(None).cast("string"))
    else:
        mine = mine.join(current.select("label_id", "action"), "label_id", "left")
    used = mine.select(
        "doc_id", "action",
        F.coalesce("composite_confidence", F.lit(0.0)).alias("confidence"),
        F.explode("predicted_categories").alias("name"),
    )
    per_doc = used.groupBy("name", "doc_id").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("confidence"),
        F.count("action").alias("reviews"),
        F.count_if(F.col("action") == "correct").alias("corrected"),
    )
    stats = per_doc.groupBy("name").agg(
        F.sum("n").alias("n"),
        F.sum("confidence").alias("confidence"),
        F.count("*").alias("docs"),
        F.sum("reviews").alias("reviews"),
        F.sum("corrected").alias("corrected"),
    )
    rubric = categories.where(F.col("rubric_id") == rubric_id).select("name", "pos")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = rubric.join(stats, "name", "full_outer").select(
        "name",
        F.col("pos").isNotNull().alias("in_rubric"),
        zero("n").alias("count"),
        F.when(zero("n") > 0, F.col("confidence") / F.col("n")).otherwise(0.0).alias("avg_confidence"),
        zero("docs").alias("doc_count"),
        zero("reviews").alias("review_count"),
        F.when(zero("reviews") > 0, F.col("corrected") / F.col("reviews")).otherwise(0.0).alias("disagree_pct"),
        "pos",
    )
    if ordered:
        out = out.orderBy(F.asc_nulls_last("pos"), "name")
    return out.drop("pos")


def coverage_flags(coverage: DataFrame) -> DataFrame:
    """health flags per category of F4.

    A category is dead only once others are in use. Orphans carry no other flag.
    """
    total = coverage.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    member, used = F.col("in_rubric"), F.col("count") > 0
    return coverage.select(
        "*",
        (~member).alias("orphan"),
        (member & ~used & (total > 0)).alias("dead"),
        (member & used & (F.col("avg_confidence") < LOW_CONFIDENCE)).alias("low_confidence"),
        (
            member & used & (F.col("review_count") >= MIN_REVIEWS)
            & (F.col("disagree_pct") >= HIGH_DISAGREEMENT)
        ).alias("high_disagreement"),
    )


def flag_totals(flags: DataFrame) -> DataFrame:
    """number of categories per flag."""
    return flags.agg(
        F.sum("count").alias("total_labels"),
        F.count("*").alias("n_categories"),
        *[F.count_if(F.col(f)).alias(f"n_{f}")
          for f in ("dead", "low_confidence", "high_disagreement", "orphan")],
    )


def document_progress(status: DataFrame) -> DataFrame:
    """progress bucket of each document of F2."""
    bucket = (
        F.when(F.col("status") == "failed", "failed")
        .when(F.col("status") == "warnings", "warnings")
        .when(F.col("chunk_count") == 0, "unchunked")
        .when(F.col("label_count") == 0, "unlabeled")
        .when(F.col("label_count") < F.col("chunk_count"), "partial")
        .when(F.col("reviewed_count") < F.col("label_count"), "pending review")
        .otherwise("complete")
    )
    return status.withColumn("progress", bucket)


def results_table(labels: DataFrame, chunks: DataFrame, docs: DataFrame, current: DataFrame,
                  rubric_id: int) -> DataFrame:
    """one line per label: preview, document, categories, confidence, status."""
    mine = labels.where(F.col("rubric_id") == rubric_id).select(
        "label_id", "chunk_id", "predicted_categories", "composite_confidence"
    )
    preview = F.when(
        F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))
    ).otherwise(F.col("text"))
    finals = F.col("review.final_categories")
    return (
        with_reviews(mine, current)
        .join(chunks.select("chunk_id", "doc_id", preview.alias("preview")), "chunk_id", "left")
        .join(docs.select("doc_id", "filename"), "doc_id", "left")
        .select(
            "label_id", "chunk_id", "doc_id",
            F.coalesce("preview", F.lit("")).alias("preview"),
            F.coalesce("filename", F.lit("?")).alias("document"),
            # The list shows predictions as they are: no DNB for an empty one.
            F.when(F.size(finals) > 0, finals).otherwise(F.col("predicted_categories")).alias("categories"),
            effective_confidence().alias("confidence"),
            effective_status().alias("status"),
        )
    )


# The statuses a user picks, and the actions they stand for.
STATUS_NAMES = {"accepted": "accept", "flagged": "flag", "unreviewed": "unreviewed"}
ACTIONS = ("accept", "correct", "skip", "flag", "bypassed")


def filter_results(results: DataFrame, *, doc_id: int | None = None, category: str | None = None,
                   status: str | None = None) -> DataFrame:
    """filters of the results table; any of them may be left out.

    ``status`` is one of ``STATUS_NAMES`` or an action; anything else is an error.
    """
    if doc_id is not None:
        results = results.where(F.col("doc_id") == doc_id)
    if category is not None:
        results = results.where(F.array_contains("categories", category))
    if status is not None:
        action = STATUS_NAMES.get(status.lower(), status.lower())
        if action not in (*STATUS_NAMES.values(), *ACTIONS):
            raise ValueError(f"unknown status: {status}")
        results = results.where(F.col("status") == action)
    return results


def labels_with_embedding(labels: DataFrame, embeddings: DataFrame, rubric_id: int) -> DataFrame:
    """how many labels of a rubric sit on a chunk that has a vector."""
    return (
        labels.where(F.col("rubric_id") == rubric_id).select("chunk_id")
        .join(embeddings.where("embedding is not null").select("chunk_id"), "chunk_id", "left_semi")
        .agg(F.count("*").alias("n_labels"))
    )
