"""Human review: current decisions, queue, bypass, work order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.operators.positions import next_match, number_rows, runs as position_runs
from corpusloom.operators.runs import in_latest_run
from corpusloom.schemas import DNB

# The order in which reviewers are shown decisions.
WORK_ORDER = {"flag": 0, "skip": 1, "correct": 2, "accept": 3}
OTHER_WORK = 99


def current_reviews(log: DataFrame) -> DataFrame:
    """The newest review of each label, by time and then id.

    An aggregation, not a window: a label with very many reviews sends one row
    per task.
    """
    fields = [c for c in log.columns if c != "label_id"]
    newest = log.groupBy("label_id").agg(
        F.max_by(F.struct(*fields), F.struct("reviewed_at", "review_id")).alias("r")
    )
    return newest.select("label_id", *[F.col(f"r.{c}").alias(c) for c in fields]).select(log.columns)


def submit_reviews(decisions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions ``(label_id, action, chosen, …)`` to review rows and rejects.

    Accepting copies the predictions, skipping and flagging store none, and a
    correction must choose at least one category.
    """
    known = labels.select("label_id", "predicted_categories")
    joined = decisions.join(known, "label_id", "left")
    none = arrays.empty_array("string")
    chosen = F.coalesce("chosen", none)
    reason = F.when(F.col("predicted_categories").isNull(), "label not found").when(
        (F.col("action") == "correct") & (F.size(chosen) == 0), "pick at least one category"
    )
    finals = (
        F.when(F.col("action") == "accept", F.col("predicted_categories"))
        .when(F.col("action") == "correct", chosen)
        .otherwise(none)
    )
    judged = joined.withColumn("reason", reason).withColumn("final_categories", finals)
    base = [c for c in decisions.columns if c != "chosen"]
    return (
        judged.where("reason is null").select(*base, "final_categories"),
        judged.where("reason is not null").select(*base, "reason"),
    )


def review_queue(chunks: DataFrame, runs: DataFrame, labels: DataFrame, reviews: DataFrame,
                 rubric_id: int, *, threshold: float = 1.0, doc_id: int | None = None,
                 limit: int | None = None, ordered: bool = False) -> DataFrame:
    """Unreviewed labels at or below a confidence, least confident first.

    With ``limit`` the sort becomes a top-k per task.
    """
    mine = labels.where(
        (F.col("rubric_id") == rubric_id) & (F.col("composite_confidence") <= threshold)
    )
    if doc_id is not None:
        chunks = chunks.where(F.col("doc_id") == doc_id)
        runs = runs.where(F.col("doc_id") == doc_id)
    open_labels = mine.join(reviews.select("label_id"), "label_id", "left_anti")
    # Open labels thin the chunks out before these are matched to runs.
    queue = in_latest_run(chunks.join(open_labels, "chunk_id"), runs)
    if ordered or limit is not None:
        queue = queue.orderBy("composite_confidence", "label_id")
    return queue if limit is None else queue.limit(limit)


def bypass_unreviewed(labels: DataFrame, reviews: DataFrame, rubric_id: int, *,
                      chunks: DataFrame | None = None, docs: DataFrame | None = None,
                      reviewed_at=None) -> DataFrame:
    """Review rows that pass every unreviewed label with its predictions.

    ``docs`` (with ``chunks``) limits the job to some documents. Labels that
    have a review are left alone.
    """
    todo = labels.where(F.col("rubric_id") == rubric_id).join(
        reviews.select("label_id"), "label_id", "left_anti"
    )
    if docs is not None:
        scope = chunks.select("chunk_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
        todo = todo.join(scope, "chunk_id", "left_semi")
    when = F.current_timestamp() if reviewed_at is None else F.lit(reviewed_at).cast("timestamp")
    return todo.select(
        # One for each label, and never the id of a review that a person wrote.
        (-F.col("label_id") - 1).alias("review_id"),
        "label_id",
        F.lit("default").alias("reviewer"),
        F.lit("bypassed").alias("action"),
        F.col("predicted_categories").alias("final_categories"),
        F.lit("").alias("notes"),
        when.alias("reviewed_at"),
    )


def with_reviews(labels: DataFrame, current: DataFrame) -> DataFrame:
    """Labels with their current review as the struct ``review`` (null if none)."""
    fields = [c for c in current.columns if c != "label_id"]
    return labels.join(current.select("label_id", F.struct(*fields).alias("review")), "label_id", "left")


def effective_categories() -> Column:
    """E5: non-empty final categories, else the predicted ones, else DNB."""
    finals = F.col("review.final_categories")
    return (
        F.when(F.size(finals) > 0, finals)
        .when(F.size("predicted_categories") > 0, F.col("predicted_categories"))
        .otherwise(F.array(F.lit(DNB)))
    )


def effective_confidence() -> Column:
    """E5: 1.0 where a person accepted or corrected, else the composite."""
    return F.when(F.col("review.action").isin("accept", "correct"), F.lit(1.0)).otherwise(
        F.coalesce("composite_confidence", F.lit(0.0))
    )


def effective_status() -> Column:
    """E5: the review action, or ``unreviewed``."""
    return F.coalesce("review.action", F.lit("unreviewed"))


def effective_outcomes(labels: DataFrame, current: DataFrame) -> DataFrame:
    """E5: what each label finally says."""
    return with_reviews(labels, current).select(
        "label_id", "chunk_id", "rubric_id",
        effective_categories().alias("categories"),
        effective_confidence().alias("confidence"),
        effective_status().alias("status"),
    )


def next_unreviewed(chunk_states: DataFrame) -> DataFrame:
    """For each chunk the next one of its document that is labeled but not reviewed.

    ``chunk_states`` has ``doc_id, chunk_id, char_start, labeled, reviewed``.
    """
    return next_match(
        chunk_states, ["doc_id"], "char_start", F.col("labeled") & ~F.col("reviewed"),
        "chunk_id", out="next_chunk_id",
    )


def work_order(chunk_states: DataFrame) -> DataFrame:
    """Place of each chunk in its document's review order.

    Flagged first, then skipped, corrected and accepted ones, then all others;
    text order within each. ``chunk_states`` has ``doc_id, chunk_id, char_start,
    action``. The place is the count of more urgent chunks, which is one number
    per document and action, plus the position among equals.
    """
    rank = F.lit(OTHER_WORK)
    for action, priority in WORK_ORDER.items():
        rank = F.when(F.col("action") == action, priority).otherwise(rank)
    rows = chunk_states.withColumn("priority", rank)
    counts = rows.groupBy("doc_id").pivot("priority", [*WORK_ORDER.values(), OTHER_WORK]).count()
    levels = sorted(WORK_ORDER.values()) + [OTHER_WORK]
    n = {p: F.coalesce(F.col(str(p)), F.lit(0)) for p in levels}
    before = F.create_map(
        *[x for i, p in enumerate(levels)
          for x in (F.lit(p), sum((n[q] for q in levels[:i]), F.lit(0)))]
    )
    numbered = number_rows(rows, ["doc_id", "priority"], "char_start", ties=["chunk_id"], out="_at")
    return (
        numbered.join(counts.select("doc_id", before.alias("_before")), "doc_id")
        .withColumn("work_pos", F.col("_at") + F.col("_before")[F.col("priority")])
        .drop("_at", "_before")
    )


def status_runs(chunk_states: DataFrame) -> DataFrame:
    """Runs of chunks with equal ``status`` along each document."""
    return position_runs(chunk_states, ["doc_id"], "char_start", "status", ties=["chunk_id"])


def category_confidences(labels: DataFrame, current: DataFrame, *, ordered: bool = False) -> DataFrame:
    """One row per label and category; chosen categories count as 1.0."""
    finals = F.col("review.final_categories")
    ones = F.map_from_arrays(
        F.array_distinct(finals), F.transform(F.array_distinct(finals), lambda _: F.lit(1.0))
    )
    source = F.when(F.size(finals) > 0, ones).otherwise(F.col("confidence"))
    rows = with_reviews(labels, current).select(
        "label_id", F.explode(source).alias("category", "confidence")
    )
    return rows.orderBy("label_id", F.desc("confidence")) if ordered else rows


def find_reviews(reviews: DataFrame, label_id: int) -> DataFrame:
    """Reviews of one label."""
    return reviews.where(F.col("label_id") == label_id)


def chunk_states(chunks: DataFrame, latest: DataFrame, current: DataFrame) -> DataFrame:
    """Per chunk: labeled?, reviewed?, the review action and the shown category.

    ``latest`` holds at most one label per chunk (D17), ``current`` one review
    per label (E1). Feeds E6, E7 and E9.
    """
    shown = with_reviews(latest, current).select(
        "chunk_id",
        F.struct(
            F.col("review").isNotNull().alias("reviewed"),
            F.col("review.action").alias("action"),
            F.get(effective_categories(), F.lit(0)).alias("category"),
        ).alias("s"),
    )
    return chunks.select("doc_id", "chunk_id", "char_start").join(shown, "chunk_id", "left").select(
        "doc_id", "chunk_id", "char_start",
        F.col("s").isNotNull().alias("labeled"),
        F.coalesce("s.reviewed", F.lit(False)).alias("reviewed"),
        F.coalesce("s.action", F.lit("")).alias("action"),
        F.coalesce("s.category", F.lit("pending")).alias("status"),
    )


def latest_run_states(chunks: DataFrame, runs: DataFrame, latest: DataFrame,
                      current: DataFrame) -> DataFrame:
    """``chunk_states`` for each document's newest run."""
    return chunk_states(in_latest_run(chunks, runs), latest, current)
