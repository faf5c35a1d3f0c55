"""Queries for human review (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import labels, reviews
from corpusloom.schemas import DNB
from corpusloom.workload.queries.ingest import joined
from corpusloom.workload.registry import query
from corpusloom.workload.tables import Tables

FINAL = "array_to_string(final_categories, '|')"


def review_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "review_id", "label_id", "reviewer", "action", joined("final_categories").alias("final"), "notes"
    )


@query("e1_current_reviews", needs=["reviews"],
       sql=f"SELECT review_id, label_id, reviewer, action, {FINAL} AS final, notes FROM reviews")
def e1(t: Tables) -> DataFrame:
    return review_rows(reviews.current_reviews(t.review_log()))


DECISIONS = [("dec", """
    SELECT event_id AS review_id, event_id % (SELECT count(*) FROM documents) * 1000000 + 1 + event_id * 7 % 40 AS label_id,
      CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'correct' WHEN 'view' THEN 'skip' ELSE 'flag' END AS action,
      CASE WHEN value >= 20 THEN ['quality'] ELSE []::VARCHAR[] END AS chosen FROM events"""),
    ("judged", """SELECT d.*, l.predicted_categories AS p, CASE WHEN l.label_id IS NULL THEN 'label not found'
      WHEN action = 'correct' AND len(chosen) = 0 THEN 'pick at least one category' END AS reason
      FROM dec d LEFT JOIN labels_e l ON d.label_id = l.label_id""")]


def decisions(t: Tables) -> DataFrame:
    """Events as decisions on lines of all texts, some on labels that do not exist or without a choice."""
    kind = F.col("event_type")
    n = t.given("documents").agg(F.count("*")).scalar()
    return t.given("events").select(
        F.col("event_id").alias("review_id"),
        (F.col("event_id") % n * 1_000_000 + 1 + F.col("event_id") * 7 % 40).alias("label_id"),
        F.when(kind == "purchase", "accept").when(kind == "click", "correct").when(kind == "view", "skip").otherwise("flag").alias("action"),
        F.when(F.col("value") >= 20, F.array(F.lit("quality"))).alias("chosen"),
    )


@query("e2_submitted_reviews", needs=["labels_e"], extra=DECISIONS, sql="""
    SELECT review_id, label_id, action, array_to_string(CASE action WHEN 'accept' THEN p WHEN 'correct' THEN chosen ELSE []::VARCHAR[] END, '|') AS final
    FROM judged WHERE reason IS NULL""")
def e2(t: Tables) -> DataFrame:
    return reviews.submit_reviews(decisions(t), t.labels())[0].select(
        "review_id", "label_id", "action", joined("final_categories").alias("final")
    )


@query("e2_rejected_reviews", needs=["labels_e"], extra=DECISIONS,
       sql="SELECT review_id, label_id, action, reason FROM judged WHERE reason IS NOT NULL")
def e2_rejects(t: Tables) -> DataFrame:
    return reviews.submit_reviews(decisions(t), t.labels())[1]


QUEUE = """SELECT c.doc_id, c.chunk_id, l.label_id, l.composite_confidence FROM live c JOIN labels_e l ON c.chunk_id = l.chunk_id
    WHERE l.rubric_id = 1 AND l.composite_confidence <= 0.7 AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.label_id = l.label_id)"""


@query("e3_review_queue", needs=["live", "labels_e", "reviews"], sql=QUEUE)
def e3(t: Tables) -> DataFrame:
    return reviews.review_queue(
        t.chunks(), t.runs(), t.labels(), t.reviews(), 1, threshold=0.7
    ).select("doc_id", "chunk_id", "label_id", "composite_confidence")


@query("e3_review_queue_top", needs=["live", "labels_e", "reviews"],
       sql=QUEUE + " ORDER BY composite_confidence, label_id LIMIT 100")
def e3_top(t: Tables) -> DataFrame:
    return reviews.review_queue(
        t.chunks(), t.runs(), t.labels(), t.reviews(), 1, threshold=0.7, limit=100
    ).select("doc_id", "chunk_id", "label_id", "composite_confidence")


@query("e4_bypass_reviews", needs=["labels_e", "reviews", "docs"], sql="""
    SELECT label_id, 'bypassed' AS action, array_to_string(predicted_categories, '|') AS final FROM labels_e l
    WHERE rubric_id = 1 AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.label_id = l.label_id)
      AND doc_id IN (SELECT doc_id FROM docs WHERE status = 'parsed')""")
def e4(t: Tables) -> DataFrame:
    rows = reviews.bypass_unreviewed(
        t.labels(), t.reviews(), 1, chunks=t.chunks(), docs=t.documents().where("status = 'parsed'")
    )
    return rows.select("label_id", "action", joined("final_categories").alias("final"))


EFFECTIVE = f"""CASE WHEN len(r.final_categories) > 0 THEN r.final_categories WHEN len(l.predicted_categories) > 0
    THEN l.predicted_categories ELSE ['{DNB}'] END"""


@query("e5_effective_outcomes", needs=["labels_e", "reviews"], sql=f"""
    SELECT l.label_id, l.rubric_id, array_to_string({EFFECTIVE}, '|') AS categories,
           CASE WHEN r.action IN ('accept', 'correct') THEN 1.0 ELSE coalesce(composite_confidence, 0.0) END AS confidence,
           coalesce(r.action, 'unreviewed') AS status
    FROM labels_e l LEFT JOIN reviews r ON l.label_id = r.label_id""")
def e5(t: Tables) -> DataFrame:
    return reviews.effective_outcomes(t.labels(), t.reviews()).select(
        "label_id", "rubric_id", joined("categories").alias("categories"), "confidence", "status"
    )


STATES = [
    ("lastl", "SELECT * FROM labels_e WHERE rubric_id = 1 AND label_id IN (SELECT max(label_id) FROM labels_e WHERE rubric_id = 1 GROUP BY chunk_id)"),
    ("states", f"""SELECT c.doc_id, c.chunk_id, c.char_start, l.label_id IS NOT NULL AS labeled, r.review_id IS NOT NULL AS reviewed,
        coalesce(r.action, '') AS action, CASE WHEN l.label_id IS NULL THEN 'pending' ELSE ({EFFECTIVE})[1] END AS status
        FROM live c LEFT JOIN lastl l ON l.chunk_id = c.chunk_id LEFT JOIN reviews r ON r.label_id = l.label_id"""),
]


def states(t: Tables) -> DataFrame:
    latest = labels.latest_labels(t.labels(), 1)
    return reviews.latest_run_states(t.chunks(), t.runs(), latest, t.reviews())


@query("e6_next_unreviewed", needs=["live", "labels_e", "reviews"], extra=STATES, sql="""
    SELECT doc_id, chunk_id, arg_min(n.nid, n.npos) AS next_chunk_id FROM (
      SELECT s.doc_id, s.chunk_id, n.chunk_id AS nid, n.char_start AS npos FROM states s LEFT JOIN states n
        ON n.doc_id = s.doc_id AND n.char_start > s.char_start AND n.labeled AND NOT n.reviewed) n GROUP BY doc_id, chunk_id""")
def e6(t: Tables) -> DataFrame:
    return reviews.next_unreviewed(states(t)).select("doc_id", "chunk_id", "next_chunk_id")


@query("e7_work_order", needs=["live", "labels_e", "reviews"], extra=STATES, sql="""
    SELECT doc_id, chunk_id, action, row_number() OVER (PARTITION BY doc_id ORDER BY
      CASE action WHEN 'flag' THEN 0 WHEN 'skip' THEN 1 WHEN 'correct' THEN 2 WHEN 'accept' THEN 3 ELSE 99 END, char_start) AS work_pos FROM states""")
def e7(t: Tables) -> DataFrame:
    return reviews.work_order(states(t)).select("doc_id", "chunk_id", "action", "work_pos")


@query("e9_status_runs", needs=["live", "labels_e", "reviews"], extra=STATES + [
    ("ch", "SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER (PARTITION BY doc_id ORDER BY char_start) THEN 1 ELSE 0 END AS c FROM states"),
    ("g", "SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY char_start) AS run_no FROM ch")], sql="""
    SELECT doc_id, run_no::BIGINT AS run_no, status, min(char_start) AS run_start, max(char_start) AS run_end, count(*) AS n_rows
    FROM g GROUP BY 1, 2, 3""")
def e9(t: Tables) -> DataFrame:
    return reviews.status_runs(states(t))


@query("e10_category_confidences", needs=["labels_e", "reviews"], sql="""
    SELECT label_id, category, round(confidence, 6) AS confidence FROM (
      SELECT l.label_id, unnest(predicted_categories) AS category, conf / generate_subscripts(predicted_categories, 1) AS confidence
      FROM labels_e l LEFT JOIN reviews r ON l.label_id = r.label_id WHERE coalesce(len(r.final_categories), 0) = 0
      UNION ALL
      SELECT l.label_id, unnest(list_distinct(r.final_categories)), 1.0 FROM labels_e l JOIN reviews r ON l.label_id = r.label_id)""")
def e10(t: Tables) -> DataFrame:
    return reviews.category_confidences(t.labels(), t.reviews()).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query("e11_reviews_of_label", needs=["review_log"], extra=[
    ("most", "SELECT label_id FROM review_log GROUP BY label_id ORDER BY count(*) DESC, label_id LIMIT 1")],
       sql=f"SELECT review_id, label_id, reviewer, action, {FINAL} AS final, notes FROM review_log WHERE label_id = (SELECT label_id FROM most)")
def e11(t: Tables) -> DataFrame:
    """The whole history of the label that was reviewed most."""
    most = t.review_log().groupBy("label_id").count().orderBy(F.desc("count"), "label_id").first()
    return review_rows(reviews.find_reviews(t.review_log(), most.label_id if most else -1))
