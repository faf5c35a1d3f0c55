"""Queries for corpus analytics and export (F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import analytics, export, rubrics
from corpusloom.session import shared_folder, written
from corpusloom.sources import tables as store
from corpusloom.workload.queries.ingest import joined, sha
from corpusloom.workload.registry import query
from corpusloom.workload.tables import LETTERS, OTHER_PROJECT_UUID, PROJECT_UUID, Tables


@query("f1_labeling_summary", needs=["labels_e", "reviews"], sql="""
    SELECT count(*) AS total_labels, (SELECT count(*) FROM reviews r JOIN labels_e l ON r.label_id = l.label_id WHERE l.rubric_id = 1) AS reviewed,
           round(avg(coalesce(composite_confidence, 0.0)), 6) AS avg_confidence FROM labels_e WHERE rubric_id = 1""")
def f1(t: Tables) -> DataFrame:
    return analytics.labeling_totals(t.labels(), t.reviews(), 1).withColumn(
        "avg_confidence", F.round("avg_confidence", 6)
    )


@query("f1_category_counts", needs=["labels_e"], sql="""
    SELECT category, count(*) AS n_labels FROM (SELECT unnest(predicted_categories) AS category FROM labels_e WHERE rubric_id = 1) GROUP BY category""")
def f1_counts(t: Tables) -> DataFrame:
    return analytics.category_counts(t.labels(), 1)


BAND = "CASE WHEN {c} < 0.3 THEN 'low' WHEN {c} < 0.7 THEN 'medium' ELSE 'high' END"


@query("f1_confidence_histogram", needs=["labels_e"], sql=f"""
    SELECT least(floor(coalesce(composite_confidence, 0.0)::DOUBLE * 20), 19)::INT AS bin, {BAND.format(c='coalesce(composite_confidence, 0.0)')} AS band,
           count(*) AS n_labels FROM labels_e WHERE rubric_id = 1 GROUP BY 1, 2""")
def f1_histogram(t: Tables) -> DataFrame:
    return analytics.confidence_histogram(t.labels(), 1)


def status(t: Tables) -> DataFrame:
    return analytics.document_label_status(t.documents(), t.chunks(), t.labels(), t.reviews())


@query("f2_document_label_status", needs=["status"], sql="SELECT * FROM status")
def f2(t: Tables) -> DataFrame:
    return status(t)


@query("f3_corpus_totals", needs=["status"], sql="""
    SELECT count(*) AS n_documents, sum(chunk_count)::BIGINT AS n_chunks, sum(label_count)::BIGINT AS n_labels FROM status""")
def f3(t: Tables) -> DataFrame:
    return analytics.corpus_totals(status(t))


def coverage(t: Tables) -> DataFrame:
    return analytics.category_coverage(t.labels(), t.chunks(), t.reviews(), t.categories(), 1)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "disagree_pct")})


COVERAGE = """name, in_rubric, count, round(avg_confidence, 6) AS avg_confidence, doc_count, review_count, round(disagree_pct, 6) AS disagree_pct"""
FLAGS = [("flags", """SELECT *, NOT in_rubric AS orphan, in_rubric AND count = 0 AND (SELECT sum(count) FROM coverage) > 0 AS dead,
    in_rubric AND count > 0 AND avg_confidence < 0.6 AS low_confidence,
    in_rubric AND count > 0 AND review_count >= 3 AND disagree_pct >= 0.3 AS high_disagreement FROM coverage""")]


@query("f4_category_coverage", needs=["coverage"], sql=f"SELECT {COVERAGE} FROM coverage")
def f4(t: Tables) -> DataFrame:
    return rounded(coverage(t))


@query("f5_coverage_flags", needs=["coverage"], extra=FLAGS,
       sql=f"SELECT {COVERAGE}, orphan, dead, low_confidence, high_disagreement FROM flags")
def f5(t: Tables) -> DataFrame:
    return rounded(analytics.coverage_flags(coverage(t)))


@query("f5_flag_totals", needs=["coverage"], extra=FLAGS, sql="""
    SELECT sum(count)::BIGINT AS total_labels, count(*) AS n_categories, count(*) FILTER (dead) AS n_dead,
      count(*) FILTER (low_confidence) AS n_low_confidence, count(*) FILTER (high_disagreement) AS n_high_disagreement,
      count(*) FILTER (orphan) AS n_orphan FROM flags""")
def f5_totals(t: Tables) -> DataFrame:
    return analytics.flag_totals(analytics.coverage_flags(coverage(t)))


@query("f6_document_progress", needs=["status"], sql="""
    SELECT doc_id, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'warnings' THEN 'warnings' WHEN chunk_count = 0 THEN 'unchunked'
      WHEN label_count = 0 THEN 'unlabeled' WHEN label_count < chunk_count THEN 'partial'
      WHEN reviewed_count < label_count THEN 'pending review' ELSE 'complete' END AS progress FROM status""")
def f6(t: Tables) -> DataFrame:
    return analytics.document_progress(status(t)).select("doc_id", "progress")


RESULTS = [("results", """SELECT l.label_id, l.chunk_id, c.doc_id, CASE WHEN length(c.text) > 80 THEN substring(c.text, 1, 80) || '...' ELSE c.text END AS preview,
    d.filename AS document, CASE WHEN len(r.final_categories) > 0 THEN r.final_categories ELSE l.predicted_categories END AS cats,
    CASE WHEN r.action IN ('accept', 'correct') THEN 1.0 ELSE coalesce(l.composite_confidence, 0.0) END AS confidence,
    coalesce(r.action, 'unreviewed') AS status
    FROM labels_e l JOIN chunks c ON l.chunk_id = c.chunk_id JOIN docs d ON d.doc_id = c.doc_id
    LEFT JOIN reviews r ON r.label_id = l.label_id WHERE l.rubric_id = 1""")]
RESULT_COLUMNS = "label_id, chunk_id, doc_id, preview, document, array_to_string(cats, '|') AS categories, confidence, status"


def results(t: Tables) -> DataFrame:
    return analytics.results_table(t.labels(), t.chunks(), t.documents(), t.reviews(), 1)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("categories", joined("categories"))


@query("f7_results_table", needs=["labels_e", "docs", "reviews"], extra=RESULTS, sql=f"SELECT {RESULT_COLUMNS} FROM results")
def f7(t: Tables) -> DataFrame:
    return shown(results(t))


@query("f7_filtered_results", needs=["labels_e", "docs", "reviews"], extra=RESULTS,
       sql=f"SELECT {RESULT_COLUMNS} FROM results WHERE list_contains(cats, 'quality') AND status = 'accept'")
def f7_filtered(t: Tables) -> DataFrame:
    return shown(analytics.filter_results(results(t), category="quality", status="Accepted"))


@query("f8_dashboard", needs=["labels_e", "reviews"], sql="""
    SELECT count(*) AS total_labels, (SELECT count(*) FROM reviews r JOIN labels_e l ON r.label_id = l.label_id WHERE l.rubric_id = 2) AS reviewed,
           round(avg(coalesce(composite_confidence, 0.0)), 6) AS avg_confidence FROM labels_e WHERE rubric_id = 2""")
def f8(t: Tables) -> DataFrame:
    return analytics.labeling_totals(t.labels(), t.reviews(), 2).withColumn(
        "avg_confidence", F.round("avg_confidence", 6)
    )


@query("f9_labels_with_embedding", needs=["labels_e", "embs"], sql="""
    SELECT count(*) AS n_labels FROM labels_e WHERE rubric_id = 1 AND chunk_id IN (SELECT chunk_id FROM embs)""")
def f9(t: Tables) -> DataFrame:
    return analytics.labels_with_embedding(t.labels(), t.chunk_embeddings(), 1)


@query("f10_confidence_bands", needs=["labels_e"], sql=f"""
    SELECT label_id, {BAND.format(c='composite_confidence')} AS band FROM labels_e WHERE composite_confidence IS NOT NULL""")
def f10(t: Tables) -> DataFrame:
    rows = t.labels().where("composite_confidence is not null")
    return rows.select("label_id", analytics.confidence_band(F.col("composite_confidence")).alias("band"))


# -------------------------------------------------------------------- export


def uuid_sql(project: str, chunk_id: str) -> str:
    x = f"sha1(unhex('{project.replace('-', '')}') || encode({chunk_id}::VARCHAR))"
    return f"""(substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-5' || substr({x}, 14, 3) || '-' ||
        translate(substr({x}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({x}, 18, 3) || '-' || substr({x}, 21, 12))"""


def records(t: Tables, project: str = PROJECT_UUID, limit: int | None = None) -> DataFrame:
    return export.chunk_records(
        t.labels(), t.chunks(), t.documents(), t.reviews(), t.chunk_embeddings(), rubric_id=1,
        rubric_version=1, project_uuid=project, limit=limit,
    )


def flat_records(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        *more, "label_id", "chunk_id", "chunk_uuid", sha("text").alias("text_hash"),
        F.col("source.document").alias("document"), F.col("source.document_id").alias("document_id"),
        joined("source.section_path").alias("section_path"), "source.char_start", "source.char_end",
        "token_count", "chunk_type", "boundary_confidence", "embedding_model",
        joined("label.categories").alias("categories"), F.col("label.rationale").alias("rationale"),
        F.col("label.composite_confidence").alias("composite_confidence"),
        F.col("label.logprob_signal").alias("logprob_signal"), F.col("label.llm_model").alias("llm_model"),
        F.col("label.rubric_version").alias("rubric_version"),
        F.col("label.human_review.action").alias("review_action"),
        joined("label.human_review.final_categories").alias("review_categories"),
        F.col("label.human_review.reviewer").alias("reviewer"), F.col("label.human_review.notes").alias("notes"),
    )


RECORD_COLUMNS = f"""l.label_id, l.chunk_id, {uuid_sql(PROJECT_UUID, 'l.chunk_id')} AS chunk_uuid, sha256(c.text) AS text_hash, d.filename AS document,
    c.doc_id AS document_id, array_to_string(c.section_path, '|') AS section_path, c.char_start, c.char_end, c.token_count, c.chunk_type,
    c.boundary_confidence, e.embedding_model, array_to_string(l.predicted_categories, '|') AS categories, l.rationale, l.composite_confidence,
    l.logprob_signal, 'm1' AS llm_model, 1 AS rubric_version, r.action AS review_action, array_to_string(r.final_categories, '|') AS review_categories,
    r.reviewer, r.notes"""
RECORD_JOIN = """FROM labels_e l JOIN chunks c ON l.chunk_id = c.chunk_id JOIN docs d ON d.doc_id = c.doc_id
    LEFT JOIN reviews r ON r.label_id = l.label_id LEFT JOIN embs e ON e.chunk_id = l.chunk_id WHERE l.rubric_id = 1"""
RECORD_NEEDS = ["labels_e", "chunks", "docs", "reviews", "embs"]


@query("g1_chunk_records", needs=RECORD_NEEDS, sql=f"SELECT {RECORD_COLUMNS} {RECORD_JOIN}")
def g1(t: Tables) -> DataFrame:
    return flat_records(records(t))


def manifest(t: Tables, sidecar: DataFrame | None = None) -> DataFrame:
    return export.manifest(
        t.labels(), t.reviews(), t.chunks(), rubric_id=1, rubric_name="labels", rubric_version=1,
        project_uuid=PROJECT_UUID, sidecar=sidecar,
    )


@query("g3_manifest", needs=RECORD_NEEDS, sql=f"""
    SELECT '{PROJECT_UUID}' AS project_uuid, 1 AS rubric_version, 'labels' AS rubric_name, (SELECT count(*) {RECORD_JOIN}) AS total_chunks,
      (SELECT count(*) FROM labels_e WHERE rubric_id = 1) AS labeled_chunks,
      (SELECT count(*) FROM reviews r JOIN labels_e l ON l.label_id = r.label_id WHERE rubric_id = 1) AS reviewed_chunks,
      false AS inline, 'chunk_uuid' AS primary_key, 'project_uuid|chunk_id' AS fallback_keys""")
def g3(t: Tables) -> DataFrame:
    return manifest(t).select(
        "project_uuid", "rubric_version", "rubric_name", "total_chunks", "labeled_chunks", "reviewed_chunks",
        F.col("embeddings.inline").alias("inline"), F.col("join_keys.primary").alias("primary_key"),
        joined("join_keys.fallback").alias("fallback_keys"),
    )


@query("g4_rubric_payload", needs=["rubric_cats"], sql="""
    SELECT lang AS rubric, 1 AS version, name, definition, len(exemplars) AS n_exemplars,
           sha256(array_to_string(exemplars, '|')) AS exemplars_hash, len(boundary_cases) AS n_boundary_cases, 0.85 AS confidence_threshold FROM rubric_cats""")
def g4(t: Tables) -> DataFrame:
    return rubrics.rubric_payload(t.rubrics()).select(
        F.col("name").alias("rubric"), "version", F.explode("categories").alias("c")
    ).select(
        "rubric", "version", "c.name", "c.definition", F.size("c.exemplars").alias("n_exemplars"),
        sha(joined("c.exemplars")).alias("exemplars_hash"), F.size("c.boundary_cases").alias("n_boundary_cases"),
        "c.confidence_threshold",
    )


def sidecar(t: Tables) -> DataFrame:
    return export.sidecar_rows(
        t.labels(), t.chunks(), t.documents(), t.chunk_embeddings(), rubric_id=1, project_uuid=PROJECT_UUID
    )


def flat_sidecar(df: DataFrame) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "chunk_uuid", "project_uuid", "chunk_id", "document_id", "document_filename",
        F.size("embedding").alias("dim"), total.alias("total"), "embedding_model",
    )


SIDECAR = f"""SELECT DISTINCT {uuid_sql(PROJECT_UUID, 'l.chunk_id')} AS chunk_uuid, '{PROJECT_UUID}' AS project_uuid, l.chunk_id, l.doc_id AS document_id,
    d.filename AS document_filename, {len(LETTERS)} AS dim, list_sum(e.embedding) AS total, e.embedding_model
    FROM labels_e l JOIN embs e ON e.chunk_id = l.chunk_id JOIN docs d ON d.doc_id = l.doc_id WHERE l.rubric_id = 1"""
SIDECAR_NEEDS = ["labels_e", "embs", "docs"]


@query("g5_sidecar_rows", needs=SIDECAR_NEEDS, sql=SIDECAR)
def g5(t: Tables) -> DataFrame:
    return flat_sidecar(sidecar(t))


@query("g5_sidecar_manifest", needs=SIDECAR_NEEDS, extra=[("s", SIDECAR)], sql="""
    SELECT 'e.parquet' AS path, count(*) AS rows, max(dim) AS dim, string_agg(DISTINCT embedding_model, '|' ORDER BY embedding_model) AS models,
           'chunk_uuid|project_uuid|chunk_id' AS join_keys, 'parquet' AS format, false AS dims_differ FROM s""")
def g5_manifest(t: Tables) -> DataFrame:
    return export.sidecar_manifest(sidecar(t), "e.parquet").withColumns(
        {"models": joined("models"), "join_keys": joined("join_keys")}
    )


@query("g6_export_preview", needs=RECORD_NEEDS, sql=f"""
    SELECT * FROM (SELECT {RECORD_COLUMNS}, (SELECT count(*) FROM labels_e WHERE rubric_id = 1) AS total_chunks,
      (SELECT count(DISTINCT chunk_id) FROM labels_e WHERE rubric_id = 1 AND chunk_id IN (SELECT chunk_id FROM embs)) AS sidecar_rows
      {RECORD_JOIN} ORDER BY l.label_id LIMIT 5)""")
def g6(t: Tables) -> DataFrame:
    p = export.preview(
        t.labels(), t.chunks(), t.documents(), t.reviews(), t.chunk_embeddings(), rubric_id=1,
        rubric_version=1, project_uuid=PROJECT_UUID, max_chunks=5,
    )
    return flat_records(p, "total_chunks", "sidecar_rows")


@query("g6_preview_manifest", needs=RECORD_NEEDS, sql=f"""
    SELECT '{PROJECT_UUID}' AS project_uuid, 'labels' AS rubric_name, (SELECT count(*) {RECORD_JOIN}) AS total_records,
      (SELECT count(*) FROM labels_e WHERE rubric_id = 1) AS total_chunks, 3 AS rendered_chunks,
      (SELECT count(DISTINCT chunk_id) FROM labels_e WHERE rubric_id = 1 AND chunk_id IN (SELECT chunk_id FROM embs)) AS sidecar_rows,
      {len(LETTERS)} AS dim, 'preview_embeddings.parquet' AS path, true AS preview_only""")
def g6_manifest(t: Tables) -> DataFrame:
    head = export.preview_manifest(
        t.labels(), t.reviews(), t.chunks(), t.chunk_embeddings(), rubric_id=1, rubric_name="labels",
        rubric_version=1, project_uuid=PROJECT_UUID, max_chunks=3,
    )
    side = "embeddings.sidecar"
    return head.select(
        "project_uuid", "rubric_name", F.col("total_chunks").alias("total_records"), "preview.total_chunks",
        F.col("preview.rendered_chunks").cast("int").alias("rendered_chunks"), F.col(f"{side}.rows").alias("sidecar_rows"),
        F.col(f"{side}.dim").alias("dim"), F.col(f"{side}.path").alias("path"), F.col(f"{side}.preview_only").alias("preview_only"),
    )


@query("g7_records_with_vectors", needs=RECORD_NEEDS, sql=f"""
    SELECT {RECORD_COLUMNS}, CASE WHEN e.chunk_id IS NOT NULL THEN '{PROJECT_UUID}' END AS project_uuid,
           list_sum(e.embedding) AS vector_total {RECORD_JOIN}""")
def g7(t: Tables) -> DataFrame:
    """Every label of a chunk gets the chunk's vector; the sidecar is read twice over."""
    rows = export.join_sidecar(records(t), sidecar(t).unionByName(sidecar(t)))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return flat_records(rows.withColumn("vector_total", total), "project_uuid", "vector_total")


@query("g7_merged_exports", needs=RECORD_NEEDS, sql=f"""
    SELECT {RECORD_COLUMNS} {RECORD_JOIN}
    UNION ALL SELECT {RECORD_COLUMNS.replace(uuid_sql(PROJECT_UUID, 'l.chunk_id'), uuid_sql(OTHER_PROJECT_UUID, 'l.chunk_id'))} {RECORD_JOIN}""")
def g7_merged(t: Tables) -> DataFrame:
    """Two projects with the same chunk numbers, one of them exported twice."""
    one = written(records(t), "export")
    other = one.withColumn("chunk_uuid", export.chunk_uuid(OTHER_PROJECT_UUID, F.col("chunk_id")))
    return flat_records(export.merge_exports([one, other, one]))


@query("g7_merged_versions", needs=RECORD_NEEDS, sql=f"""
    SELECT {RECORD_COLUMNS.replace("l.rationale", "CASE WHEN r.action IS NULL THEN 'newer' ELSE l.rationale END AS rationale")} {RECORD_JOIN}""")
def g7_versions(t: Tables) -> DataFrame:
    """A later export that knows no review: reviewed records win over it, others are replaced by it."""
    one = records(t)
    review = one.schema["label"].dataType["human_review"].dataType
    later = one.withColumn("label", F.col("label").withField("rationale", F.lit("newer")).withField(
        "human_review", F.lit(None).cast(review)))
    return flat_records(export.merge_exports([one, later, one.limit(0)]))


@query("a12_exported_corpus", needs=RECORD_NEEDS, sql=f"SELECT {RECORD_COLUMNS} {RECORD_JOIN}")
def a12(t: Tables) -> DataFrame:
    """Written as JSON lines to the shared folder, and read back."""
    path = shared_folder(t.spark, "corpus")
    rows = records(t)
    store.write_corpus_json(rows, manifest(t), rubrics.rubric_payload(t.label_rubrics()), path)
    return flat_records(t.spark.read.schema(rows.schema).json(f"{path}/chunks"))


@query("a13_embedding_sidecar", needs=SIDECAR_NEEDS, sql=SIDECAR)
def a13(t: Tables) -> DataFrame:
    """Written as Parquet to the shared folder, and read back."""
    path = shared_folder(t.spark, "sidecar") + "/corpus_embeddings.parquet"
    store.write_sidecar(sidecar(t), path)
    return flat_sidecar(t.spark.read.parquet(path))
