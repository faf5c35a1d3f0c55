"""Table schemas and reserved values of a labeled-corpus project."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

# Fixed values.
DNB = "DNB (does not belong)"
SUPPORTED_EXTENSIONS = (".docx", ".markdown", ".md", ".pdf", ".text", ".txt")
DEFAULT_CONFIDENCE_THRESHOLD = 0.85


HEADINGS = "array<struct<level:int,text:string,char_start:int,char_end:int>>"
SECTIONS = "array<struct<section_path:array<string>,char_start:int,char_end:int>>"
PAGES = "array<struct<page_number:int,char_start:int,char_end:int>>"
CATEGORIES = (
    "array<struct<name:string,definition:string,exemplars:array<string>,"
    "boundary_cases:array<string>,confidence_threshold:double,parent:string>>"
)

DOCUMENTS = f"""
    doc_id bigint, filename string, format string, full_text string,
    headings {HEADINGS}, pages {PAGES}, sections {SECTIONS},
    metadata map<string,string>, status string, warnings array<string>,
    ingested_at timestamp, source_hash string"""
RUBRIC_VERSIONS = f"""
    rubric_id bigint, name string, version int, categories {CATEGORIES}, created_at timestamp"""
CHUNKING_RUNS = """
    run_id bigint, doc_id bigint, strategy string, params map<string,string>,
    started_at timestamp, n_chunks int"""
CHUNKS = """
    chunk_id bigint, doc_id bigint, run_id bigint, text string, char_start int, char_end int,
    section_path array<string>, token_count int, chunk_type string,
    boundary_confidence double, manual_override map<string,string>"""
# Vectors live beside the chunks, so that scans of chunk text never read them.
CHUNK_EMBEDDINGS = """
    chunk_id bigint, embedding array<float>, embedding_model string"""
LABELS = """
    label_id bigint, chunk_id bigint, rubric_id bigint, predicted_categories array<string>,
    confidence map<string,double>, rationale string, knn_agreement double,
    logprob_signal double, composite_confidence double, llm_model string,
    llm_run_id string, created_at timestamp"""
HUMAN_REVIEWS = """
    review_id bigint, label_id bigint, reviewer string, action string,
    final_categories array<string>, notes string, reviewed_at timestamp"""
AUDIT_EVENTS = """
    event_id bigint, event_type string, actor string, ts timestamp,
    payload map<string,string>, related_chunk_ids array<bigint>"""

TABLES = {
    "documents": DOCUMENTS,
    "rubric_versions": RUBRIC_VERSIONS,
    "chunking_runs": CHUNKING_RUNS,
    "chunks": CHUNKS,
    "chunk_embeddings": CHUNK_EMBEDDINGS,
    "labels": LABELS,
    "human_reviews": HUMAN_REVIEWS,
    "audit_events": AUDIT_EVENTS,
}


@cache
def table_schema(table: str) -> T.StructType:
    """The schema of a project table; parsing it takes an active session."""
    return T.StructType.fromDDL(" ".join(TABLES[table].split()))
