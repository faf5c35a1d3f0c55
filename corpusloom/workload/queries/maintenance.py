"""Queries for lineage and audit (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import audit, lineage
from corpusloom.session import shared_folder
from corpusloom.workload.queries.ingest import joined, sha
from corpusloom.workload.registry import query
from corpusloom.workload.tables import Tables


def survivors(tables: dict[str, DataFrame]) -> DataFrame:
    """The keys of every surviving row of every table."""
    keys = {"documents": "doc_id", "chunking_runs": "run_id", "chunks": "chunk_id", "labels": "label_id",
            "human_reviews": "review_id", "chunk_embeddings": "chunk_id"}
    parts = [
        tables[n].select(F.lit(n).alias("table_name"), F.col(k).cast("long").alias("id"))
        for n, k in keys.items() if n in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GONE = "(SELECT doc_id FROM docs WHERE {where})"
SURVIVORS = """
    SELECT 'chunking_runs' AS table_name, run_id AS id FROM runs WHERE doc_id NOT IN {gone}
    UNION ALL SELECT 'chunks', chunk_id FROM chunks WHERE doc_id NOT IN {gone}
    UNION ALL SELECT 'labels', label_id FROM labels_e WHERE doc_id NOT IN {gone}
    UNION ALL SELECT 'human_reviews', review_id FROM reviews WHERE label_id NOT IN (SELECT label_id FROM labels_e WHERE doc_id IN {gone})
    UNION ALL SELECT 'chunk_embeddings', chunk_id FROM embs WHERE doc_id NOT IN {gone}
    UNION ALL SELECT 'documents', doc_id FROM docs"""
NEEDS = ["docs", "runs", "chunks", "labels_e", "reviews", "embs"]


@query("h1_deleted_documents", needs=NEEDS, sql=SURVIVORS.replace("{gone}", GONE.format(where="lang = 'fr'"))
       + " WHERE doc_id NOT IN " + GONE.format(where="lang = 'fr'"))
def h1(t: Tables) -> DataFrame:
    """All French texts deleted, with all that hangs on them."""
    return survivors(lineage.delete_documents(t.tables(), t.documents().where("lang = 'fr'")))


@query("h2_dropped_chunking", needs=NEEDS, sql=SURVIVORS.replace("{gone}", GONE.format(where="status <> 'parsed' OR lang = 'en'")))
def h2(t: Tables) -> DataFrame:
    return survivors(lineage.drop_chunking(t.tables(), t.documents().where("status <> 'parsed' or lang = 'en'")))


def conversions(t: Tables) -> DataFrame:
    """Spanish texts converted anew; the long ones have changed."""
    d = t.documents().where("lang = 'es'")
    body = F.when(F.length("full_text") > 1500, F.upper("full_text")).otherwise(F.col("full_text"))
    return d.withColumn("full_text", body).withColumn("source_hash", sha("full_text")).select(
        "doc_id", "filename", "full_text", "source_hash", F.lit("parsed").alias("status")
    )


@query("h3_replaced_documents", needs=["docs"], sql="""
    SELECT doc_id, filename, sha256(full_text) AS text_hash, source_hash, status FROM docs WHERE NOT (lang = 'es' AND length(full_text) > 1500)
    UNION ALL SELECT doc_id, filename, sha256(upper(full_text)), sha256(upper(full_text)), 'parsed' FROM docs WHERE lang = 'es' AND length(full_text) > 1500""")
def h3(t: Tables) -> DataFrame:
    changed = lineage.changed_conversions(t.documents(), conversions(t))
    out = lineage.replace_content(t.tables(), changed)["documents"]
    return out.select("doc_id", "filename", sha("full_text").alias("text_hash"), "source_hash", "status")


@query("h3_rows_after_replace", needs=NEEDS, sql=SURVIVORS.replace(
    "{gone}", GONE.format(where="lang = 'es' AND length(full_text) > 1500")))
def h3_rows(t: Tables) -> DataFrame:
    changed = lineage.changed_conversions(t.documents(), conversions(t))
    return survivors(lineage.replace_content(t.tables(), changed))


@query("h3_rows_after_edits", needs=["chunks", "labels_e", "reviews", "embs"], sql="""
    SELECT 'labels' AS table_name, label_id AS id FROM labels_e WHERE chunk_id % 5 <> 0
    UNION ALL SELECT 'human_reviews', review_id FROM reviews WHERE label_id IN (SELECT label_id FROM labels_e WHERE chunk_id % 5 <> 0)
    UNION ALL SELECT 'chunk_embeddings', chunk_id FROM embs WHERE chunk_id % 5 <> 0""")
def h3_edits(t: Tables) -> DataFrame:
    """Every fifth chunk was edited: its vector, labels and their reviews go."""
    return survivors(lineage.drop_of_chunks(t.tables(), t.chunks().where("chunk_id % 5 = 0").select("chunk_id")))


@query("h4_moved_documents", needs=["docs"], sql="""
    SELECT doc_id, CASE WHEN lang = 'de' THEN doc_id || '.text' ELSE filename END AS filename,
           CASE WHEN lang = 'de' THEN '/moved/' || doc_id || '.text' ELSE '/in/' || filename END AS source, lang AS backend FROM docs""")
def h4(t: Tables) -> DataFrame:
    docs = t.documents().withColumn("metadata", F.create_map(
        F.lit("source"), F.concat(F.lit("/in/"), "filename"), F.lit("backend"), F.col("lang")))
    name = F.concat("doc_id", F.lit(".text"))
    moves = t.documents().where("lang = 'de'").select(
        "doc_id", F.concat(F.lit("/moved/"), name).alias("path"), name.alias("filename")
    )
    return lineage.move_documents(docs, moves).select(
        "doc_id", "filename", F.col("metadata")["source"].alias("source"), F.col("metadata")["backend"].alias("backend")
    )


@query("h5_audit_trail", sql="""
    SELECT event_id, event_type, 'u' || user_id AS actor, json_extract_string(props, '$.k') AS k,
           (user_id * 1000000 + event_id % 40 + 1)::VARCHAR AS related FROM events""")
def h5(t: Tables) -> DataFrame:
    """Appended to the shared folder in two batches, and read back."""
    path = shared_folder(t.spark, "audit")
    events = t.audit()
    late = F.col("event_type").isin("error", "signup")
    audit.append_audit(events.where(~late), path)
    audit.append_audit(events.where(late), path)
    return t.spark.read.parquet(path).select(
        "event_id", "event_type", "actor", F.col("payload")["k"].alias("k"), joined(F.col("related_chunk_ids").cast("array<string>")).alias("related")
    )


@query("h6_newest_events", sql="""
    SELECT event_id, event_type, 'u' || user_id AS actor FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def h6(t: Tables) -> DataFrame:
    return audit.find_audit_events(t.audit()).select("event_id", "event_type", "actor")


@query("h6_newest_events_of_type", sql="""
    SELECT event_id, event_type, 'u' || user_id AS actor FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def h6_type(t: Tables) -> DataFrame:
    return audit.find_audit_events(t.audit(), event_type="error").select("event_id", "event_type", "actor")
