"""Folder or doc map → documents table."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import documents
from corpusloom.session import written
from corpusloom.sources import docmap, files
from corpusloom.sources import ledger as ledgers

# Bytes of files that one task opens, and the least number of tasks.
TASK_BYTES, TASKS = 64 << 20, 8


class Ingest(NamedTuple):
    documents: DataFrame  # the table after the batch, failed stubs included
    outcome: DataFrame    # what became of each distinct content
    failures: DataFrame   # path, error
    ledger: DataFrame     # path, length, modified_at, source_hash for the next batch


def requested_files(spark: SparkSession, folder: str, doc_map: str | None = None) -> DataFrame:
    """Files to ingest: all supported ones below a folder, or a doc map's choice of them."""
    listing = files.supported_files(files.list_folder(spark, folder))
    if doc_map is None:
        return listing
    rules = docmap.load_doc_map(spark, doc_map)
    return listing.join(docmap.resolve_doc_map(listing, rules, ordered=False), "path", "left_semi")


def ingest(spark: SparkSession, existing: DataFrame, folder: str, *, doc_map: str | None = None,
           ledger: DataFrame | None = None, opener: Callable[[str], bytes] = files.open_path) -> Ingest:
    """Bring the files below ``folder`` into the documents table.

    Only wanted files are opened, and of those only the ones that are new or have
    changed since the ``ledger`` of the last batch. Opening, hashing and decoding
    are one pass, whose rows are written, good and rejected ones apart; identity
    is decided on paths and hashes; the texts of new contents come from the
    written rows. So each file is opened once, a retry included. A content the
    ledger knows but the table no longer has is opened, too.
    """
    ledger = ledgers.empty_ledger(spark) if ledger is None else ledger
    listed = written(ledgers.with_known_hashes(requested_files(spark, folder, doc_map), ledger), "listing")
    unknown = listed.where("source_hash is null")
    opened = _opened(unknown, opener)
    hashes = listed.where("source_hash is not null").select("path", "source_hash").unionByName(
        opened.where("source_hash is not null").select("path", "source_hash"))
    outcome = written(documents.identify_documents(existing, hashes), "identity")

    fresh = outcome.where("action = 'inserted'").select(F.col("first_path").alias("path"))
    gone = listed.join(fresh, "path", "left_semi").where("source_hash is not null")
    content = opened.unionByName(_opened(gone, opener))
    converted = files.structured_files(content.join(fresh, "path", "left_semi"))
    # A file that could not be read has no content to stand for it: no stub, tried again next time.
    rejects = converted.rejects.unionByName(content.where("source_hash is null").select("path", "error"))
    table = documents.upsert_documents(existing, outcome, converted.documents)
    stubs = documents.failed_stubs(converted.rejects, existing)
    # A stub keeps the id its content was given.
    ids = outcome.where("action = 'inserted'").select("doc_id", F.col("first_path").alias("_path"))
    numbered = stubs.withColumn("_path", F.col("metadata")["source"]).join(ids, "_path").drop("_path")
    return Ingest(
        table.unionByName(numbered, allowMissingColumns=True), outcome, rejects,
        ledgers.ledger_after(ledger, listed, content),
    )


def _opened(wanted: DataFrame, opener: Callable[[str], bytes]) -> DataFrame:
    """``judged_files`` of the listed files, written with the rejected ones in a folder of their own."""
    size = wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spread = wanted.repartition(max(TASKS, -(-size // TASK_BYTES)), "path")
    judged = files.judged_files(files.open_files(spread, opener))
    return written(judged.withColumn("rejected", F.col("error").isNotNull()), "opened", partition_by="rejected")
