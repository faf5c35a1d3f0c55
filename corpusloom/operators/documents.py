"""Document identity, lookups and ingest reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.positions import dense_ids


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """A5: each requested path once."""
    return paths.dropDuplicates(["path"])


def identify_documents(existing: DataFrame, files: DataFrame) -> DataFrame:
    """B1, B2: what each distinct content among ``files(path, source_hash)`` means.

    Files count in path order: the first copy of a content would be converted,
    the last one gives the recorded path. A known hash keeps its row
    (``unchanged``, or ``moved`` if the path differs). An unknown one goes to
    the row of the same file name if that has no hash yet (``backfilled``),
    else it is a new row (``inserted``) with a dense id above those in use.

    Copies are folded by aggregation before any join, so a content held by very
    many paths costs one row per task. Only paths and hashes move here; texts
    are converted afterwards, for the inserted rows alone.
    """
    contents = files.groupBy("source_hash").agg(
        F.min("path").alias("first_path"), F.max("path").alias("path")
    ).withColumn("filename", basename(F.col("path")))
    has_hash = F.coalesce(F.col("source_hash"), F.lit("")) != ""
    known = existing.where(has_hash).groupBy("source_hash").agg(
        F.min_by(
            F.struct("doc_id", F.col("filename").alias("name"), F.col("metadata")["source"].alias("path")),
            "doc_id",
        ).alias("known")
    )
    matched = contents.join(known, "source_hash", "left")
    # The file-name rule looks at the oldest row of a name, and only if that row
    # has no hash. It takes one hash: the one whose first path sorts lowest.
    legacy = (
        existing.groupBy("filename")
        .agg(F.min_by(F.struct("doc_id", has_hash.alias("hashed")), "doc_id").alias("oldest"))
        .where(~F.col("oldest.hashed"))
        .select(F.col("filename").alias("first_name"), F.col("oldest.doc_id").alias("legacy_id"))
    )
    claims = (
        matched.where(F.col("known").isNull())
        .groupBy(basename(F.col("first_path")).alias("first_name"))
        .agg(F.min_by("source_hash", "first_path").alias("source_hash"))
        .join(legacy, "first_name")
        .select("source_hash", "legacy_id")
    )
    same_place = F.col("known.path").eqNullSafe(F.col("path")) & F.col("known.name").eqNullSafe(
        F.col("filename")
    )
    action = (
        F.when(F.col("known").isNotNull(), F.when(same_place, "unchanged").otherwise("moved"))
        .when(F.col("legacy_id").isNotNull(), "backfilled")
        .otherwise("inserted")
    )
    judged = matched.join(claims, "source_hash", "left").select(
        "source_hash", "first_path", "path", "filename",
        action.alias("action"),
        F.coalesce("known.doc_id", "legacy_id").alias("doc_id"),
    )
    is_new = F.col("action") == "inserted"
    top = existing.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).scalar()
    fresh = dense_ids(judged.where(is_new), "source_hash").withColumn("doc_id", top + F.col("n"))
    return judged.where(~is_new).unionByName(fresh.drop("n"))


def upsert_documents(existing: DataFrame, outcome: DataFrame, conversions: DataFrame) -> DataFrame:
    """B1, B2: the documents table after ``identify_documents``.

    ``conversions`` has ``path`` and converted columns; only the first path of
    each inserted content is read from it.
    """
    updates = outcome.where("action in ('moved', 'backfilled')").select(
        "doc_id",
        F.col("source_hash").alias("_hash"),
        # A backfilled row moves only if a second copy came after the first.
        F.when(
            (F.col("action") == "moved") | (F.col("path") != F.col("first_path")),
            F.struct("path", "filename"),
        ).alias("_to"),
    )
    no_meta = F.create_map().cast("map<string,string>")
    located = F.map_concat(
        F.map_filter(F.coalesce("metadata", no_meta), lambda k, _: k != "source"),
        F.create_map(F.lit("source"), F.col("_to.path")),
    )
    moves = F.col("_to").isNotNull()
    kept = (
        existing.join(updates, "doc_id", "left")
        .withColumn("metadata", F.when(moves, located).otherwise(F.col("metadata")))
        .withColumn("filename", F.when(moves, F.col("_to.filename")).otherwise(F.col("filename")))
        .withColumn("source_hash", F.coalesce("_hash", "source_hash"))
        .select(existing.columns)
    )
    content = [
        c for c in conversions.columns
        if c in existing.columns and c not in ("doc_id", "filename", "source_hash", "metadata")
    ]
    new = outcome.where("action = 'inserted'").select(
        "doc_id", "filename", "source_hash", "first_path",
        F.create_map(F.lit("source"), F.col("path")).alias("metadata"),
    )
    inserted = new.join(
        conversions.select(F.col("path").alias("first_path"), *content), "first_path"
    ).drop("first_path")
    return kept.unionByName(inserted, allowMissingColumns=True)


def failed_stubs(failures: DataFrame, existing: DataFrame) -> DataFrame:
    """Stub rows for ``failures(path, error)``, none where the name is known.

    Two failing files of one name in a batch give one stub: the first by path.
    """
    stubs = failures.groupBy(basename(F.col("path")).alias("filename")).agg(
        F.min_by(F.struct("path", "error"), "path").alias("f")
    )
    fresh = stubs.join(existing.select("filename"), "filename", "left_anti")
    return fresh.select(
        "filename",
        F.lower(F.regexp_extract("filename", r"(?s).\.([^.]+)\z", 1)).alias("format"),
        F.lit("failed").alias("status"),
        F.array("f.error").alias("warnings"),
        F.create_map(F.lit("source"), F.col("f.path")).alias("metadata"),
    )


def document_info(docs: DataFrame) -> DataFrame:
    """One info row per document.

    Needs ``headings, pages, warnings`` arrays and ``metadata`` with optional
    ``backend`` and JSON lists ``tables`` and ``figures``.
    """
    items = lambda key: F.coalesce(F.json_array_length(F.col("metadata")[key]), F.lit(0))
    return docs.select(
        "doc_id",
        "filename",
        F.length("full_text").alias("n_chars"),
        F.size("headings").alias("n_headings"),
        F.size("pages").alias("n_pages"),
        "format",
        F.coalesce(F.col("metadata")["backend"], F.lit("default")).alias("backend"),
        items("tables").alias("n_tables"),
        items("figures").alias("n_figures"),
        F.size("warnings").alias("n_warnings"),
    )


def ingest_counts(docs: DataFrame) -> DataFrame:
    """How many documents loaded and how many failed."""
    return docs.agg(
        F.count_if(F.col("status") != "failed").alias("n_ok"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def find_documents(docs: DataFrame, *, doc_id: int | None = None, ordered: bool = False) -> DataFrame:
    """One document, or all in order of ingest (``ingested_at``, then id)."""
    if doc_id is not None:
        return docs.where(F.col("doc_id") == doc_id)
    order = [c for c in ("ingested_at", "doc_id") if c in docs.columns]
    return docs.orderBy(*order) if ordered else docs


def first_by(docs: DataFrame, key: str) -> DataFrame:
    """For each file name or hash, the document that came first."""
    return docs.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_documents")
    )
