"""Chunking runs, chunk lookups and statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import lineage
from corpusloom.operators.positions import fresh_ids, number_rows

# A run id is the job number in the high bits and the document id below.
DOC_ID_BITS = 40


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each document, by run id."""
    return runs.groupBy("doc_id").agg(F.max("run_id").alias("run_id"))


def in_latest_run(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks of each document's newest run."""
    return chunks.join(latest_runs(runs).select("run_id"), "run_id", "left_semi")


def run_chunking(
    tables: Mapping[str, DataFrame],
    docs: DataFrame,
    new_chunks: DataFrame,
    *,
    strategy: str,
    params: Mapping[str, object],
    job_no: int,
    started_at=None,
) -> dict[str, DataFrame]:
    """C14: replace what hangs on the chunked documents by a new run.

    ``tables`` holds chunking_runs, chunks, labels and human_reviews; ``docs``
    the chunked documents; ``new_chunks`` a chunker's output for them. Options
    whose name starts with ``_`` are not recorded. ``job_no`` must grow from job
    to job: it orders the runs. Chunk ids follow the largest one in use. Returns the
    tables; vectors of replaced chunks are dropped where ``chunk_embeddings`` is given.
    """
    recorded = {k: str(v) for k, v in params.items() if not k.startswith("_")}
    pairs = [F.lit(x) for kv in sorted(recorded.items()) for x in kv]
    params_col = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
    run_id = F.lit(job_no << DOC_ID_BITS).bitwiseOR(F.col("doc_id")).alias("run_id")
    when = F.current_timestamp() if started_at is None else F.lit(started_at).cast("timestamp")

    counts = new_chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks"))
    runs = docs.select("doc_id").join(counts, "doc_id", "left").select(
        run_id, "doc_id", F.lit(strategy).alias("strategy"), params_col.alias("params"),
        when.alias("started_at"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )
    order = [c for c in ("w", "ord", "sub_ord") if c in new_chunks.columns]
    numbered = fresh_ids(
        new_chunks.drop("chunk_id"), ["doc_id", *order], tables["chunks"], "chunk_id", out="chunk_id")
    chunks = numbered.select(
        "chunk_id", "doc_id", run_id, "text", "char_start", "char_end", "section_path", "token_count",
        F.lit(None).cast("string").alias("chunk_type"), "boundary_confidence",
        F.lit(None).cast("map<string,string>").alias("manual_override"),
    )
    kept = lineage.drop_chunking(tables, docs.select("doc_id"))
    kept["chunking_runs"] = kept["chunking_runs"].unionByName(runs, allowMissingColumns=True)
    kept["chunks"] = kept["chunks"].unionByName(chunks, allowMissingColumns=True)
    return kept


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Size statistics per run; the median is exact.

    The median keeps one counter per distinct token count, not per chunk.
    """
    return chunks.groupBy("run_id").agg(
        F.count("*").alias("count"),
        F.round(F.avg("token_count"), 1).alias("mean"),
        F.median("token_count").alias("median"),
        F.min("token_count").alias("min"),
        F.max("token_count").alias("max"),
    )


def token_count_histogram(chunks: DataFrame) -> DataFrame:
    """The sorted list of token counts, as counts per value."""
    return chunks.groupBy("run_id", "token_count").agg(F.count("*").alias("n_chunks"))


def find_chunks(chunks: DataFrame, *, chunk_id: int | None = None, doc_id: int | None = None,
                run_id: int | None = None, ordered: bool = False) -> DataFrame:
    """Chunks by id, document or run; ``ordered`` sorts what was found by place."""
    for column, value in (("chunk_id", chunk_id), ("doc_id", doc_id), ("run_id", run_id)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    return chunks.orderBy("doc_id", "run_id", "char_start") if ordered else chunks


def delete_runs(runs: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C20: remove runs (``doomed.run_id``) and their chunks."""
    return (
        runs.join(doomed, "run_id", "left_anti"),
        chunks.join(doomed, "run_id", "left_anti"),
    )


def chunk_index(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Position within the run, clamped overlay span, one-line preview."""
    # The preview is cut before any shuffle, so the text itself never moves.
    preview = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 60)
    numbered = number_rows(
        chunks.select("chunk_id", "doc_id", "run_id", "char_start", "char_end", preview.alias("preview")),
        ["doc_id", "run_id"], "char_start", ties=["chunk_id"],
    )
    lengths = docs.select("doc_id", F.length("full_text").alias("_length"))
    return numbered.join(lengths, "doc_id").select(
        "doc_id", "run_id", "chunk_id", "ord", "char_start",
        F.least("char_end", "_length").alias("overlay_end"),
        "preview",
    )
