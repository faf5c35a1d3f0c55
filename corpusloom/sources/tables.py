"""Table persistence and export files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import table_schema

# Rows of a document land in one bucket folder, so a job on some documents
# rewrites only their buckets.
DEFAULT_BUCKETS = 256


def doc_bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a project table, in order and type; missing ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(table)
        ]
    )


def append_table(df: DataFrame, path: str, table: str, *, buckets: int = DEFAULT_BUCKETS) -> None:
    """A10: append rows. Tables keyed by document are partitioned by bucket.

    All writes to one path must use the same number of buckets.
    """
    rows = conform(df, table)
    if "doc_id" in rows.columns:
        _bucketed(rows, buckets).write.mode("append").partitionBy("bucket").parquet(path)
    else:
        rows.write.mode("append").parquet(path)


def replace_buckets(df: DataFrame, path: str, table: str, *, buckets: int = DEFAULT_BUCKETS) -> None:
    """A10: replace exactly the buckets that occur in ``df``.

    ``df`` must not read from ``path``: a job that dies between deleting and
    writing would lose its own input.
    """
    _bucketed(conform(df, table), buckets).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows beside their bucket. The rebalance hint groups them into few files
    per bucket, and splits a bucket that one document makes too large."""
    return rows.withColumn("bucket", doc_bucket(buckets)).hint("rebalance", F.col("bucket"))


def read_table(spark: SparkSession, path: str, table: str, *,
               only: Sequence[int] | None = None) -> DataFrame:
    """A10: a project table with its schema; the bucket column stays out.

    ``only`` reads just these buckets; the others are pruned, not filtered.
    """
    rows = spark.read.schema(table_schema(table)).parquet(path)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(list(only)))
    return rows.select(table_schema(table).fieldNames())


def touched_buckets(doc_ids: DataFrame, *, buckets: int = DEFAULT_BUCKETS) -> list[int]:
    """The buckets of some documents, at most ``buckets`` numbers.

    A job that changes few documents reads and replaces these alone.
    """
    return sorted(r.b for r in doc_ids.select(doc_bucket(buckets).alias("b")).distinct().collect())


def write_corpus_json(records: DataFrame, manifest: DataFrame, rubric: DataFrame, path: str) -> None:
    """The labeled corpus: JSON lines of records, manifest and rubric beside them."""
    records.write.mode("errorifexists").json(f"{path}/chunks")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    rubric.coalesce(1).write.mode("errorifexists").json(f"{path}/rubric")


def write_sidecar(rows: DataFrame, path: str, about: Mapping[str, object] | None = None) -> None:
    """The embedding sidecar: snappy Parquet, float32 vectors.

    ``about`` (such as dimension, models and project) goes into the files: it is
    the metadata of the vector column in the schema that Spark stores in them.
    """
    if about:
        rows = rows.withColumn("embedding", F.col("embedding").alias("embedding", metadata=dict(about)))
    rows.write.mode("errorifexists").option("compression", "snappy").parquet(path)
