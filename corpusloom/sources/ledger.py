"""The ledger of files: which contents a path held when it was last opened.

A listing tells path, length and time of change without opening anything. A file
whose three values are those in the ledger still has the hash in the ledger. So a
job opens new and changed files only, and only those it wants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "path string, length bigint, modified_at timestamp, source_hash string"
STATE = ["path", "length", "modified_at"]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def with_known_hashes(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """``path, length, modified_at, source_hash`` of listed files; without a hash it must be opened.

    Of several entries for a path the one changed last counts. Hashes are joined
    on the path alone, with one entry for each, so no path is a hot key.
    """
    last = ledger.groupBy("path").agg(
        F.max(F.struct("modified_at", "length", "source_hash")).alias("_last"))
    same = (F.col("length") == F.col("_last.length")) & (F.col("modified_at") == F.col("_last.modified_at"))
    return listing.select(*STATE).join(last, "path", "left").select(
        *STATE, F.when(same, F.col("_last.source_hash")).alias("source_hash"))


def ledger_after(ledger: DataFrame, listed: DataFrame, opened: DataFrame) -> DataFrame:
    """The ledger with what was ``opened(path, source_hash)``; files that could not be read stay out.

    ``listed`` has the lengths and times under which they were opened.
    """
    fresh = listed.select(*STATE).join(
        opened.where(F.col("source_hash").isNotNull()).select("path", "source_hash"), "path")
    return ledger.join(opened.select("path"), "path", "left_anti").select(fresh.columns).unionByName(fresh)
