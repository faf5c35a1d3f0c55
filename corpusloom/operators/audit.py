"""Audit trail (H5, H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The event types the tool itself writes.


def audit_rows(events: DataFrame) -> DataFrame:
    """H5: complete event rows from ``event_id, event_type`` and optional columns."""
    defaults = {
        "actor": F.lit("system"),
        "ts": F.current_timestamp(),
        "payload": F.create_map().cast("map<string,string>"),
        "related_chunk_ids": F.array().cast("array<bigint>"),
    }
    columns = [
        (F.coalesce(F.col(c), d) if c in events.columns else d).alias(c)
        for c, d in defaults.items()
    ]
    return events.select("event_id", "event_type", *columns)


def append_audit(events: DataFrame, path: str) -> None:
    """H5: append to the audit table, partitioned by day."""
    audit_rows(events).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def find_audit_events(events: DataFrame, *, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """H6: the newest events, of one type or of all; a top-k per task."""
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)
