"""Positions, look-ahead and runs inside a key, safe for hot keys.

A window over a whole document would sort all its rows in one task. Here each
key is cut into blocks of the order column; windows run inside one block, and
only one summary row per block is ordered across the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 1 << 20


def _blocked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.expr(f"`{order}` div {width}"))


def _windows(keys: Sequence[str], order: str, ties: Sequence[str]):
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties)
    across = Window.partitionBy(*keys).orderBy("_block")
    return inside, across


def number_rows(df: DataFrame, keys: Sequence[str], order: str, *, ties: Sequence[str] = (),
                width: int = BLOCK_WIDTH, out: str = "ord") -> DataFrame:
    """1-based position of each row within its key, by ``order`` then ``ties``."""
    rows = _blocked(df, order, width)
    inside, across = _windows(keys, order, ties)
    before = (
        rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).select(
            *keys, "_block",
            F.coalesce(
                F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
        )
    )
    return (
        rows.withColumn("_local", F.row_number().over(inside))
        .join(before, [*keys, "_block"])
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_block", "_local", "_before")
    )


def next_match(df: DataFrame, keys: Sequence[str], order: str, matches: Column, value: str, *,
               width: int = BLOCK_WIDTH, out: str = "next") -> DataFrame:
    """``value`` of the closest later row of the key for which ``matches`` holds.

    Rows are ordered by ``order`` and then by ``value``.
    """
    hit = F.when(matches, F.struct(order, value))
    rows = _blocked(df, order, width).withColumn("_hit", hit)
    inside, across = _windows(keys, order, [value])
    later = (
        rows.groupBy(*keys, "_block").agg(F.min("_hit").alias("_first")).select(
            *keys, "_block",
            F.min("_first").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
        )
    )
    ahead = F.min("_hit").over(inside.rowsBetween(1, Window.unboundedFollowing))
    return (
        rows.withColumn("_ahead", ahead)
        .join(later, [*keys, "_block"])
        .withColumn(out, F.coalesce("_ahead", "_later")[value])
        .drop("_block", "_hit", "_ahead", "_later")
    )


def runs(df: DataFrame, keys: Sequence[str], order: str, status: str, *,
         ties: Sequence[str] = (), width: int = BLOCK_WIDTH) -> DataFrame:
    """Runs of equal ``status``: key, run number, status, bounds and row count."""
    rows = _blocked(df.select(*keys, order, *ties, status), order, width)
    inside, across = _windows(keys, order, ties)
    place = F.struct(order, *ties)
    to_here = across.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_prev", F.lag(status).over(inside)).withColumn(
        "_head", F.row_number().over(inside) == 1
    )
    # Changes inside a block, and its last status: all that crosses a block edge.
    edge = (
        local.groupBy(*keys, "_block").agg(
            F.count_if(~F.col("_head") & ~F.col("_prev").eqNullSafe(F.col(status))).alias("_n"),
            F.min_by(F.struct(F.col(status).alias("s")), place).alias("_first"),
            F.max_by(F.struct(F.col(status).alias("s")), place).alias("_last"),
        )
        .withColumn("_left", F.lag("_last").over(across))
        .withColumn(
            "_opens", (F.col("_left").isNull() | ~F.col("_left.s").eqNullSafe(F.col("_first.s"))).cast("int")
        )
        .select(
            *keys, "_block", "_opens",
            F.coalesce(F.sum(F.col("_n") + F.col("_opens")).over(to_here), F.lit(0)).alias("_before"),
        )
    )
    numbered = local.join(edge, [*keys, "_block"]).withColumn(
        "_change",
        F.when(F.col("_head"), F.col("_opens")).otherwise(
            (~F.col("_prev").eqNullSafe(F.col(status))).cast("int")
        ),
    ).withColumn(
        "run_no",
        F.col("_before")
        + F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    )
    return numbered.groupBy(*keys, "run_no", status).agg(
        F.min(order).alias("run_start"),
        F.max(order).alias("run_end"),
        F.count("*").alias("n_rows"),
    )


def dense_ids(df: DataFrame, hash_col: str, *, digits: int = 3, out: str = "n") -> DataFrame:
    """1-based numbers for rows with distinct hex digests, the same on every run.

    Digests spread evenly over their leading digits, so the buckets stay even;
    the only ordering across buckets is over 16 ** ``digits`` counts.
    """
    rows = df.withColumn("_bucket", F.substring(hash_col, 1, digits))
    offsets = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(hash_col))
    return (
        rows.withColumn("_local", local)
        .join(offsets, "_bucket")
        .withColumn(out, F.col("_local") + F.col("_before"))
        .drop("_bucket", "_local", "_before")
    )


def fresh_ids(df: DataFrame, keys: Sequence[str], existing: DataFrame | None, column: str, *,
              out: str) -> DataFrame:
    """Rows with an id in ``out`` that no row of ``existing`` has in ``column``.

    Ids follow the largest one in use, one for each row; ``keys`` tell rows apart.
    """
    digest = F.sha1(F.to_json(F.struct(*keys)).cast("binary"))
    numbered = dense_ids(df.withColumn("_digest", digest), "_digest", out="_dense")
    top = F.lit(0) if existing is None else F.coalesce(
        existing.agg(F.max(column)).scalar(), F.lit(0))
    return numbered.withColumn(out, (F.col("_dense") + F.greatest(top, F.lit(0))).cast("long")).drop("_digest", "_dense")
