"""Intermediate tables in the cluster's shared folder, and components of a link table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import shared_folder


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read again: later steps neither recompute nor lose it."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = kept(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    return _distinct(both.where("v > u").join(least, "u").select(
        F.col("v").alias("u"), F.least("u", "m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = kept(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(moved.union(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links → (node, component): the smallest node that each node reaches.

    Large-star and small-star steps alternate until the links no longer change,
    which takes about the logarithm of the longest path. The aggregated nodes are
    written before they are joined back: both sides of the join are then plain
    shuffles of written rows, so Spark can split a hub over several tasks.
    """
    edges = kept(_distinct(links.select(F.col(links.columns[0]).alias("u"),
                                        F.col(links.columns[1]).alias("v"))), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        if now[0] == 0:
            break
        edges = kept(_small_star(kept(_large_star(edges), "links")), "links")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


# Bits of an id filter: 8 MB, whatever the number of ids.
FILTER_BITS = 26


def maybe_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for every id of the one-column table ``ids``, and for few others.

    A bitmap of fixed size goes to the tasks; with very many ids it tells less and
    less apart, but never misses one. It spares joins the rows that cannot match.
    """
    import numpy as np

    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(1 << FILTER_BITS))
    bits = ids.select(place.alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def inside(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda key: inside(F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)))
