"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Test items are short and documents long, so their Jaccard similarity is tiny even
where an item is contained whole. Items are therefore partitioned by size, and a
document is searched for each partition in windows of twice the partition's upper
size, which overlap by half. Inside such a window an item that is contained has a
Jaccard similarity of at least 0.19, whatever the length of the document. Window
and item are sketched by the minimum of each of ``BINS`` bins of one hash; a pair
that agrees in any coordinate is a candidate. Items of few shingles are also looked up
by so many of their shingles that no document with enough of them has none. Then the share of the item's distinct
shingles that the whole document has is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept
from corpusloom.llm.words import (
    PUNCTUATION,
    U,
    column_bytes,
    constants,
    groups_of,
    hash_words,
    mix,
    windows,
)

SHINGLE = 5
PERCENT = 80
BINS = 96
SMALLEST = 8
# Items of so many shingles or fewer are found by their shingles, too.
FEW = 16
# Bits of the filter that tasks get: 8 MB whatever the number of items.
FILTER_BITS = 26
_NONE = U(2**64 - 1)


def shingle_sequence(h: np.ndarray, words: int) -> np.ndarray:
    """Shingle hashes in the order of the text; none if it is shorter than a shingle."""
    return windows(h, words, seed=40 + words)


def partition_of(n: int) -> int:
    """Upper size of the partition of items with ``n`` shingles: a power of two."""
    return max(SMALLEST, 1 << int(n - 1).bit_length())


def window_keys(sequence: np.ndarray, upper: int, bins: int = BINS) -> np.ndarray:
    """Coordinate keys of all windows of ``2 * upper`` shingles, one row a window.

    A coordinate that no shingle of the window falls into is ``_NONE``.
    """
    with np.errstate(over="ignore"):
        x = mix(sequence * constants(1, 21)[0])
    at = (((x >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
    half = np.arange(sequence.size) // upper
    mins = np.full((int(half[-1]) + 1) * bins, _NONE, U)
    np.minimum.at(mins, half * bins + at, x)
    mins = mins.reshape(-1, bins)
    both = np.minimum(mins[:-1], mins[1:]) if len(mins) > 1 else mins
    with np.errstate(over="ignore"):
        keys = mix(both * constants(1, 22)[0] + U(upper))
    return np.where(both == _NONE, _NONE, keys)


def in_filter(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values >> U(64 - FILTER_BITS)
    return (bitmap[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


ITEMS = "item_id long, n int, upper int, shingles array<long>, keys array<long>"


def sketched_items(benchmark: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row per distinct shingle set of the items, named by its smallest item id."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("item_id").to_pylist()
            out = []
            for part in groups_of(texts):
                found = hash_words([texts[i] for i in part], fold=True, separators=PUNCTUATION)
                for i, row in enumerate(part):
                    s = np.unique(shingle_sequence(found.of(i), words))
                    if s.size and ids[row] is not None:
                        upper = partition_of(s.size)
                        # The set lies in one half, so its windows are that half.
                        keys = window_keys(s, upper)[0]
                        out.append((ids[row], s.size, upper, s.view(np.int64),
                                    keys[keys != _NONE].view(np.int64)))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["item_id", "n", "upper", "shingles", "keys"])

    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, ITEMS)
    return rows.groupBy("shingles").agg(
        F.min("item_id").alias("item_id"), F.first("n").alias("n"), F.first("upper").alias("upper"),
        F.first("keys").alias("keys"))


def with_direct_keys(items: DataFrame, percent: int) -> DataFrame:
    """``direct``: shingles of a small item of which every document that contains it has one."""
    enough = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    return items.withColumn("direct", F.when(
        F.col("n") <= FEW, F.slice("shingles", 1, F.col("n") - enough + 1)).otherwise(
        F.array().cast("array<long>")))


def filter_of(items: DataFrame, *columns: str) -> np.ndarray:
    """A bitmap of all values of some array columns, of fixed size."""
    value = F.explode(F.concat(*columns)).alias("v")
    bit = F.shiftrightunsigned("v", 64 - FILTER_BITS)
    words = items.select(value).select(
        F.shiftright(bit, 6).alias("word"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(v, {64 - FILTER_BITS}) & 63 as int))").alias("bits"),
    ).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.view(U)


FOUND = "doc_id long, keys array<long>, hits array<long>"


def searched_documents(docs: DataFrame, bitmap: np.ndarray, direct: np.ndarray, uppers: list[int],
                       words: int = SHINGLE) -> DataFrame:
    """Documents with a coordinate in the filter, or a shingle in the filter of direct keys:
    those keys, and all shingles in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    few = docs.sparkSession.sparkContext.broadcast(direct)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id").to_pylist()
            out = []
            for part in groups_of(texts):
                found = hash_words([texts[i] for i in part], fold=True, separators=PUNCTUATION)
                for i, row in enumerate(part):
                    s = shingle_sequence(found.of(i), words)
                    inside = in_filter(shared.value, s)
                    if not inside.any():
                        continue
                    keys = np.unique(np.concatenate([window_keys(s, u).ravel() for u in uppers]))
                    keys = keys[in_filter(shared.value, keys) & (keys != _NONE)]
                    keys = np.union1d(keys, s[in_filter(few.value, s)])
                    if keys.size:
                        out.append((ids[row], keys.view(np.int64),
                                    np.unique(s[inside]).view(np.int64)))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "keys", "hits"])

    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, FOUND)


LEAKS = "doc_id long, item_id long, item_shingles int, shared int, containment double"


def contained_items(docs: DataFrame, benchmark: DataFrame, words: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared, containment) with 100 * shared >= percent * size.

    Words are runs of letters and digits, A-Z lower-cased. Items of equal shingle
    sets are one, named by the smallest id; ``item_classes`` lists the others. Items
    shorter than a shingle and null or empty texts are contained nowhere and
    contain nothing. Rows that repeat a doc_id count as one document, with the best
    of them; a null doc_id is one id. An empty table gives no pairs.
    """
    items = kept(with_direct_keys(sketched_items(benchmark, words), percent), "items")
    # At most one partition for each power of two.
    uppers = sorted(r[0] for r in items.select("upper").distinct().collect())
    if not uppers:
        return docs.sparkSession.createDataFrame([], LEAKS)
    found = kept(searched_documents(docs, filter_of(items, "shingles", "keys"), filter_of(items, "direct"),
                                    uppers, words), "searched")
    by_key = items.select("item_id", F.explode(F.concat("keys", "direct")).alias("key"))
    candidates = found.select("doc_id", F.explode("keys").alias("key")).join(by_key, "key").select(
        F.col("doc_id").alias("d"), "item_id").distinct()
    verified = candidates.join(found.select("doc_id", "hits"), F.col("d").eqNullSafe(F.col("doc_id"))).join(
        items.select("item_id", "n", "shingles"), "item_id").select(
        "doc_id", "item_id", F.col("n").alias("item_shingles"),
        F.size(F.array_intersect("shingles", "hits")).alias("shared"))
    return verified.groupBy("doc_id", "item_id", "item_shingles").agg(
        F.max("shared").alias("shared")).where(
        F.col("shared") * 100 >= F.col("item_shingles") * percent).withColumn(
        "containment", F.col("shared") / F.col("item_shingles"))


def item_classes(benchmark: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(item_id, class_id) of the items that are long enough to be searched for."""
    sets = sketched_items(benchmark, words).select(F.col("item_id").alias("class_id"), "shingles")
    each = benchmark.select("item_id", "text")
    members = each.mapInArrow(_members(words), "item_id long, shingles array<long>")
    return members.join(sets, "shingles").select("item_id", "class_id")


def _members(words: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = hash_words(column_bytes(batch, "text"), fold=True, separators=PUNCTUATION)
            sets = [np.unique(shingle_sequence(found.of(i), words)).view(np.int64)
                    for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(sets, pa.list_(pa.int64()))],
                names=["item_id", "shingles"])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, words: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that contain a test item; columns stay as they are."""
    dirty = contained_items(docs, benchmark, words, percent).select(
        F.col("doc_id").alias("dirty_id")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["dirty_id"]), "left_anti")
