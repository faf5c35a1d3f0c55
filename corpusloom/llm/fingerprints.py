"""Document fingerprints: bottom-k sketches of word-shingle hashes, as SQL expressions.

A sketch is the ascending array of the ``k`` smallest distinct shingle hashes. The
sketch of a union is the ``k`` smallest of both (``merged``), so parts of a document
or of a corpus are sketched apart. A text with fewer than ``k`` shingles is
sketched exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let, let_all

K = 128
SHINGLE = 5
# Words without blanks inside; longer ones count as pieces, so that an edit inside
# a text without blanks leaves the rest of it alike.
PIECE = r"[^ \t-\r]{1,8}"


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """One hash for each word: of it and the ``words - 1`` words before it.

    The first words of a text have shorter shingles, so that texts of a word or
    two have a sketch, too.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.transform(h, lambda x, i: F.xxhash64(
        *[F.get(h, i - back) for back in range(words - 1, 0, -1)], x)))


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    """array<long>; empty for a text without words and for null."""
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` sketch."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; of two empty sketches 1, of one 0."""

    def of(x: Column, y: Column) -> Column:
        return let(merged(x, y, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(
            F.size(F.array_intersect(F.array_intersect(u, x), y)) / F.size(u)))

    return let_all([a, b], of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 0 for an empty ``a``."""
    union = distinct_shingles(merged(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.least(F.lit(1.0), share))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, key: str, values: list[str], blocks: int) -> DataFrame:
    """Adds ``next_<value>`` of the row that follows in ascending ``key``; the first follows the last.

    Rows are cut into about ``blocks`` ranges of the key, each sorted in a window of its own.
    The first rows of a range are sent to the range before it, too, where they
    only serve as the follower of its last row. Null keys come last; repeated
    keys follow each other in the order of ``values``.
    """
    order = F.coalesce(F.col(key).cast("double"), F.lit(float("inf")))
    at = [i / blocks for i in range(blocks)]
    ranked = docs.select(order.alias("order"))
    bounds = sorted(set(ranked.approxQuantile("order", at, 1 / (4 * blocks)))) or [0.0]
    starts = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    # Binary search for the last start that is not above the row.
    block = F.aggregate(steps, F.lit(0), lambda p, s: F.when(
        F.get(starts, p + s - 1) <= F.col("order"), p + s).otherwise(p))
    n = len(bounds)
    first = F.get(starts, F.col("block") - 1) == F.col("order")
    before = F.when(F.col("block") == 1, n).otherwise(F.col("block") - 1)
    lead_in = F.struct(before.alias("block"), (F.col("block") == 1).cast("int").alias("late"),
                       F.lit(True).alias("guest"))
    own = F.struct("block", F.lit(0).alias("late"), F.lit(False).alias("guest"))
    placed = (docs.withColumn("order", order).withColumn("block", F.greatest(block, F.lit(1)))
              .withColumn("to", F.explode(F.when(first, F.array(own, lead_in)).otherwise(F.array(own))))
              .drop("block").select("*", "to.*").drop("to"))
    following = Window.partitionBy("block").orderBy("late", "order", "guest", key, *values)
    led = placed.select("*", *[F.lead(v).over(following).alias(f"next_{v}") for v in values])
    return led.where(~F.col("guest")).drop("order", "block", "late", "guest")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last quarter replaced by the start of ``following``."""
    tail = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - tail),
                    F.substring(following, F.lit(1), tail))


def fingerprinted_documents(docs: DataFrame, k: int = K, blocks: int | None = None) -> DataFrame:
    """Documents → sketches of their texts, of their edited texts, and likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles (estimated distinct ones) and kept_share
    (containment of the text in its edited form). Null texts count as empty; an
    empty text has an empty fingerprint and resembles only other empty ones.
    """
    spark = docs.sparkSession
    blocks = blocks or min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = base.withColumn("sketch", sketch(F.col("text"), k))
    edited = with_next(sketched, "doc_id", ["text", "sketch"], blocks).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "sketch", "next_sketch",
        edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    twice = edited.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return twice.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_share"))
