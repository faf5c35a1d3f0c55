"""Scans of texts too long for one task: blocks, sentences and windows.

A text is cut into blocks between two characters that are not white space. Breaks of
sentences and paragraphs are white space, so a cut divides no break: each block finds
its own breaks, whatever stands beside it. What a block cannot know comes as a few
numbers from the others:

* The segment of text that a cut runs through has one number on both sides, the
  count of breaks before it. Its pieces are put together by that number.
* Counts and lengths before a block are running sums over one row for each block.
* A greedy packing needs only the sizes of the paragraphs, in one row of integers.

So tasks share the text of one document, and only pieces at cuts are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.functions.text import WHITESPACE, WS, TokenCounter, estimate_counts
from corpusloom.operators.structural_chunks import PARAGRAPH_BREAK, pack_starts
from corpusloom.shipping import ship_package

# Characters of a block. Longer texts are spread.
BLOCK_CHARS = 1 << 20
INNER = re.compile(f"[^{WS[1:]}[^{WS[1:]}")


def cut_places(text: str, size: int) -> list[int]:
    """Starts of blocks of about ``size`` characters; none lies beside white space."""
    starts = [0]
    while len(text) - starts[-1] > size:
        hit = INNER.search(text, starts[-1] + size - 1)
        if hit is None:
            break
        starts.append(hit.start() + 1)
    return starts


def blocks(docs: DataFrame, text_col: str = "full_text", size: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, block, text``, dealt over tasks by block. A null text has no block, an empty one has one."""
    ship_package(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                starts = cut_places(text, size)
                for a in range(0, len(starts), 8):
                    own = range(a, min(a + 8, len(starts)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(own), pa.int64()), pa.array(own, pa.int32()),
                         pa.array([text[starts[b]:starts[b + 1] if b + 1 < len(starts) else None] for b in own])],
                        names=["doc_id", "block", "text"])

    # An explicit number: blocks of one text are few bytes, which the planner would put in one task.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.col("doc_id").cast("long"), text_col).where(F.col(text_col).isNotNull()).mapInArrow(
        run, "doc_id long, block int, text string").repartition(tasks, "doc_id", "block")


PIECES = "doc_id long, block int, i int, last boolean, at int, text string, gap int"


def pieces(cut: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, block, i, last, at, text, gap``: the texts between the matches of ``pattern`` in each block.

    ``i`` counts the matches before it in the block, ``at`` is its place there,
    ``gap`` the length of the match behind it. The last piece of a block goes on in
    the next one, where it is piece 0, unless the text ends.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        finder = re.compile(pattern)
        for batch in batches:
            for doc_id, block, text in zip(*(c.to_pylist() for c in batch.columns)):
                gaps = [m.span() for m in finder.finditer(text)]
                starts, ends = [0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([block] * n, pa.int32()),
                     pa.array(range(n), pa.int32()), pa.array([i == n - 1 for i in range(n)]),
                     pa.array(starts, pa.int32()), pa.array([text[a:b] for a, b in zip(starts, ends)]),
                     pa.array([*(b - a for a, b in gaps), 0], pa.int32())],
                    names=[f.split()[0] for f in PIECES.split(", ")])

    return cut.select("doc_id", "block", "text").mapInArrow(run, PIECES)


def segments(cut: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, seg, block, char_start, text, gap``: texts between the matches in whole documents, numbered from 0.

    ``block`` is the one where a segment begins, ``gap`` the length of the match behind it.
    """
    found = pieces(cut, pattern)
    sizes = cut.select("doc_id", "block", F.char_length("text").alias("n"),
                       F.regexp_count("text", F.lit(pattern)).alias("gaps"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("doc_id", "block", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "gaps")])
    numbered = found.join(placed, ["doc_id", "block"]).select(
        "doc_id", (F.col("gaps_before") + F.col("i")).alias("seg"), "block",
        (F.col("n_before") + F.col("at")).alias("char_start"), "text", "gap",
        ((F.col("i") == 0) | F.col("last")).alias("edge"))
    inner = numbered.where(~F.col("edge")).drop("edge")
    joined = numbered.where("edge").groupBy("doc_id", "seg").agg(
        F.min("block").alias("block"), F.min("char_start").alias("char_start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"),
        F.max("gap").alias("gap"))
    return inner.unionByName(joined)


def ordinals(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``ord``, the place from 1 in the document, by ``order``, which follows the blocks.

    Places within a block, and counts before a block: no window holds a whole document's rows.
    """
    here = Window.partitionBy("doc_id", "block").orderBy(order)
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_here", F.row_number().over(here)).join(counts, ["doc_id", "block"]).withColumn(
        "ord", (F.col("_before") + F.col("_here")).cast("int")).drop("_before", "_here")


def sentences(docs: DataFrame, pattern: str, text_col: str = "full_text", size: int = BLOCK_CHARS) -> DataFrame:
    """C5 over spread texts: ``doc_id, ord, char_start, char_end, text``, blank segments left out."""
    found = segments(blocks(docs, text_col, size), pattern)
    rows = found.where(F.btrim("text", F.lit(WHITESPACE)) != "")
    return ordinals(rows, "seg").select(
        "doc_id", "ord", F.col("char_start").cast("int").alias("char_start"),
        (F.col("char_start") + F.char_length("text")).cast("int").alias("char_end"), "text")


def windows(docs: DataFrame, *, max_window_tokens: int = 3000, counter: TokenCounter = estimate_counts,
            keep: Sequence[str] = (), size: int = BLOCK_CHARS) -> DataFrame:
    """C9 over spread texts: ``doc_id, w, char_start, char_end, text``, windows of whole paragraphs.

    Paragraphs are counted where their blocks are; the packing runs over their
    counts, one row of integers a document; a window is put together from its
    paragraphs, of which it holds few unless one alone is over the limit.
    """
    src = docs.where(F.col("full_text").isNotNull() & (F.btrim("full_text", F.lit(WHITESPACE)) != ""))
    paras = segments(blocks(src, "full_text", size), PARAGRAPH_BREAK).withColumn(
        "tokens", F.get(counter(F.array("text")), F.lit(0)))
    whole = src.select("doc_id", *keep, (F.get(counter(F.array("full_text")), F.lit(0)) <= max_window_tokens).alias("_fits"))
    counted = paras.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seg", "tokens"))), lambda p: p["tokens"]).alias("_sizes"))
    starts = counted.join(whole, "doc_id").select("doc_id", F.when(F.col("_fits"), F.array(F.lit(0))).otherwise(
        pack_starts(F.col("_sizes"), max_window_tokens)).alias("_starts"), F.size("_sizes").alias("_n"))
    opened = starts.select("doc_id", "_n", F.posexplode(arrays.rows_of(F.transform(
        "_starts", lambda s, i: F.struct(s.alias("a"), F.coalesce(F.get("_starts", i + 1), F.col("_n")).alias("b"))))).alias("w", "r"))
    owner = opened.select("doc_id", "w", F.explode(F.sequence("r.a", F.col("r.b") - 1)).alias("seg"))
    joined = paras.join(owner, ["doc_id", "seg"]).groupBy("doc_id", "w").agg(
        F.min("char_start").alias("char_start"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seg", "text", "gap"))),
            lambda p: F.concat(p["text"], F.when(p["gap"] > 0, F.lit(PARAGRAPH_BREAK)).otherwise(F.lit("")))), "").alias("text"))
    return joined.join(whole.drop("_fits"), "doc_id").select(
        "doc_id", *keep, "w", F.col("char_start").cast("int").alias("char_start"),
        (F.col("char_start") + F.char_length("text")).cast("int").alias("char_end"), "text")
