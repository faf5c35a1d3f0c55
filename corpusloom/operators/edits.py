"""Manual chunk edits as edit tables: merge and split.

Labels and vectors of a chunk whose text changed no longer describe it; pass the
touched ids of an edit to ``lineage.drop_of_chunks``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions.text import TokenCounter, estimate_counts
from corpusloom.operators.positions import fresh_ids
from corpusloom.session import written


class EditResult(NamedTuple):
    chunks: DataFrame    # the table after the edits
    touched: DataFrame   # chunk_id of every changed or removed chunk
    rejects: DataFrame   # edits not carried out, with a reason


def _override(*pairs: tuple[str, Column]) -> Column:
    flat = [x for k, v in pairs for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*flat)


def merge_chunks(chunks: DataFrame, edits: DataFrame, *,
                 counter: TokenCounter = estimate_counts) -> EditResult:
    """``edits(chunk_id_a, chunk_id_b)``: join two chunks of one document.

    The chunk that starts first survives and the other is removed. A chunk may
    take part in one edit per job: edits that share a chunk are all rejected, as
    their outcome would depend on their order.
    """
    side = lambda s: chunks.select(
        F.col("chunk_id").alias(f"chunk_id_{s}"),
        F.struct("chunk_id", "doc_id", "text", "char_start", "char_end").alias(s),
    )
    paired = edits.select("chunk_id_a", "chunk_id_b").join(side("a"), "chunk_id_a", "left").join(
        side("b"), "chunk_id_b", "left"
    )
    alone = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "chunk not found")
        .when(F.col("chunk_id_a") == F.col("chunk_id_b"), "chunk merged with itself")
        .when(F.col("a.doc_id") != F.col("b.doc_id"), "chunks from different documents")
    )
    possible = paired.withColumn("alone", alone)
    used = possible.where("alone is null").select(
        F.explode(F.array("chunk_id_a", "chunk_id_b")).alias("id")
    ).groupBy("id").agg(F.count("*").alias("uses")).where("uses > 1").select("id")
    shared = lambda s: used.select(F.col("id").alias(f"chunk_id_{s}"), F.lit(True).alias(f"again_{s}"))
    judged = possible.join(shared("a"), "chunk_id_a", "left").join(
        shared("b"), "chunk_id_b", "left"
    ).withColumn("reason", F.coalesce(
        "alone", F.when(F.col("again_a") | F.col("again_b"), "chunk in several edits")))
    in_order = F.col("a.char_start") <= F.col("b.char_start")
    body = F.concat(F.col("x.text"), F.lit("\n\n"), F.col("y.text"))
    merged = (
        judged.where("reason is null")
        .select(
            F.when(in_order, F.col("a")).otherwise(F.col("b")).alias("x"),
            F.when(in_order, F.col("b")).otherwise(F.col("a")).alias("y"),
        )
        .select(
            F.col("x.chunk_id").alias("chunk_id"),
            F.col("y.chunk_id").alias("_gone"),
            body.alias("_text"),
            F.col("y.char_end").alias("_end"),
        )
    )
    survivors = merged.select(
        "chunk_id", "_text", "_end",
        _override(("action", F.lit("merge")), ("merged_chunk_id", F.col("_gone"))).alias("_how"),
    )
    kept = chunks.join(merged.select(F.col("_gone").alias("chunk_id")), "chunk_id", "left_anti")
    hit = F.col("_how").isNotNull()
    edited = (
        kept.join(survivors, "chunk_id", "left")
        .withColumn("text", F.coalesce("_text", "text"))
        .withColumn("char_end", F.coalesce("_end", "char_end"))
        .withColumn(
            "token_count",
            F.when(hit, text.count_tokens(F.col("text"), counter)).otherwise(F.col("token_count")),
        )
        .withColumn("manual_override", F.coalesce("_how", "manual_override"))
        .select(chunks.columns)
    )
    touched = merged.select(F.explode(F.array("chunk_id", "_gone")).alias("chunk_id"))
    rejects = judged.where("reason is not null").select("chunk_id_a", "chunk_id_b", "reason")
    return EditResult(edited, touched, rejects)


def default_split_offset(txt: Column) -> Column:
    """C17: the midpoint, moved just behind the nearest newline within 100 characters."""
    mid = F.shiftright(F.length(txt), 1)
    reach = F.least(F.lit(100), mid)
    # At equal distance the newline ahead of the midpoint wins.
    ahead = F.call_function("locate", F.lit("\n"), F.substring(txt, mid + 1, reach)) - 1
    behind = F.call_function(
        "locate", F.lit("\n"), F.reverse(F.substring(txt, mid - reach + 2, reach))
    ) - 1
    take_ahead = (ahead >= 0) & ((behind < 0) | (ahead <= behind))
    return F.when(take_ahead, mid + ahead + 1).when(behind >= 0, mid - behind + 1).otherwise(mid)


def split_chunks(chunks: DataFrame, edits: DataFrame, *,
                 counter: TokenCounter = estimate_counts) -> EditResult:
    """C17: ``edits(chunk_id, offset)``: cut a chunk in two at an offset in its text.

    A null offset means ``default_split_offset``. The first half keeps the id;
    the second starts where the trimmed first half ends and gets a new id above all
    ids in use. A chunk that is split more than once in a job is left whole, and
    all its edits are rejected.

    The halves are written once: numbering, the chunks that stay and the rejects all
    read them.
    """
    wanted = edits.select("chunk_id", "offset")
    uses = wanted.groupBy("chunk_id").agg(F.count("*").alias("_uses"))
    cuts = wanted.join(uses, "chunk_id").join(chunks, "chunk_id", "left")
    at = F.coalesce("offset", default_split_offset(F.col("text")))
    halves = cuts.withColumn("_at", at).withColumn(
        "_a", text.strip(F.substring("text", F.lit(1), F.col("_at")))
    ).withColumn("_b", text.strip(F.substring("text", F.col("_at") + 1, F.length("text"))))
    reason = (
        F.when(F.col("text").isNull(), "chunk not found")
        .when(F.col("_uses") > 1, "chunk in several edits")
        .when((F.col("_at") <= 0) | (F.col("_at") >= F.length("text")), "invalid split offset")
        .when((F.col("_a") == "") | (F.col("_b") == ""), "split would leave an empty chunk")
    )
    rejected = halves.withColumn("reason", reason).drop("text", "_uses")
    own = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    judged = written(rejected.select(*[c for c in rejected.columns if c not in ("_a", "_b")], own("_a"), own("_b")), "splits")
    good = fresh_ids(judged.where("reason is null"), ["chunk_id"], chunks, "chunk_id", out="_new").withColumn(
        "_mid", F.col("char_start") + F.length("_a")
    )

    def half(body: str, chunk_id: Column, start: Column, how: Column) -> Column:
        return F.struct(
            chunk_id.alias("chunk_id"), F.col(body).alias("text"), start.alias("char_start"),
            (start + F.length(body)).alias("char_end"),
            text.count_tokens(F.col(body), counter).alias("token_count"),
            how.alias("manual_override"),
        )

    both = F.array(
        half("_a", F.col("chunk_id"), F.col("char_start"),
             _override(("action", F.lit("split")), ("offset", F.col("_at")))),
        half("_b", F.col("_new"), F.col("_mid"),
             _override(("action", F.lit("split_result")), ("original_chunk_id", F.col("chunk_id")))),
    )
    changed = ("chunk_id", "text", "char_start", "char_end", "token_count", "manual_override")
    carried = [c for c in chunks.columns if c not in changed]
    # As for a new chunk: the second half has no type or confidence of its own.
    first_only = ("chunk_type", "boundary_confidence")
    parts = good.select(*carried, F.posexplode(both).alias("_i", "_h")).select(
        *[F.when(F.col("_i") == 0, F.col(c)).alias(c) if c in first_only else F.col(c)
          for c in carried],
        *[F.col(f"_h.{c}").alias(c) for c in changed],
    )
    touched = judged.where("reason is null").select("chunk_id")
    kept = chunks.join(touched, "chunk_id", "left_anti")
    rejects = judged.where("reason is not null").select("chunk_id", "offset", "reason")
    return EditResult(kept.unionByName(parts), touched, rejects)
