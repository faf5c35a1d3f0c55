"""Clause chunking by request and response tables.

``windows`` → ``clause_requests`` → an external model → ``clause_chunks``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays, search, text
from corpusloom.functions.text import TokenCounter, estimate_counts
from corpusloom.operators.structural_chunks import PARAGRAPH_BREAK, pack_starts
from corpusloom.operators.structure import section_at
from corpusloom.session import written
from corpusloom.shipping import ship_package

# Fixed value: the request text sent for each window.
CLAUSE_PROMPT = """Split the following text into atomic clauses. An atomic clause is a self-contained unit of meaning: one rule, one fact, one definition, one procedural step, one parameter description, one specification line, etc.

Rules:
- Return ONLY a JSON array of strings, no prose, no markdown fences.
- Each string MUST be an exact verbatim substring of the input.
- The strings must appear in the same order as in the input.
- Together they should cover the substantive content (skip pure whitespace, separator lines, navigation chrome).
- A markdown table row is one atomic clause. A bullet point is one atomic clause. A numbered step is one atomic clause. A standalone sentence is one atomic clause.
- Do NOT merge multiple atomic units into one string.
- Do NOT split a single atomic unit across multiple strings.

Input:
<<<
{text}
>>>"""


def windows(docs: DataFrame, *, max_window_tokens: int = 3000,
            counter: TokenCounter = estimate_counts, keep: Sequence[str] = ()) -> DataFrame:
    """Contiguous windows of whole paragraphs; blank documents give none."""
    src = docs.select("doc_id", *keep, "full_text").where(~text.is_blank(F.col("full_text")))
    cut = (
        src.withColumn("_total", F.get(counter(F.array("full_text")), F.lit(0)))
        .withColumn("_paras", F.split("full_text", PARAGRAPH_BREAK, -1))
        .withColumn("_sizes", counter(F.col("_paras")))
        .withColumn(
            "_starts",
            F.when(F.col("_total") <= max_window_tokens, F.array(F.lit(0))).otherwise(
                pack_starts(F.col("_sizes"), max_window_tokens)
            ),
        )
    )
    packs = arrays.groups(F.col("_paras"), F.col("_starts"))
    bodies = arrays.let(packs, lambda gs: F.transform(
        gs,
        lambda g, i: F.concat(
            F.array_join(g, PARAGRAPH_BREAK),
            F.when(i < F.size(gs) - 1, F.lit(PARAGRAPH_BREAK)).otherwise(F.lit("")),
        ),
    ))
    placed = cut.select("doc_id", *keep, bodies.alias("_bodies")).withColumn(
        "_ends", arrays.prefix_sums(F.transform("_bodies", F.length))
    )
    return placed.select(
        "doc_id", *keep, F.posexplode(F.arrays_zip("_bodies", "_ends")).alias("w", "b")
    ).select(
        "doc_id", *keep, "w",
        (F.col("b._ends") - F.length("b._bodies")).alias("char_start"),
        F.col("b._ends").alias("char_end"),
        F.col("b._bodies").alias("text"),
    )


def clause_requests(wins: DataFrame) -> DataFrame:
    """One prompt per window."""
    head, tail = CLAUSE_PROMPT.split("{text}")
    return wins.withColumn("prompt", F.concat(F.lit(head), F.col("text"), F.lit(tail)))


def parse_clauses(response: Column) -> Column:
    """C11: the non-blank strings of a JSON array reply; null if there is none.

    A reply that is not JSON as a whole is searched from its first ``[`` to its
    last ``]``.
    """
    return _strings(_json_of(response))


def _json_of(response: Column) -> Column:
    body = text.strip_fences(response)
    whole = text.strict_json(body)
    inner = text.strict_json(F.nullif(F.regexp_extract(body, r"(?s)\[.*\]", 0), F.lit("")))
    return F.coalesce(whole, inner)


def _strings(value: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    strings = F.transform(
        F.filter(items, lambda v: text.variant_kind(v) == "STRING"),
        lambda v: F.variant_get(v, "$", "string"),
    )
    return F.when(
        text.variant_kind(value) == "ARRAY", F.filter(strings, lambda s: ~text.is_blank(s))
    )


def _parsed_once(response: Column) -> Column:
    """``parse_clauses`` with the reply's JSON read once. The optimizer does not take this form as a UDF's argument."""
    return arrays.let(_json_of(response), _strings)


LOCATED = "array<struct<clause:string,start:int,end:int>>"


def locate_clauses(window_text: Column, clauses: Column) -> Column:
    """Spans of clauses searched in order, each after the one before.

    A clause not found verbatim is searched with white space collapsed, which
    gives an approximate place; one still not found is dropped. Every span
    carries its own clause, so a dropped clause cannot shift the others.

    The search keeps a cursor and, where many clauses are missing, an index of
    the window. Column expressions have neither: they would read the window from
    its front for each clause. So it runs in Arrow batches.
    """
    ship_package(SparkSession.active())

    @F.arrow_udf(LOCATED)
    def located(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = [None if t is None or c is None else
                [{"clause": clause, "start": start, "end": end} for clause, start, end in search.locate(t, c)]
                for t, c in zip(texts.to_pylist(), wanted.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct(
            [("clause", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return located(window_text, clauses)


def clause_chunks(
    wins: DataFrame,
    responses: DataFrame,
    docs: DataFrame,
    *,
    counter: TokenCounter = estimate_counts,
) -> DataFrame:
    """Chunks from replies ``(doc_id, w, response)`` to the windows of C9.

    Replies that are parsed already have ``clauses`` instead of ``response``.
    """
    parsed = F.col("clauses") if "clauses" in responses.columns else _parsed_once(F.col("response"))
    joined = wins.join(responses.select("doc_id", "w", parsed.alias("_clauses")), ["doc_id", "w"])
    spans = joined.select(
        "doc_id", "w", F.col("char_start").alias("_base"),
        locate_clauses(F.col("text"), F.coalesce("_clauses", arrays.empty_array("string"))).alias("_spans"))
    # A window's sections are looked up before its clauses become rows, which would each carry them all.
    paths = arrays.let_all([F.col("sections"), F.col("_base")], lambda secs, base: F.transform(
        "_spans", lambda s: section_at(secs, base + s["start"])))
    placed = spans.join(docs.select("doc_id", "sections"), "doc_id", "left").withColumn("_paths", paths).select(
        "doc_id", "w", "_base", F.posexplode(F.arrays_zip("_spans", "_paths")).alias("_pos", "_at"))
    span = F.col("_at._spans")
    return placed.select(
        "doc_id", "w",
        (F.col("_pos") + 1).alias("ord"),
        text.strip(span["clause"]).alias("text"),
        (F.col("_base") + span["start"]).alias("char_start"),
        (F.col("_base") + span["end"]).alias("char_end"),
        F.col("_at._paths").alias("section_path"),
        text.count_tokens(span["clause"], counter).alias("token_count"),
        F.lit(1.0).alias("boundary_confidence"),
    )


class Replies(NamedTuple):
    parsed: DataFrame   # doc_id, w, clauses
    rejects: DataFrame  # doc_id, w, response, reason


def split_replies(responses: DataFrame) -> Replies:
    """C11: replies parsed once; those that hold no JSON array go apart, with the reason.

    One job writes both kinds, in folders of their own; a reply that is rejected
    keeps its text, an accepted one only its clauses. Rejected windows yield no chunks.
    """
    clauses = _parsed_once(F.col("response"))
    judged = responses.select("doc_id", "w", "response", clauses.alias("clauses")).withColumn(
        "rejected", F.col("clauses").isNull()
    ).withColumn("response", F.when(F.col("rejected"), F.col("response")))
    stored = written(judged, "replies", partition_by="rejected")
    return Replies(
        stored.where("not rejected").select("doc_id", "w", "clauses"),
        stored.where("rejected").select("doc_id", "w", "response", F.lit("no JSON array in the reply").alias("reason")),
    )
