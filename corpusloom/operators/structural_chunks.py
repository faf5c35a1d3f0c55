"""Structural chunking: heading split, size merge, paragraph packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text
from corpusloom.functions.text import TokenCounter, estimate_counts
from corpusloom.operators.structure import section_at

PARAGRAPH_BREAK = "\n\n"
CHUNK_FIELDS = ("ord", "text", "char_start", "char_end", "section_path", "token_count",
                "boundary_confidence")


def heading_pieces(full_text: Column, headings: Column, sections: Column,
                   levels: Sequence[int]) -> Column:
    """Non-blank pieces between the starts of headings of the given levels."""
    return arrays.let_all(
        [full_text, headings, sections], lambda t, h, s: _heading_pieces(t, h, s, levels)
    )


def _heading_pieces(full_text: Column, headings: Column, sections: Column,
                    levels: Sequence[int]) -> Column:
    wanted = F.filter(headings, lambda h: h["level"].isin(list(levels)))
    cuts = F.array_sort(
        F.array_distinct(
            F.concat(F.array(F.lit(0)), F.transform(wanted, lambda h: h["char_start"]))
        )
    )

    kept = F.filter(arrays.cut(full_text, cuts), lambda p: ~text.is_blank(p["raw"]))
    return F.transform(
        kept,
        lambda p: F.struct(
            p["start"].alias("start"),
            p["end"].alias("end"),
            # Characters of leading space that stripping removes.
            (
                F.length(p["raw"])
                - F.length(F.ltrim(p["raw"], F.lit(text.WHITESPACE)))
            ).alias("lead"),
            text.strip(p["raw"]).alias("text"),
            section_at(sections, p["start"]).alias("path"),
        ),
    )


def paragraphs(piece_text: Column, separator: str = PARAGRAPH_BREAK) -> Column:
    """Non-blank paragraphs with their spans: ``struct<text,start,end>``."""
    return arrays.let(
        F.split(piece_text, separator, -1), lambda parts: _located_paragraphs(parts, len(separator))
    )


def _located_paragraphs(parts: Column, width: int) -> Column:
    ends = arrays.prefix_sums(F.transform(parts, lambda p: F.length(p) + width))
    located = F.zip_with(
        parts,
        ends,
        lambda p, e: F.struct(
            text.strip(p).alias("text"),
            (e - width - F.length(F.ltrim(p, F.lit(text.WHITESPACE)))).alias("start"),
        ),
    )
    return F.transform(
        F.filter(located, lambda p: p["text"] != ""),
        lambda p: F.struct(
            p["text"].alias("text"),
            p["start"].alias("start"),
            (p["start"] + F.length(p["text"])).alias("end"),
        ),
    )


def pack_starts(tokens: Column, max_tokens: int) -> Column:
    """C4: where a greedy packing of ``tokens`` into ``max_tokens`` opens a pack."""
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"))

    def step(s: Column, n: Column) -> tuple[Column, Column]:
        opens = (s["at"] == 0) | (s["used"] + n > max_tokens)
        used = F.when(opens, n).otherwise(s["used"] + n)
        emitted = F.when(opens, F.array(s["at"])).otherwise(arrays.empty_array("int"))
        return F.struct(used.alias("used"), (s["at"] + 1).alias("at")), emitted

    return arrays.blocked_fold(tokens, state, "int", step)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _draft(txt: Column, start: Column, end: Column, path: Column, tokens: Column,
           joins: Column) -> Column:
    return F.struct(
        txt.alias("text"), start.alias("start"), end.alias("end"), path.alias("path"),
        tokens.alias("tokens"), joins.alias("joins"),
    )


def pack_paragraphs(paras: Column, tokens: Column, path: Column, base: Column, lead: Column,
                    max_tokens: int, separator: str, exact_spans: bool) -> Column:
    """C4: packs of whole paragraphs; a lone oversize paragraph stays whole.

    ``exact_spans`` keeps true source positions. Otherwise positions follow the
    joined text, as if paragraphs were always one separator apart.
    """
    starts = pack_starts(tokens, max_tokens)
    packs = F.arrays_zip(
        arrays.groups(paras, starts).alias("paras"),
        arrays.groups(tokens, starts).alias("tokens"),
    )
    drafts = F.transform(
        packs,
        lambda g: _draft(
            F.array_join(F.transform(g["paras"], lambda p: p["text"]), separator),
            base + lead + F.get(g["paras"], F.lit(0))["start"],
            base + lead + F.element_at(g["paras"], -1)["end"],
            path,
            _sum(g["tokens"]),
            F.lit(False),
        ),
    )
    if exact_spans:
        return drafts
    width = len(separator)
    ends = arrays.prefix_sums(F.transform(drafts, lambda d: F.length(d["text"]) + width))
    return F.zip_with(
        drafts,
        ends,
        lambda d, e: _draft(
            d["text"], base + e - width - F.length(d["text"]), base + e - width,
            d["path"], d["tokens"], d["joins"],
        ),
    )


def structural_chunks(
    docs: DataFrame,
    *,
    min_tokens: int = 50,
    max_tokens: int = 800,
    heading_split_levels: Sequence[int] = (1, 2, 3),
    counter: TokenCounter = estimate_counts,
    separator: str = PARAGRAPH_BREAK,
    exact_spans: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id`` plus one row per chunk; a narrow job, no shuffle.

    Needs ``doc_id, full_text, headings, sections``. A piece that fits but is
    below ``min_tokens`` joins the chunk before it, so runs of such pieces form
    one group with their predecessor; that needs no fold.
    """
    src = docs.select("doc_id", *keep, "full_text", "headings", "sections")
    pieces = src.select(
        "doc_id",
        *keep,
        heading_pieces(F.col("full_text"), F.col("headings"), F.col("sections"),
                       heading_split_levels).alias("pieces"),
    )
    sized = pieces.withColumn("sizes", counter(F.col("pieces.text")))
    # Paragraphs of the oversize pieces only, flattened for the token counter.
    split = sized.withColumn(
        "paras",
        F.zip_with(
            "pieces",
            "sizes",
            lambda p, n: F.when(n > max_tokens, paragraphs(p["text"], separator)).otherwise(
                arrays.empty_array("struct<text:string,start:int,end:int>")
            ),
        ),
    )
    counted = split.withColumn("para_sizes", counter(F.flatten("paras")["text"])).withColumn(
        "para_ends", arrays.prefix_sums(F.transform("paras", lambda p: F.size(p)))
    )

    def drafts_of(pieces: Column, sizes: Column, paras: Column, para_sizes: Column,
                  para_ends: Column) -> Column:
        def of_piece(p: Column, i: Column) -> Column:
            mine = F.get(paras, i)
            first = F.get(para_ends, i) - F.size(mine)
            n = F.get(sizes, i)
            whole = F.array(
                _draft(p["text"], p["start"], p["end"], p["path"], n, n < min_tokens)
            )
            packed = pack_paragraphs(
                mine, F.slice(para_sizes, first + 1, F.size(mine)), p["path"],
                p["start"], p["lead"], max_tokens, separator, exact_spans,
            )
            return F.when(n > max_tokens, packed).otherwise(whole)

        return F.flatten(F.transform(pieces, of_piece))

    drafts = counted.select(
        "doc_id", *keep,
        arrays.let_all(
            [F.col(c) for c in ("pieces", "sizes", "paras", "para_sizes", "para_ends")], drafts_of
        ).alias("drafts"),
    )
    heads = arrays.let(
        F.col("drafts"),
        lambda ds: F.filter(arrays.indices(ds), lambda i: (i == 0) | ~F.get(ds, i)["joins"]),
    )
    merged = (
        drafts.withColumn("heads", heads)
        .withColumn("groups", arrays.groups(F.col("drafts"), F.col("heads")))
        .withColumn(
            "texts",
            F.transform(
                "groups",
                lambda g: F.array_join(F.transform(g, lambda d: d["text"]), PARAGRAPH_BREAK),
            ),
        )
        .withColumn("counts", counter(F.col("texts")))
    )
    rows = merged.select(
        "doc_id",
        *keep,
        F.posexplode(F.arrays_zip("groups", "texts", "counts")).alias("pos", "g"),
    )
    first = F.get("g.groups", F.lit(0))
    return rows.select(
        "doc_id",
        *keep,
        (F.col("pos") + 1).alias("ord"),
        F.col("g.texts").alias("text"),
        first["start"].alias("char_start"),
        F.element_at("g.groups", -1)["end"].alias("char_end"),
        first["path"].alias("section_path"),
        F.when(F.size("g.groups") == 1, first["tokens"])
        .otherwise(F.col("g.counts"))
        .alias("token_count"),
        F.lit(None).cast("double").alias("boundary_confidence"),
    )
