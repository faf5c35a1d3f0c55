"""Sentence segmentation, semantic and hybrid chunking."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text, vectors
from corpusloom.functions.text import WS, TokenCounter, estimate_counts
from corpusloom.functions.vectors import Embedder
from corpusloom.operators.structural_chunks import structural_chunks
from corpusloom.operators.structure import section_at
from corpusloom.shipping import ship_package

# Fixed value: a sentence ends at white space between an end mark and an ASCII
# capital, bracket or quote, or at line ends. The white space comes first, so
# that most positions fail on one cheap test.
SENTENCE_BREAK = rf"""{WS}(?<=[.!?]{WS}){WS}*(?=[A-Z(\["'])|\n+"""
# The same places for a scan that is quick to pass over anything but end marks and line ends.
BREAK_AFTER_MARK = re.compile(rf"""[.!?]({WS}+)(?=[A-Z(\["'])|\n+""")
# Sentences whose vectors travel together when embedding is spread over tasks.
EMBED_BLOCK = 256


SEGMENTS = "struct<units:array<string>,sentences:array<struct<k:int,start:int,end:int,text:string>>>"


def with_sentences(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Adds ``sentences``, an array of ``struct<k,start,end,text>``, and ``units``.

    ``k`` is the segment's place among all segments, blank ones included, and
    ``units[k]`` is segment plus separator, so a run of sentences can be put
    together again without cutting the whole text.

    One scan of the text makes both. It runs in Arrow batches: as column
    expressions it is four passes over arrays, at several times the cost.
    """
    ship_package(df.sparkSession)

    @F.arrow_udf(SEGMENTS)
    def segmented(texts: pa.Array) -> pa.Array:
        return segments_of(texts)

    cut = df.withColumn("_seg", segmented(F.col(text_col)))
    return cut.withColumns({"units": F.col("_seg.units"), "sentences": F.col("_seg.sentences")}).drop("_seg")


def segments_of(texts: pa.Array) -> pa.Array:
    """``SEGMENTS`` of each text; a missing text has none."""
    find = BREAK_AFTER_MARK.finditer
    units, ks, starts, ends, bodies = [], [], [], [], []
    unit_ends, sentence_ends, missing = [0], [0], []
    for value in texts.to_pylist():
        missing.append(value is None)
        at = k = 0
        for a, b in [*(m.span(m.lastindex or 0) for m in find(value)), (len(value), len(value))] if value is not None else []:
            body = value[at:a]
            units.append(value[at:b])
            if body.strip(text.WHITESPACE):
                ks.append(k)
                starts.append(at)
                ends.append(a)
                bodies.append(body)
            at, k = b, k + 1
        unit_ends.append(len(units))
        sentence_ends.append(len(ks))
    ints = [pa.array(c, pa.int32()) for c in (ks, starts, ends)]
    spans = pa.StructArray.from_arrays([*ints, pa.array(bodies, pa.string())], names=["k", "start", "end", "text"])
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(unit_ends, pa.int32()), pa.array(units, pa.string())),
         pa.ListArray.from_arrays(pa.array(sentence_ends, pa.int32()), spans)],
        names=["units", "sentences"], mask=pa.array(missing))


def sentences(docs: DataFrame, text_col: str = "full_text") -> DataFrame:
    """C5 as a table: one row per sentence."""
    return (
        with_sentences(docs.select("doc_id", text_col), text_col)
        .select("doc_id", F.posexplode(arrays.rows_of("sentences")).alias("pos", "s"))
        .select(
            "doc_id",
            (F.col("pos") + 1).alias("ord"),
            F.col("s.start").alias("char_start"),
            F.col("s.end").alias("char_end"),
            F.col("s.text").alias("text"),
        )
    )


def _adjacent(vecs: Column) -> Column:
    """Similarity of each vector to the one before it (size - 1 values)."""
    return arrays.let(vecs, lambda vs: F.transform(
        F.filter(arrays.indices(vs), lambda i: i > 0),
        lambda i: vectors.cosine(F.get(vs, i - 1), F.get(vs, i)),
    ))


def with_similarities(df: DataFrame, key: Sequence[str], embedder: Embedder,
                      spread: bool) -> DataFrame:
    """Adds ``sims``, the similarity of neighbouring sentences.

    ``spread=False`` evaluates the embedder in the row; right for Column
    expressions. ``spread=True`` sends blocks of sentences, each with the last
    sentence of the block before, to all tasks, so that one long document does
    not tie up one worker; only one number per sentence comes back.
    """
    texts = F.transform("sentences", lambda s: s["text"])
    if not spread:
        return df.withColumn("_vecs", embedder(texts)).withColumn(
            "sims", _adjacent(F.col("_vecs"))
        ).drop("_vecs")
    blocks = F.sequence(F.lit(0), F.floor((F.size("sentences") - 1) / EMBED_BLOCK).cast("int"))
    parts = (
        df.where(F.size("sentences") > 1)
        .select(*key, F.explode(arrays.let(texts, lambda ts: F.transform(
            blocks,
            lambda b: F.struct(
                b.alias("block"),
                F.slice(ts, F.greatest(b * EMBED_BLOCK, F.lit(1)),
                        F.when(b == 0, EMBED_BLOCK).otherwise(EMBED_BLOCK + 1)).alias("texts"),
            ),
        ))).alias("b"))
        .select(*key, "b.block", "b.texts")
        .repartition(*key, "block")
    )
    scored = parts.withColumn("_vecs", embedder(F.col("texts"))).select(
        *key, "block", _adjacent(F.col("_vecs")).alias("part")
    )
    per_doc = scored.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("block", "part"))).alias("_parts")
    ).select(*key, F.flatten("_parts.part").alias("sims"))
    return df.join(per_doc, list(key), "left").withColumn(
        "sims", F.coalesce("sims", arrays.empty_array("double"))
    )


def sentence_cuts(sizes: Column, sims: Column, min_tokens: int, max_tokens: int,
                  threshold: float) -> Column:
    """Indexes of the sentences that open a new chunk, the first one left out."""
    return arrays.let(
        sims, lambda s: _sentence_cuts(sizes, s, min_tokens, max_tokens, threshold)
    )


def _sentence_cuts(sizes: Column, sims: Column, min_tokens: int, max_tokens: int,
                   threshold: float) -> Column:
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"))

    def step(s: Column, n: Column) -> tuple[Column, Column]:
        too_long = s["used"] + n > max_tokens
        drifted = (F.get(sims, s["at"] - 1) < threshold) & (s["used"] >= min_tokens)
        cuts = (s["at"] > 0) & (too_long | drifted)
        used = F.when(cuts, n).otherwise(s["used"] + n)
        emitted = F.when(cuts, F.array(s["at"])).otherwise(arrays.empty_array("int"))
        return F.struct(used.alias("used"), (s["at"] + 1).alias("at")), emitted

    return arrays.blocked_fold(sizes, state, "int", step)


def _group_sentences(df: DataFrame, key: Sequence[str], embedder: Embedder,
                     counter: TokenCounter, min_tokens: int, max_tokens: int,
                     threshold: float, spread: bool) -> DataFrame:
    """Adds ``parts``, an array of ``struct<text,start,end,confidence>``,
    and ``part_sizes`` for a table with ``sentences`` and ``units``."""
    scored = with_similarities(df, key, embedder, spread)
    sized = scored.withColumn("_sizes", counter(F.col("sentences.text")))
    cut = sized.withColumn(
        "_starts",
        F.concat(
            F.array(F.lit(0)),
            sentence_cuts(F.col("_sizes"), F.col("sims"), min_tokens, max_tokens, threshold),
        ),
    )

    def build(starts: Column, sents: Column, units: Column, sims: Column) -> Column:
        def part(first: Column, i: Column) -> Column:
            after = F.get(starts, i + 1)
            last = F.coalesce(after, F.size(sents)) - 1
            a, z = F.get(sents, first), F.get(sents, last)
            body = F.array_join(F.slice(units, a["k"] + 1, z["k"] - a["k"]), "")
            return F.struct(
                text.strip(F.concat(body, z["text"])).alias("text"),
                a["start"].alias("start"),
                z["end"].alias("end"),
                F.coalesce(F.round(1 - F.get(sims, after - 1), 3), F.lit(1.0)).alias("confidence"),
            )

        return F.transform(starts, part)

    built = arrays.let_all([F.col(c) for c in ("_starts", "sentences", "units", "sims")], build)
    parts = F.when(F.size("sentences") > 0, built).otherwise(
        F.array().cast("array<struct<text:string,start:int,end:int,confidence:double>>")
    )
    # A text of a single sentence is counted untrimmed.
    counted = F.when(F.size("sentences") == 1, F.col("sentences.text")).otherwise(
        F.col("parts.text")
    )
    return (
        cut.withColumn("parts", parts)
        .withColumn("part_sizes", counter(counted))
        .drop("_sizes", "_starts", "sims")
    )


def semantic_chunks(
    docs: DataFrame,
    embedder: Embedder,
    *,
    min_tokens: int = 50,
    max_tokens: int = 800,
    similarity_threshold: float = 0.5,
    counter: TokenCounter = estimate_counts,
    spread: bool = True,
    root_section: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Group neighbouring sentences, cutting where similarity drops.

    Needs ``doc_id, full_text, sections``. ``root_section=True`` stamps each
    chunk with the section at offset 0 instead of the one it starts in.
    """
    src = docs.select("doc_id", *keep, "full_text", "sections")
    grouped = _group_sentences(
        with_sentences(src).drop("full_text"), ["doc_id"], embedder, counter,
        min_tokens, max_tokens, similarity_threshold, spread,
    )
    where = lambda p: F.lit(0) if root_section else p["start"]
    # Looked up before the parts become rows, which would each carry all sections.
    paths = arrays.let(F.col("sections"), lambda secs: F.transform("parts", lambda p: section_at(secs, where(p))))
    rows = grouped.withColumn("paths", paths).select(
        "doc_id", *keep, F.posexplode(F.arrays_zip("parts", "part_sizes", "paths")).alias("pos", "p"),
    )
    return rows.select(
        "doc_id", *keep,
        (F.col("pos") + 1).alias("ord"),
        F.col("p.parts.text").alias("text"),
        F.col("p.parts.start").alias("char_start"),
        F.col("p.parts.end").alias("char_end"),
        F.col("p.paths").alias("section_path"),
        F.col("p.part_sizes").alias("token_count"),
        F.col("p.parts.confidence").alias("boundary_confidence"),
    )


def hybrid_chunks(
    docs: DataFrame,
    embedder: Embedder,
    *,
    min_tokens: int = 50,
    max_tokens: int = 800,
    similarity_threshold: float = 0.5,
    counter: TokenCounter = estimate_counts,
    spread: bool = True,
    keep: Sequence[str] = (),
    **structural_options,
) -> DataFrame:
    """Structural chunks; those still over the limit are cut by C7.

    ``ord`` counts structural chunks, ``sub_ord`` the parts of one of them.
    """
    chunks = structural_chunks(
        docs, min_tokens=min_tokens, max_tokens=max_tokens, counter=counter, keep=keep,
        **structural_options,
    )
    oversize = F.col("token_count") > max_tokens
    # Chunks that fit carry no sentences, so one narrow pass serves both kinds.
    cut = with_sentences(chunks.withColumn("_body", F.when(oversize, F.col("text"))), "_body")
    none = cut.withColumn("sentences", F.coalesce(
        "sentences", F.array().cast("array<struct<k:int,start:int,end:int,text:string>>")
    )).drop("_body")
    grouped = _group_sentences(
        none, ["doc_id", "ord"], embedder, counter, min_tokens, max_tokens,
        similarity_threshold, spread,
    )
    rows = grouped.select(
        "*", F.posexplode_outer(F.arrays_zip("parts", "part_sizes")).alias("pos", "p")
    )
    base = F.col("char_start")
    return rows.select(
        "doc_id", *keep, "ord",
        (F.coalesce("pos", F.lit(0)) + 1).alias("sub_ord"),
        F.coalesce("p.parts.text", "text").alias("text"),
        F.coalesce(base + F.col("p.parts.start"), base).alias("char_start"),
        F.coalesce(base + F.col("p.parts.end"), F.col("char_end")).alias("char_end"),
        "section_path",
        F.coalesce("p.part_sizes", "token_count").alias("token_count"),
        F.coalesce("p.parts.confidence", "boundary_confidence").alias("boundary_confidence"),
    )
