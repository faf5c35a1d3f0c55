"""Document structure: headings, section tree, section lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text
from corpusloom.functions.text import WS

# What counts as a Markdown heading, and the clean-up rules in
# their order. (?d) makes only \n a line end.
HEADING = rf"(?md)^#{{1,6}}{WS}+.+$"
HEADING_MARK = rf"\A#{{1,6}}{WS}+"
MARKDOWN_RULES = (
    (rf"(?md)^#{{1,6}}{WS}+", ""),
    (r"(?d)\*{1,3}(.+?)\*{1,3}", "$1"),
    (r"(?d)_{1,3}(.+?)_{1,3}", "$1"),
    (r"(?d)\[(.+?)\]\(.+?\)", "$1"),
    (r"(?s)```.*?```", ""),
    (r"(?d)`(.+?)`", "$1"),
)


def headings(full_text: Column) -> Column:
    """Headings as ``array<struct<level,text,char_start,char_end>>``."""

    def located(gaps: Column, marks: Column) -> Column:
        ends = arrays.prefix_sums(
            F.transform(marks, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        )
        return F.zip_with(
            marks,
            ends,
            lambda m, end: F.struct(
                F.length(F.regexp_extract(m, "^#+", 0)).alias("level"),
                text.strip(F.regexp_replace(m, HEADING_MARK, "")).alias("text"),
                (end - F.length(m)).alias("char_start"),
                end.alias("char_end"),
            ),
        )

    return arrays.split_with_gaps(full_text, HEADING, located)


def section_paths(heads: Column) -> Column:
    """For each heading the titles from the root down to it."""

    def step(stack: Column, head: Column) -> tuple[Column, Column]:
        kept = F.slice(stack, F.lit(1), F.least(F.size(stack), head["level"] - 1))
        path = F.concat(kept, F.array(head["text"]))
        return path, F.array(path)

    return arrays.blocked_fold(heads, arrays.empty_array("string"), "array<string>", step)


def sections(heads: Column, paths: Column, text_length: Column) -> Column:
    """Each heading's section runs to the next heading; none: one root section."""

    def section(path: Column, start: Column, end: Column) -> Column:
        return F.struct(
            path.alias("section_path"), start.alias("char_start"), end.alias("char_end")
        )

    def build(heads: Column, paths: Column, text_length: Column) -> Column:
        whole = F.array(section(arrays.empty_array("string"), F.lit(0), text_length))
        per_heading = F.transform(
            heads,
            lambda h, i: section(
                F.get(paths, i),
                h["char_start"],
                F.coalesce(F.get(heads, i + 1)["char_start"], text_length),
            ),
        )
        return F.when(F.size(heads) == 0, whole).otherwise(per_heading)

    return arrays.let_all([heads, paths, text_length], build)


def text_sections(filename: Column, text_length: Column) -> Column:
    """A plain-text document is one section named after the file stem."""
    return F.array(
        F.struct(
            F.array(file_stem(filename)).alias("section_path"),
            F.lit(0).alias("char_start"),
            text_length.alias("char_end"),
        )
    )


def file_stem(path: Column) -> Column:
    """The last path segment without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def _last_covering(secs: Column, pos: Column) -> Column:
    """The last section with ``start <= pos < end``, null if there is none; both must be bound."""

    def find(secs: Column, pos: Column) -> Column:
        # Largest index whose start is <= pos, built from the top bit down.
        bits = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
        return F.aggregate(
            F.filter(bits, lambda bit: bit <= F.size(secs)),
            F.lit(-1),
            lambda found, bit: F.when(
                (bit <= F.size(secs) - 1 - found)
                & (F.get(secs, found + bit)["char_start"] <= pos),
                found + bit,
            ).otherwise(found),
        )

    def covering(secs: Column, pos: Column, at: Column) -> Column:
        earlier = F.filter(F.slice(secs, F.lit(1), F.greatest(at, F.lit(0))), lambda s: pos < s["char_end"])
        return F.when(pos < F.get(secs, at)["char_end"], F.get(secs, at)).otherwise(
            F.try_element_at(earlier, F.lit(-1)))

    return arrays.let(find(secs, pos), lambda at: covering(secs, pos, at))


def section_at(secs: Column, pos: Column) -> Column:
    """Path of the last section with ``start <= pos < end``, else empty.

    Sections are listed by ascending start, as B5 lists them, and may overlap. The
    last one that starts at or before ``pos`` is found by halving; only where it
    has ended already are the sections before it looked at.
    """
    found = arrays.let_all([secs, pos], _last_covering)
    return F.coalesce(found["section_path"], arrays.empty_array("string"))


# Positions of one section that travel with one copy of its path.
POSITIONS = 64


def sections_of_positions(secs: Column, positions: Column) -> Column:
    """B7 for many positions of a text: ``array<struct<section_path,positions>>``, in their order.

    Neighbouring positions in one section share its path, up to ``POSITIONS`` of
    them. Exploded by these rows and then by their positions, no row carries all
    sections of its text, as it would with a row per position and ``section_at``.
    """
    spans = F.transform(secs, lambda s, i: F.struct(
        s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), i.alias("at")))
    of_each = lambda spans, positions: F.transform(
        positions, lambda p: F.coalesce(_last_covering(spans, p)["at"], F.lit(-1)))

    def runs(secs: Column, positions: Column, at: Column) -> Column:
        heads = F.filter(arrays.indices(at), lambda i: (i % POSITIONS == 0) | (F.get(at, i) != F.get(at, i - 1)))
        return arrays.let(heads, lambda heads: F.transform(heads, lambda h, i: F.struct(
            F.coalesce(F.get(secs, F.get(at, h))["section_path"], arrays.empty_array("string")).alias("section_path"),
            F.slice(positions, h + 1, F.coalesce(F.get(heads, i + 1), F.size(at)) - h).alias("positions"))))

    return arrays.let_all([secs, spans, positions], lambda secs, spans, positions: arrays.let(
        of_each(spans, positions), lambda at: runs(secs, positions, at)))


def strip_markdown(c: Column) -> Column:
    """Markdown syntax removed, rule by rule."""
    for pattern, replacement in MARKDOWN_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return text.strip(c)


def with_structure(docs: DataFrame) -> DataFrame:
    """Fill ``headings``, ``sections`` and ``clean_text_length`` by ``format``.

    Expects ``filename``, ``format`` (``md`` or ``txt``) and ``full_text``.
    """
    is_md = F.col("format") == "md"
    length = F.length("full_text")
    no_headings = F.array().cast(
        "array<struct<level:int,text:string,char_start:int,char_end:int>>"
    )
    with_heads = docs.withColumn(
        "headings", F.when(is_md, headings(F.col("full_text"))).otherwise(no_headings)
    )
    with_paths = with_heads.withColumn("_paths", section_paths(F.col("headings")))
    return with_paths.withColumn(
        "sections",
        F.when(is_md, sections(F.col("headings"), F.col("_paths"), length)).otherwise(
            text_sections(F.col("filename"), length)
        ),
    ).withColumn(
        "clean_text_length",
        F.when(is_md, F.length(strip_markdown(F.col("full_text")))),
    ).drop("_paths")


def markdown_structure(docs: DataFrame) -> DataFrame:
    """``with_structure`` for a table that holds Markdown only."""
    return with_structure(docs.withColumn("format", F.lit("md")))
