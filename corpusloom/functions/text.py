"""Text expressions (I1-I7, I9): plain Columns, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.schemas import DNB

# The characters Python's str.strip() removes.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
# The same set as a regular-expression class. Spelled out, it is several times
# faster to test than a Unicode property.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# A token counter maps array<string> to array<int>. A vectorized UDF fits too.
TokenCounter = Callable[[Column], Column]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def estimate_tokens(c: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.shiftright(F.length(c), 2))


def estimate_counts(texts: Column) -> Column:
    """I1 over an array of texts; the default token counter."""
    return F.transform(texts, estimate_tokens)


def count_tokens(text: Column, counter: TokenCounter = estimate_counts) -> Column:
    """Token count of one text under a pluggable counter."""
    if counter is estimate_counts:
        return estimate_tokens(text)
    return F.element_at(counter(F.array(text)), 1)


def normalize_whitespace(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "), F.lit(" "))


def truncate(c: Column, max_chars: int = 200, ellipsis: str = "...") -> Column:
    """I4: at most ``max_chars`` characters, the ellipsis included."""
    cut = F.concat(F.substring(c, 1, max_chars - len(ellipsis)), F.lit(ellipsis))
    return F.when(F.length(c) > max_chars, cut).otherwise(c)


def first_sentence(c: Column) -> Column:
    """The first sentence of the first line, else the first 200 characters."""
    hit = F.regexp_extract(c, rf"(?d)\A(.*?[.!?]){WS}", 1)
    return F.when(hit != "", hit).otherwise(F.substring(c, 1, 200))


def text_hash(c: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(c.cast("binary"), 256)


def strip_fences(c: Column) -> Column:
    """Drop a surrounding Markdown code fence, with or without ``json``."""
    text = strip(c)
    opened = F.regexp_replace(text, rf"\A```(?:json)?{WS}*", "")
    closed = F.regexp_replace(opened, rf"{WS}*```\z", "")
    return F.when(F.startswith(text, F.lit("```")), closed).otherwise(text)


def strict_json(c: Column) -> Column:
    """The text as a variant, or null unless all of it is one JSON value.

    The JSON reader stops after the first value. Wrapping the text in an array
    and in an object makes anything that follows a syntax error.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    items = F.try_variant_get(in_array, "$", "array<variant>")
    return F.when(in_object.isNotNull() & (F.size(items) == 1), F.get(items, F.lit(0)))


def variant_kind(v: Column) -> Column:
    """``ARRAY``, ``OBJECT``, ``STRING`` …; null for a missing variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_dnb(categories: Column) -> Column:
    """No category at all, or only the reserved one."""
    return (F.size(categories) == 0) | (
        (F.size(categories) == 1) & (F.get(categories, F.lit(0)) == DNB)
    )
