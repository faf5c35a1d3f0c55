"""Ordered folds and span-keeping splits over in-row arrays.

A document's sentences, paragraphs or headings stay an array in its row: the
fold needs no shuffle and no Python worker. Folds emit only small values and
copy at most ``BLOCK`` of them per step, so their cost grows with the length
of the document, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
# A character of the Unicode private use area.
MARK = "\uE000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once.

    The optimizer may put a column's expression where the column is used. Used
    inside a lambda it would then be evaluated for every element, so lambdas
    here only capture values bound by ``let``.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``let`` for several values."""
    if len(values) == 1:
        return let(values[0], lambda v: body(v))
    return let(values[0], lambda v: let_all(values[1:], lambda *rest: body(v, *rest)))


def rows_of(items: Column | str) -> Column:
    """``items`` for ``explode``, when computing them is expensive.

    Before exploding a plain column the optimizer filters on its size, and moves
    that filter to where the column is computed, which computes it twice.
    """
    return F.transform(items, lambda x: x)


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def blocked_fold(
    items: Column,
    state: Column,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """Fold ``items`` in order; ``step(state, item)`` gives (state, emitted array).

    Returns every emitted array, concatenated, as ``array<out_type>``.
    """


    def one_item(a: Column, item: Column) -> Column:
        new_state, emitted = step(a["state"], item)
        return F.struct(new_state.alias("state"), F.concat(a["out"], emitted).alias("out"))

    return let(items, lambda xs: _over_blocks(xs, state, out_type, one_item))


def _over_blocks(items: Column, state: Column, out_type: str,
                 one_item: Callable[[Column, Column], Column]) -> Column:
    """Fold block by block; ``one_item`` maps (state, out) and an item to the next."""

    def acc(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def one_block(outer: Column, block: Column) -> Column:
        return F.aggregate(
            F.slice(items, block * BLOCK + 1, F.lit(BLOCK)),
            acc(outer["state"], empty_array(out_type)),
            one_item,
            lambda inner: acc(inner["state"], F.concat(outer["out"], F.array(inner["out"]))),
        )

    blocks = F.when(
        F.size(items) > 0,
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
    ).otherwise(empty_array("int"))
    start = acc(state, empty_array(f"array<{out_type}>"))
    return F.aggregate(blocks, start, one_block, lambda a: F.flatten(a["out"]))


def scan(items: Column, state: Column, state_type: str,
         step: Callable[[Column, Column], Column]) -> Column:
    """Every state of a fold, in order: ``step(state, item)`` gives the next one."""

    def one_item(a: Column, item: Column) -> Column:
        return let(
            step(a["state"], item),
            lambda s: F.struct(s.alias("state"), F.concat(a["out"], F.array(s)).alias("out")),
        )

    return let(items, lambda xs: _over_blocks(xs, state, state_type, one_item))


def prefix_sums(lengths: Column) -> Column:
    """Inclusive running totals of an int array."""
    return scan(lengths, F.lit(0), "int", lambda total, n: total + n)


def indices(items: Column) -> Column:
    """0-based positions of an array, empty for an empty one."""
    return F.transform(items, lambda _, i: i)


def cut(text: Column, starts: Column) -> Column:
    """Pieces of ``text`` between 0-based ``starts`` (ascending, first 0): ``struct<start,end,raw>``.

    A substring counts characters from the front of its text. So blocks of pieces
    are cut first, and pieces from their block.
    """

    def of(text: Column, starts: Column) -> Column:
        heads = F.filter(starts, lambda _, i: i % BLOCK == 0)

        def block(head: Column, b: Column) -> Column:
            stop = F.coalesce(F.get(heads, b + 1), F.length(text))
            own = F.slice(starts, b * BLOCK + 1, F.lit(BLOCK))
            return let_all(
                [F.substring(text, head + 1, stop - head), own, stop],
                lambda body, own, stop: F.transform(own, lambda s, i: let(
                    F.coalesce(F.get(own, i + 1), stop),
                    lambda e: F.struct(s.alias("start"), e.alias("end"),
                                       F.substring(body, s - head + 1, e - s).alias("raw")))))

        return F.flatten(F.transform(heads, block))

    return let_all([text, starts], of)


def groups(items: Column, starts: Column) -> Column:
    """Cut ``items`` at 0-based ``starts`` (ascending, first 0) into sub-arrays."""
    return let_all(
        [items, starts],
        lambda xs, at: F.transform(
            at, lambda s, i: F.slice(xs, s + 1, F.coalesce(F.get(at, i + 1), F.size(xs)) - s)
        ),
    )


def split_with_gaps(text: Column, pattern: str,
                    body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the texts between matches (n + 1) and the matches (n).

    One pass of the pattern puts a private-use mark around every match; then a
    plain split gives gap, match, gap, … Texts that hold the mark already are
    searched twice instead.
    """

    def of_text(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        quick = let(marked, lambda parts: F.struct(
            F.filter(parts, lambda _, i: i % 2 == 0).alias("gaps"),
            F.filter(parts, lambda _, i: i % 2 == 1).alias("marks"),
        ))
        twice = F.struct(
            F.split(t, pattern, -1).alias("gaps"),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("marks"),
        )
        return F.when(F.contains(t, F.lit(MARK)), twice).otherwise(quick)

    return let(let(text, of_text), lambda p: body(p["gaps"], p["marks"]))
