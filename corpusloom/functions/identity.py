"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str | Column, name: Column) -> Column:
    """RFC 4122 version-5 UUID of ``name`` under a namespace UUID."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    digest = F.sha1(F.concat(F.unhex(F.replace(ns, F.lit("-"), F.lit(""))), name.cast("binary")))

    def part(start: int, length: int) -> Column:
        return F.substring(digest, start, length)

    # The top two bits of the clock field are fixed to binary 10.
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        part(1, 8),
        part(9, 4),
        F.concat(F.lit("5"), part(14, 3)),
        F.concat(variant, part(18, 3)),
        part(21, 12),
    )
