"""Words, their hashes and shingles of many texts at once, for tasks that run numpy.

A word is a maximal run of bytes that are not separators. Word and shingle hashes
have 64 bits; callers that need exact identity over a whole corpus take ``lanes=2``
and compare 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

U = np.uint64
BLANKS = bytes([32, *range(9, 14)])
# Bytes hashed in one go: bounds the scratch arrays, not the texts.
SEGMENT = 1 << 20
_BASES = (U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        at = np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1B54A32D192ED03 % 2**64)
        return mix(at) | U(1)


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SEPARATORS = byte_class(BLANKS)
# Everything in ASCII but letters and digits.
PUNCTUATION = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))


def fold_ascii() -> np.ndarray:
    """Byte to byte: A-Z become a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_FOLD, _SAME = fold_ascii(), np.arange(256, dtype=np.uint8)


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a lane's base and of its inverse modulo 2**64."""
    have = _POWERS.get(lane)
    if have is None or have[0].size < n:
        base = _BASES[lane]
        inverse = U(pow(int(base), -1, 2**64))
        rows = []
        for x in (base, inverse):
            p = np.full(max(n, SEGMENT + 1), x, dtype=U)
            p[0] = 1
            rows.append(np.cumprod(p))
        have = (rows[0], rows[1])
        if n <= 2 * SEGMENT:
            _POWERS[lane] = have
    return have


class Words(NamedTuple):
    """Of many texts: ``offsets[i]:offsets[i + 1]`` are the words of text i.

    ``starts`` and ``ends`` are byte positions in ``data``, the joined texts.
    """

    data: bytes
    hashes: tuple[np.ndarray, ...]
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def of(self, i: int, lane: int = 0) -> np.ndarray:
        return self.hashes[lane][self.offsets[i]:self.offsets[i + 1]]


def _segments(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about ``SEGMENT`` bytes that never divide a word."""
    at, n = 0, data.size
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:
            gaps = np.flatnonzero(separators[data[end:end + SEGMENT]])
            if gaps.size:
                end += int(gaps[0])
                break
            end = min(n, end + SEGMENT)
        yield at, end
        at = end


def hash_words(texts: list[bytes | None], *, fold: bool = False, lanes: int = 1,
               separators: np.ndarray = SEPARATORS) -> Words:
    """Words of ``texts``; a missing text has none. ``fold`` lower-cases A-Z."""
    gap = bytes([int(np.flatnonzero(separators)[0])])
    parts = [t or b"" for t in texts]
    data = gap.join([*parts, b""])
    raw = np.frombuffer(data, np.uint8)
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    found: list[list[np.ndarray]] = [[] for _ in range(lanes + 2)]
    values = [constants(256, 11 + lane)[_FOLD if fold else _SAME] for lane in range(lanes)]
    with np.errstate(over="ignore"):
        for a, b in _segments(raw, separators):
            piece = raw[a:b]
            inside = np.empty(b - a + 2, np.int8)
            inside[0] = inside[-1] = 0
            inside[1:-1] = ~separators[piece]
            edge = np.diff(inside)
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            found[-2].append(s + a)
            found[-1].append(e + a)
            for lane in range(lanes):
                power, inverse = _powers(lane, b - a + 1)
                sums = np.zeros(b - a + 1, U)
                np.cumsum(values[lane][piece] * power[:b - a], out=sums[1:])
                found[lane].append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U)))
    joined = [np.concatenate(x) if x else np.zeros(0, U) for x in found]
    starts, ends = joined[-2].astype(np.int64), joined[-1].astype(np.int64)
    return Words(data, tuple(joined[:lanes]), starts, ends, np.searchsorted(starts, bounds))


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each ``k`` consecutive values; none if there are fewer."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U)
        for c, i in zip(constants(k, seed), range(k)):
            total += h[i:i + n] * c
        return mix(total)


def range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each range of ``h``; equal ranges have equal hashes wherever they lie."""
    power, inverse = _powers(lane, h.size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(h.size + 1, U)
        np.cumsum(h * power[:h.size], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct ``k``-word shingles of one text, sorted; shorter texts have one."""
    if h.size == 0:
        return np.zeros(0, U)
    w = min(k, h.size)
    return np.unique(windows(h, w, seed=100 + w))


def column_bytes(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def groups_of(texts: list[bytes | None], limit: int = 2 << 20) -> Iterator[range]:
    """Runs of texts of about ``limit`` bytes, at least one text each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield range(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))
