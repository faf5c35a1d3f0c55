"""Ordered search of many needles in one long text."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np

from corpusloom.functions.text import WS

BLANKS = re.compile(f"{WS}+")
GRAM = 8


class Haystack:
    """A text that finds needles at or after a cursor which only moves forward.

    A needle that is found moves the cursor, so plain scans for such needles read
    the text once in all. Needles that are missing would read the rest of it each:
    once they have read some texts' worth, they are looked up in indexes of all runs
    of 8, 16, 32 … characters: by the longest runs that a needle starts and ends
    with. What is missing stays missing.
    """

    PATIENCE = 8

    def __init__(self, text: str):
        self.text = text
        self.missing: set[str] = set()
        self.wasted = 0
        self.scales: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def find(self, needle: str, cursor: int) -> int:
        if needle in self.missing:
            return -1
        if self.wasted > self.PATIENCE * len(self.text) and len(needle) >= GRAM:
            at = self._looked_up(needle, cursor)
        else:
            at = self.text.find(needle, cursor)
            self.wasted += len(self.text) - cursor if at < 0 else 0
        if at < 0:
            self.missing.add(needle)
        return at

    def _looked_up(self, needle: str, cursor: int) -> int:
        k = 1 << (len(needle).bit_length() - 1)
        hashes, places, grams = self._scale(k)
        head, tail = (int(gram_hashes(part, k)[0]) for part in (needle[:k], needle[-k:]))
        here = [np.searchsorted(grams, np.uint64(h), side=side) for h in (head, tail) for side in ("left", "right")]
        shift = len(needle) - k
        # Places of the rarer end; the other one must be where the needle has it.
        if here[1] - here[0] <= here[3] - here[2]:
            starts, other, want = places[here[0]:here[1]], shift, tail
        else:
            starts, other, want = places[here[2]:here[3]] - shift, 0, head
        starts = starts[np.searchsorted(starts, cursor):]
        starts = starts[starts + other < hashes.size]
        for at in starts[hashes[starts + other] == np.uint64(want)].tolist():
            if self.text.startswith(needle, at):
                return at
        return -1

    def _scale(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.scales:
            hashes = gram_hashes(self.text, k)
            places = np.argsort(hashes, kind="stable")
            self.scales[k] = hashes, places, hashes[places]
        return self.scales[k]


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` characters, a power of two: hashes of two halves, mixed."""
    hashes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = 1
    while width < k:
        n = max(hashes.size - width, 0)
        hashes = hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[width:width + n]
        hashes ^= hashes >> np.uint64(29)
        width *= 2
    return hashes


class Collapsed:
    """A text with each run of white space made one blank, and where its characters went."""

    def __init__(self, text: str):
        runs = [m.span() for m in BLANKS.finditer(text) if m.end() - m.start() > 1]
        self.starts = [a for a, _ in runs]
        self.extra = [b - a - 1 for a, b in runs]
        self.before = [0, *accumulate(self.extra)]
        self.hay = Haystack(BLANKS.sub(" ", text))

    def place(self, at: int) -> int:
        """The place of character ``at`` of the text."""
        run = bisect_right(self.starts, at) - 1
        if run < 0:
            return at
        return at - self.before[run] - min(at - self.starts[run], self.extra[run])


def locate(text: str, needles: list[str | None]) -> list[tuple[str, int, int]]:
    """(needle, start, end) of needles searched in order, each after the one before.

    One that is not found verbatim is searched with white space collapsed, from
    the cursor on: its offset there, added to the cursor, is its approximate
    start. One still not found is left out, and the cursor stays.
    """
    hay, collapsed = Haystack(text), None
    out, cursor = [], 0
    for needle in needles:
        if needle is None:
            continue
        at = hay.find(needle, cursor)
        if at < 0:
            collapsed = collapsed or Collapsed(text)
            first = collapsed.place(cursor)
            found = collapsed.hay.find(BLANKS.sub(" ", needle).strip(" "), first)
            at = cursor + found - first if found >= 0 else -1
        if at >= 0:
            cursor = at + len(needle)
            out.append((needle, at, cursor))
    return out
