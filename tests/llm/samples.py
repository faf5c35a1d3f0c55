"""Texts for the tests of the llm operators."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so", "va", "ne") for b in ("n", "r", "st", "l", "m", "k")]
# Null and blank texts, one word, a very long text, repeated rows and ids, no id, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 20000), (None, "kan lor mist tul rem sok van"),
    (7, "same text twice over and over again"), (7, "same text twice over and over again"),
    (8, "same text twice over and over again"), (9, "ünï straße 漢字 kan lor"), (10, "x" * 50000),
    (11, "123 456"), (7, "another text of id seven, unlike the first"),
]


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]
