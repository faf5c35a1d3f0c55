"""Plain Python models of the document folds, written from their rules."""

from __future__ import annotations

import math
import re


def tokens(s: str) -> int:
    return max(1, len(s) // 4)


def heads(text: str) -> list[tuple[int, str, int, int]]:
    found = re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M)
    return [(len(m[1]), m[2].strip(), m.start(), m.end()) for m in found]


def tree(text: str) -> list[tuple[list[str], int, int]]:
    hs = heads(text)
    if not hs:
        return [([], 0, len(text))]
    ends = [h[2] for h in hs[1:]] + [len(text)]
    out, path = [], []
    for (level, title, start, _), end in zip(hs, ends):
        path = path[: level - 1] + [title]
        out.append((path, start, end))
    return out


def path_at(secs, pos: int) -> list[str]:
    hits = [p for p, a, z in secs if a <= pos < z]
    return hits[-1] if hits else []


def packs(sizes: list[int], limit: int) -> list[list[int]]:
    """Index groups of a greedy packing."""
    out: list[list[int]] = []
    used = 0
    for i, n in enumerate(sizes):
        if out and used + n <= limit:
            out[-1].append(i)
            used += n
        else:
            out.append([i])
            used = n
    return out


def structural(text: str, low: int, high: int, levels, exact: bool):
    """(text, start, end, path, tokens) of each structural chunk."""
    if not text.strip():
        return []
    secs = tree(text)
    cuts = sorted({0, *(h[2] for h in heads(text) if h[0] in levels)})
    chunks: list[list] = []
    for a, z in zip(cuts, [*cuts[1:], len(text)]):
        raw = text[a:z]
        body = raw.strip()
        if not body:
            continue
        n, path = tokens(body), path_at(secs, a)
        if n <= high:
            if n < low and chunks:
                last = chunks[-1]
                last[0] += "\n\n" + body
                last[2], last[4] = z, tokens(last[0])
            else:
                chunks.append([body, a, z, path, n])
            continue
        lead = len(raw) - len(raw.lstrip())
        at, paras = 0, []
        for part in body.split("\n\n"):
            if part.strip():
                inner = len(part) - len(part.lstrip())
                paras.append((part.strip(), a + lead + at + inner))
            at += len(part) + 2
        drift = a
        for group in packs([tokens(p) for p, _ in paras], high):
            joined = "\n\n".join(paras[i][0] for i in group)
            first, last = paras[group[0]], paras[group[-1]]
            span = (first[1], last[1] + len(last[0])) if exact else (drift, drift + len(joined))
            drift += len(joined) + 2
            chunks.append([joined, *span, path, sum(tokens(paras[i][0]) for i in group)])
    return [tuple(c) for c in chunks]


def sentence_spans(text: str) -> list[tuple[int, int, str]]:
    breaks = [m.span() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z(\[\"'])|\n+", text)]
    starts = [0, *(b for _, b in breaks)]
    ends = [*(a for a, _ in breaks), len(text)]
    return [(a, z, text[a:z]) for a, z in zip(starts, ends) if text[a:z].strip()]


def counts(text: str, letters: str) -> list[float]:
    return [float(text.count(c)) for c in letters]


def cos(a, b) -> float:
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)) + 1e-8)


def semantic(text: str, low: int, high: int, threshold: float, letters: str):
    """(text, start, end, tokens, confidence) of each semantic chunk."""
    sents = sentence_spans(text)
    if not sents:
        return []
    opens, sims, used = [0], [], tokens(sents[0][2])
    for i in range(1, len(sents)):
        sim = cos(counts(sents[i - 1][2], letters), counts(sents[i][2], letters))
        n = tokens(sents[i][2])
        if used + n > high or (sim < threshold and used >= low):
            opens.append(i)
            sims.append(sim)
            used = n
        else:
            used += n
    out = []
    for k, first in enumerate(opens):
        last = (opens[k + 1] if k + 1 < len(opens) else len(sents)) - 1
        a, z = sents[first][0], sents[last][1]
        body = text[a:z].strip()
        n = tokens(sents[0][2]) if len(sents) == 1 else tokens(body)
        out.append((body, a, z, n, 1 - sims[k] if k < len(sims) else 1.0))
    return out


def windows(text: str, limit: int) -> list[tuple[int, int]]:
    if not text.strip():
        return []
    if tokens(text) <= limit:
        return [(0, len(text))]
    paras = text.split("\n\n")
    out, at = [], 0
    for group in packs([tokens(p) for p in paras], limit):
        end = at + sum(len(paras[i]) + 2 for i in group)
        out.append((at, min(end, len(text))))
        at = end
    return out


def locate(text: str, clauses: list[str]) -> list[tuple[str, int, int]]:
    out, cursor = [], 0
    squeeze = lambda s: re.sub(r"\s+", " ", s)
    for c in clauses:
        i = text.find(c, cursor)
        if i < 0:
            j = squeeze(text[cursor:]).find(squeeze(c).strip())
            if j < 0:
                continue
            i = cursor + j
        cursor = i + len(c)
        out.append((c, i, cursor))
    return out
