"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of words with smallest period q, at least ``SHORTEST`` words and
``REPEATS`` periods long, that no neighbouring word extends. Each of its words occurs
``REPEATS`` times in it at least. So a word that occurs less often in a segment lies
in no run there and splits the segment; the parts are counted anew until no part
changes. Only parts long enough survive, and hold every run whole.

Surviving segments are scanned for lags. The lag of a place is the distance to the
next place with the same ``k`` words. For q <= k a run's places all have lag q, since
an earlier return would make its period smaller; a stretch of places with one lag is
thus a maximal run. ``k`` doubles from 16 while anything repeats, and each ``k``
answers for the lags of its own size, so the scan takes n log n steps, not n².
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import U, column_bytes, groups_of, hash_words, mix

SHORTEST = 24
REPEATS = 3
# Words compared at once in the first scan; a run of SHORTEST words holds them twice.
FIRST = 16
# Words of a text that are joined at once.
PIECE = 1 << 16
_STEP = U(0x9E3779B97F4A7C15)


def stretched(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: the range and the value of each member, one after the other."""
    n = ends - starts
    owner = np.repeat(np.arange(n.size), n)
    return owner, np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def frequency_split(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stable segments of many texts."""
    kinds, rank = np.unique(words, return_inverse=True)
    starts, ends = offsets[:-1], offsets[1:]
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = ends - starts >= SHORTEST
        starts, ends = starts[long], ends[long]
        if not starts.size:
            break
        owner, at = stretched(starts, ends)
        _, own, n = np.unique(owner * kinds.size + rank[at], return_inverse=True, return_counts=True)
        rare = n[own] < REPEATS
        split = np.bincount(owner[rare], minlength=starts.size) > 0
        stable.append((starts[~split], ends[~split]))
        stays = np.flatnonzero(~rare & split[owner])
        at, owner = at[stays], owner[stays]
        if not at.size:
            break
        turn = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0))
        starts, ends = at[np.r_[0, turn + 1]], at[np.r_[turn, at.size - 1]] + 1
    if not stable:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = (np.concatenate(x) for x in zip(*stable))
    order = np.argsort(starts)
    return starts[order], ends[order]


def lag_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs in some segments."""
    owner, at = stretched(starts, ends)
    out = [np.zeros((0, 3), np.int64)]
    if not at.size:
        return out[0]
    room = ends[owner] - at
    places = np.arange(at.size)
    with np.errstate(over="ignore"):
        gram = mix(words[at] + owner.astype(U) * _STEP)
        k = 1
        while k < FIRST:
            places = places[room[places] >= 2 * k]
            gram[places] = mix(gram[places] * _STEP + gram[places + k])
            k *= 2
        while places.size:
            order = places[np.argsort(gram[places], kind="stable")]
            same = gram[order[1:]] == gram[order[:-1]]
            here, lag = order[:-1][same], np.diff(order)[same]
            mine = (lag <= k) & ((lag > k // 2) | (k == FIRST))
            here, lag = here[mine], lag[mine]
            if here.size:
                by_place = np.argsort(here)
                here, lag = here[by_place], lag[by_place]
                turn = np.flatnonzero((np.diff(here) != 1) | (np.diff(lag) != 0))
                first, last = np.r_[0, turn + 1], np.r_[turn, here.size - 1]
                q = lag[first]
                length = here[last] - here[first] + k + q
                whole = length >= np.maximum(SHORTEST, REPEATS * q)
                out.append(np.column_stack([at[here[first]], length, q])[whole])
            again = np.zeros(at.size, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            places = places[(room[places] >= 2 * k)]
            places = places[again[places]]
            places = places[again[places + k]]
            gram[places] = mix(gram[places] * _STEP + gram[places + k])
            k *= 2
    return np.concatenate(out)


def runs_of(hashes: np.ndarray, offsets: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs of many texts, by start, then period.

    ``check`` is a second hash of each word, by which runs are confirmed.
    """
    found = lag_runs(hashes, *frequency_split(hashes, offsets))
    if check is not None and len(found):
        true = [np.array_equal(check[s:s + n - q], check[s + q:s + n]) for s, n, q in found]
        found = found[true]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def joined(data: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> bytes:
    """The words at ``places``, joined by one space, a piece at a time."""
    if not places.size:
        return b""
    turn = np.flatnonzero(np.diff(places) != 1) + 1
    cuts = np.r_[0, turn, places.size]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        for i in range(a, b, PIECE):
            j = min(b, i + PIECE) - 1
            parts.append(b" ".join(data[starts[places[i]]:ends[places[j]]].split()))
    return b" ".join(parts)


FOUND = ("doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
         "strongest int, collapsed_text string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) → doc_id, n_words, runs, strongest, collapsed_text.

    ``runs`` (start, length, period; word numbers from 0) by start, then period;
    ``strongest`` is the place from 0 of the one with most periods (ties: smallest
    start, then period), null without runs. ``collapsed_text`` joins by one space the
    words that no run contains after its first period. Null and blank texts have no
    words and no runs. Repeated rows count each; a null id stays null. A text is held
    whole by one task, with some 150 bytes for each of its words.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in ("doc_id", "n_words", "runs", "strongest", "collapsed_text")]
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id")
            for part in groups_of(texts):
                found = hash_words([texts[i] for i in part], lanes=2)
                rows = runs_of(found.hashes[0], found.offsets, found.hashes[1])
                drop = np.zeros(found.starts.size + 1, np.int64)
                np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
                np.add.at(drop, rows[:, 0] + rows[:, 1], -1)
                stays = np.cumsum(drop[:-1]) == 0
                cuts = np.searchsorted(rows[:, 0], found.offsets)
                strongest, collapsed = [], []
                for i in range(len(part)):
                    own = [(-((int(n) << 64) // int(q)), int(s), int(q), j)
                           for j, (s, n, q) in enumerate(rows[cuts[i]:cuts[i + 1]])]
                    strongest.append(min(own)[-1] if own else None)
                    a, b = found.offsets[i], found.offsets[i + 1]
                    collapsed.append(joined(found.data, found.starts, found.ends, a + np.flatnonzero(stays[a:b])))
                base = np.repeat(found.offsets[:-1], np.diff(cuts))
                own = [pa.array(c.astype(np.int64)) for c in (rows[:, 0] - base, rows[:, 1], rows[:, 2])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.start, len(part)), pa.array(np.diff(found.offsets).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)),
                                              pa.StructArray.from_arrays(own, fields=list(kind))),
                     pa.array(strongest, pa.int32()), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def summary(found: DataFrame) -> DataFrame:
    """``periodic_runs`` → doc_id, n_runs, the strongest run, digests of the runs and of the rest."""
    best = F.get("runs", F.col("strongest"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("runs[strongest].length * 1000 div runs[strongest].period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
        "n_words")


def with_planted_periods(doc_id: Column, text: Column) -> Column:
    """``text``, in a tenth of the documents with a period planted from some word on.

    h is the crc32 of the id (none: of an empty string), g = floor(h / 10). If 10
    divides h, each word from word a = g mod n on becomes a + (i - a) mod p of the
    original, p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

    @F.pandas_udf("string")
    def planted(texts: pd.Series, g: pd.Series) -> pd.Series:
        def edit(text, g):
            words = None if text is None else text.split()
            if not words:
                return None if text is None else ""
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            turns = -(-(n - a) // p)
            return b" ".join((words[:a] + words[a:a + p] * turns)[:n]).decode("utf-8")

        return pd.Series([edit(t, int(x)) for t, x in zip(texts, g)], dtype=object)

    mine = h % 10 == 0
    return F.when(mine, planted(F.when(mine, text.cast("binary")), F.floor(h / 10))).otherwise(text)
