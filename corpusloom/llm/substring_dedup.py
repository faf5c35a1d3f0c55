"""Repeated passages: seed at winnowed anchors, extend both ways, keep maximal repeats.

An anchor is a hash of ``GRAM`` words. Every window of ``length`` words names one
anchor, the smallest hash inside it (the rightmost of equals), so equal windows
name equal anchors at equal places. The windows that name one anchor occurrence
are its reach: the longest extension to the left and right that matters.

1. Anchors are counted; windows of an anchor that occurs once are unique.
2. Occurrences of an anchor are compared by the hash of their whole extension. If
   it repeats, all windows in reach repeat.
3. Of the rest, one occurrence of each extension is compared window by window.

Hot anchors are aggregated, never paired. Repeated windows that overlap or touch
within a document form its maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept
from corpusloom.llm.words import U, column_bytes, groups_of, hash_words, range_hashes, windows

LENGTH = 35
GRAM = 10


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text: the tag tells apart texts that share an id, or have none."""
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def reaches(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of every anchor occurrence that a window names."""
    grams = windows(h, gram)
    width = length - gram + 1
    rows = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    at = np.arange(rows.shape[0]) + width - 1 - rows.argmin(1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, at.size - 1]
    return grams[at[first]], first, last


ANCHORS = "doc_id long, tag long, anchor long, s1 long, s2 int, first int, last int"


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every anchor occurrence with the windows in its reach and the hash of its extension."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id").to_pylist()
            tags = batch.column("tag").to_pylist()
            for part in groups_of(texts):
                found = hash_words([texts[i] for i in part], lanes=2)
                out = []
                for i, row in enumerate(part):
                    h, h2 = found.of(i), found.of(i, 1)
                    if h.size < length:
                        continue
                    anchor, first, last = reaches(h, length, gram)
                    s1 = range_hashes(h, first, last + length)
                    s2 = range_hashes(h2, first, last + length, 1) >> U(33)
                    out.append((ids[row], tags[row], anchor, s1, s2, first, last))
                if not out:
                    continue
                n = [len(x[2]) for x in out]
                doc, tag = (np.repeat(np.arange(len(out)), n) for _ in range(2))
                join = [np.concatenate([x[c] for x in out]) for c in range(2, 7)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()).take(pa.array(doc)),
                     pa.array([x[1] for x in out], pa.int64()).take(pa.array(tag)),
                     pa.array(join[0].view(np.int64)), pa.array(join[1].view(np.int64)),
                     *(pa.array(c.astype(np.int32)) for c in join[2:])],
                    names=[f.split()[0] for f in ANCHORS.split(", ")])

    return tagged(docs).where(F.col("text").isNotNull()).mapInArrow(run, ANCHORS)


def _with_entries(docs: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """``docs``, tagged, with the distinct (first, last) entries that ``rows`` has for each text."""
    own = rows.groupBy(F.col("doc_id").alias("own_id"), F.col("tag").alias("own_tag")).agg(
        F.collect_set(F.struct("first", "last")).alias(name))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tag") == F.col("own_tag"))
    return tagged(docs).join(own, same, how).drop("own_id", "own_tag")


def _entries(batch, name: str) -> list[np.ndarray]:
    """A column of entry lists as integer arrays (n, 2)."""
    column = batch.column(name)
    out = []
    for i in range(len(column)):
        values = column[i].values
        out.append(np.zeros((0, 2), np.int64) if values is None else np.column_stack(
            [np.asarray(values.field(c)).astype(np.int64) for c in range(2)]))
    return out


WINDOWS = "w1 long, w2 long, doc_id long, tag long, first int"


def window_rows(docs: DataFrame, asked: DataFrame, length: int = LENGTH) -> DataFrame:
    """Hashes of the windows that ``asked`` (doc_id, tag, first, last) names, 128 bits each."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id").to_pylist()
            tags, entries = batch.column("tag").to_pylist(), _entries(batch, "entries")
            for part in groups_of(texts):
                found = hash_words([texts[i] for i in part], lanes=2)
                for i, row in enumerate(part):
                    own = entries[row]
                    n = own[:, 1] - own[:, 0] + 1
                    at = np.repeat(own[:, 0] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    w = [range_hashes(found.of(i, lane), at, at + length, lane).view(np.int64)
                         for lane in range(2)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[0]), pa.array(w[1]), pa.array([ids[row]] * at.size, pa.int64()),
                         pa.array([tags[row]] * at.size, pa.int64()), pa.array(at.astype(np.int32))],
                        names=[f.split()[0] for f in WINDOWS.split(", ")])

    return _with_entries(docs, asked, "entries", "inner").mapInArrow(run, WINDOWS)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, first, last): runs of windows that start anywhere else, too."""
    every = kept(anchors(docs, length, gram), "anchors")
    # The key tables of the joins are written: both sides of a join are then plain
    # shuffles, which lets Spark split a hot anchor over several tasks.
    again = kept(every.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    shared = kept(every.join(again, "anchor", "left_semi"), "shared-anchors")
    span = ["anchor", "s1", "s2"]
    spans = kept(shared.groupBy(*span).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select(*span), "repeated-spans")
    whole = shared.join(spans, span, "left_semi").select("doc_id", "tag", "first", "last")
    extension = F.struct("s1", "s2")
    mixed = kept(shared.groupBy("anchor").agg(
        F.min(extension).alias("least"), F.max(extension).alias("most")).where("least <> most").select("anchor"),
        "mixed-anchors")
    # The new name of the anchor makes the grouping a shuffle of its own, so that a
    # hot anchor is split in the join before it.
    asked = shared.join(mixed, "anchor", "left_semi").withColumn(
        "part", F.col("anchor").bitwiseXOR(F.col("s1"))).groupBy("part", "s1", "s2").agg(
        F.min(F.struct("doc_id", "tag", "first", "last")).alias("one")).select("one.*")
    seen = kept(window_rows(docs, asked, length), "windows")
    twice = kept(seen.groupBy("w1", "w2").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "repeated-windows")
    single = seen.join(twice, ["w1", "w2"], "left_semi").select(
        "doc_id", "tag", "first", F.col("first").alias("last"))
    return whole.union(single)


CLEANED = ("doc_id long, n_words long, n_removed long, kept_text string, "
           "repeats array<struct<start: int, end: int>>")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Documents → doc_id, n_words, n_removed, kept_text, repeats.

    ``repeats`` are the maximal repeated runs of words (end exclusive); ``kept_text``
    joins all other words by one space. Null and empty texts have no words. A
    document with fewer words than a window is left alone. A repeated row is
    another document, so both lose every window. Rows without an id are cleaned
    like others.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("doc_id")
            texts = column_bytes(batch, "text")
            out = []
            for text, own in zip(texts, _entries(batch, "covers")):
                words = (text or b"").split()
                spans: list[dict] = []
                keep = words
                if len(own):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, own[:, 0], 1)
                    np.add.at(edge, own[:, 1] + length, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    keep = [words[i] for i in np.flatnonzero(~covered)]
                    turn = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
                    spans = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
                out.append((len(words), len(words) - len(keep), b" ".join(keep).decode(), spans))
            if out:
                n, gone, text, spans = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "repeats"])

    wide = _with_entries(docs, repeats(docs, length, gram), "covers", "left").drop("tag")
    return wide.mapInArrow(run, CLEANED)
