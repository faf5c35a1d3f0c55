"""Language ID by prediction by partial matching over bytes.

Each language has a context tree: how often a byte followed the last 3, 2, 1 and
0 bytes. A text's code length in a language is exact under the frozen counts:
a byte is coded in its longest known context, and where that context has never
seen it, an escape is coded and the next shorter context asked, without the bytes
the longer one has seen (escape method C with exclusion). The shortest code wins.
Every counted context is kept: the tables are sparse, one entry for each byte that
followed a context in a language.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept
from corpusloom.llm.words import groups_of

ORDER = 3
# Priced 4-byte runs that a task remembers; what it forgets is priced again.
PRICED = 1 << 20
UNDETERMINED = "und"
PIECE = 1 << 20
_TABLES: dict[int, Tables] = {}
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")


class Counts(NamedTuple):
    """Per language, sorted: all 4-byte runs ``context * 256 + byte``, and how often they occur."""

    languages: list[str]
    grams: list[np.ndarray]
    n: list[np.ndarray]


class Level(NamedTuple):
    """The contexts of one order in one language, sparsely.

    ``codes`` are ``context * 256 + byte``, ``n`` their counts. Of each of ``contexts``:
    the sum and number of its own bytes, and what the next shorter context has
    besides those bytes.
    """

    codes: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    rest_total: np.ndarray
    rest_distinct: np.ndarray


class Tables:
    """Levels 0 to 3 of each language, and the code lengths in bits asked for so far."""

    def __init__(self, levels: list[list[Level]]):
        self.levels = levels
        self.forget()

    def forget(self) -> None:
        self.grams = np.zeros(0, np.uint32)
        self.bits = np.zeros((0, len(self.levels)), np.float32)

    def priced(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each of some sorted distinct 4-byte runs, per language."""
        at, known = found(self.grams, grams)
        out = np.empty((grams.size, len(self.levels)), np.float32)
        out[known] = self.bits[at[known]]
        new = grams[~known]
        if new.size:
            bits = np.column_stack([price(new, own) for own in self.levels])
            out[~known] = bits
            if self.grams.size + new.size > PRICED:
                self.forget()
            if new.size <= PRICED:
                place = np.searchsorted(self.grams, new)
                self.grams = np.insert(self.grams, place, new)
                self.bits = np.insert(self.bits, place, bits, axis=0)
        return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as an empty one."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % 4) == 2


def gram_counts(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): how often each 4 bytes occur, whole texts, counted per task first.

    A text starts after three zero bytes, so that every byte ends one gram.
    """

    def count(batches):
        import pyarrow as pa

        held: dict[str, list] = {}

        def fold(name):
            codes = np.concatenate([c for c, _ in held[name]])
            n = np.concatenate([k for _, k in held[name]])
            unique, at = np.unique(codes, return_inverse=True)
            held[name] = [(unique, np.bincount(at, weights=n).astype(np.int64))]

        for batch in batches:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in groups_of(values, 2 << 20):
                own: dict[str, list[bytes]] = {}
                for i in part:
                    own.setdefault(names[i], []).append(b"\0\0\0" + values[i])
                for name, pieces in own.items():
                    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
                    codes = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
                    joins = np.cumsum(sizes)[:-1]
                    keep = np.ones(codes.size, bool)
                    for back in range(3):  # the pad of the next text is not a text's byte
                        keep[joins + back - 3] = False
                    held.setdefault(name, []).append(
                        np.unique(codes[keep], return_counts=True))
                    if len(held[name]) > 16:
                        fold(name)
        for name in held:
            fold(name)
            codes, n = held[name][0]
            for a in range(0, codes.size, 50_000):
                part = codes[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * part.size, pa.string()), pa.array(part.astype(np.int64)),
                     pa.array(n[a:a + 50_000])], names=["lang", "gram", "n"])

    rows = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    per_task = rows.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")
                           ).mapInArrow(count, "lang string, gram long, n long")
    return per_task.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> Counts:
    """Counts over all of ``texts`` (lang, text), of every context.

    The distinct 4-byte runs of each language reach the driver and the tasks, 12
    bytes each: they grow with the variety of the texts, not with their amount.
    """
    grams = kept(gram_counts(texts), "grams")
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    own, n = [], []
    for lang in languages:
        rows = grams.where(F.col("lang") == lang).select("gram", "n").toArrow()
        codes = rows["gram"].to_numpy().astype(np.uint32)
        order = np.argsort(codes)
        own.append(codes[order])
        n.append(rows["n"].to_numpy()[order])
    return Counts(languages, own, n)


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in the sorted ``keys``, and whether they are there."""
    if not keys.size:
        return np.zeros(asked.size, np.int64), np.zeros(asked.size, bool)
    at = np.minimum(np.searchsorted(keys, asked), keys.size - 1)
    return at, keys[at] == asked


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of the sorted ``keys`` with the sums of ``values``."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first)


def levels_of(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """All levels of a language from its 4-byte runs.

    A byte that followed a context followed the shorter ones, too, at least as often.
    """
    out: list[Level] = []
    for order in range(ORDER + 1):
        codes, counts = grams, n
        if order < ORDER:
            codes = grams & np.uint32(256 ** (order + 1) - 1)
            by_code = np.argsort(codes, kind="stable")
            codes, counts = sums(codes[by_code], n[by_code])
        context = codes >> np.uint32(8)
        contexts, total = sums(context, counts)
        distinct = sums(context, np.ones(codes.size, np.int64))[1]
        rest_total, rest_distinct = np.zeros_like(total), np.zeros_like(distinct)
        if order:
            up = out[-1]
            at = np.searchsorted(up.codes, codes & np.uint32(256 ** order - 1))
            shorter = np.searchsorted(up.contexts, contexts & np.uint32(256 ** (order - 1) - 1))
            rest_total = up.total[shorter] - sums(context, up.n[at])[1]
            rest_distinct = up.distinct[shorter] - distinct
        out.append(Level(codes, counts, contexts, total, distinct, rest_total, rest_distinct))
    return out


def build_tables(counts: Counts) -> Tables:
    return Tables([levels_of(g, n) for g, n in zip(counts.grams, counts.n)])


def price(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Bits of the last byte of each 4-byte run in one language.

    From the shortest context up: p, the byte's probability when a context is asked
    first; q, when it is asked by an escape of the next longer one.
    """
    p = q = above = np.zeros(grams.size)
    for order, level in enumerate(levels):
        code = grams & np.uint32(256 ** (order + 1) - 1)
        at, own = found(level.codes, code)
        n = np.where(own, level.n[at], 0)
        at, known = found(level.contexts, code >> np.uint32(8))
        total, distinct = level.total[at], level.distinct[at]
        if order:
            rest, kinds = level.rest_total[at], level.rest_distinct[at]
            base = np.maximum(rest + kinds, 1)
            escaped = np.where((above > 0) & ~own, above / base,
                               np.where(rest + kinds > 0, kinds / base, 1) * q)
        else:
            escaped = 1 / np.maximum(256 - distinct, 1)
        base = total + distinct
        p = np.where(known, np.where(own, n / base, distinct / base * escaped), p)
        q = np.where(known, escaped, q)
        above = n
    return -np.log2(np.maximum(p, 2.0**-60))


def code_lengths(texts: list[bytes], tables: Tables) -> np.ndarray:
    """Bits of each text in each language."""
    out = np.zeros((len(texts), len(tables.levels)))
    pad = b"\0" * ORDER

    def add(owners: list[int], pieces: list[bytes]) -> None:
        s = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
        codes = (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]
        grams, row = np.unique(codes, return_inverse=True)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        costs = tables.priced(grams)[row]
        edges = np.column_stack([starts, starts + sizes - ORDER]).ravel()
        edges[-1] = min(edges[-1], len(row))
        # Even slices are texts; odd ones run over the pad of the next text.
        if edges[-1] == len(row):
            edges = edges[:-1]
        bits = np.add.reduceat(costs, edges, axis=0, dtype=np.float64)[::2]
        np.add.at(out, owners, bits)

    owners, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text), PIECE):
            before = text[max(0, a - ORDER):a]
            pieces.append(pad[len(before):] + before + text[a:a + PIECE])
            owners.append(i)
            held += len(pieces[-1])
            if held >= PIECE:
                add(owners, pieces)
                owners, pieces, held = [], [], 0
    if pieces:
        add(owners, pieces)
    return out


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "ignore")))


GUESS = "lang_pred string, score double, bits_per_byte double"


def predictor(docs: DataFrame, counts: Counts):
    """A function from a text column to a struct of ``GUESS``."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf(GUESS)
    def guess(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        if id(known) not in _TABLES:
            _TABLES.clear()
            _TABLES[id(known)] = build_tables(known) if known.languages else None
        tables = _TABLES[id(known)]
        lang = np.full(len(texts), UNDETERMINED, object)
        score, rate = np.zeros(len(texts)), np.full(len(texts), np.nan)
        asked = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        if asked and tables is not None:
            own = [texts.iloc[i] for i in asked]
            bits = code_lengths(own, tables)
            best = bits.argmin(1)
            least = bits.min(1)
            lang[asked] = np.array(known.languages, object)[best]
            score[asked] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            rate[asked] = least / np.fromiter(map(len, own), np.int64, len(own))
        return pd.DataFrame({"lang_pred": lang, "score": score, "bits_per_byte": rate})

    return lambda text: guess(text.cast("binary"))


def predicted_documents(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) → doc_id, held_out, lang_pred, score, bits_per_byte.

    Trained on the texts with a language that ``held_out`` does not keep back;
    predicted for all, whole texts. The score is the posterior of the prediction
    under equal priors. Null texts, texts without a letter, and all texts if
    nothing was learned, are ``und`` with score 0 and no rate. Repeated rows count
    each; equal code lengths go to the name that sorts first.
    """
    counts = train(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    guess = predictor(docs, counts)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       guess(F.col("text")).alias("g")).select("doc_id", "held_out", "g.*")
