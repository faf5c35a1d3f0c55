"""Hard negatives: exact integer scores by a residue number system, then windowed selection.

Vectors become integers. Their products are computed modulo several small primes as
float32 matrix products: with balanced residues below p / 2 and at most
``2**24 / (p / 2)**2`` terms in a sum, every float32 step is exact. Chinese
remaindering in balanced mixed radix gives the signed integer score. The primes are
as many as the largest possible score needs.

Anchors meet all rows in blocks: a bounded block of anchors goes to the tasks, each
task walks over its rows and keeps a few candidates for each anchor, and only those
are shuffled. Further blocks of anchors are further passes over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept
from corpusloom.session import shared_folder

# Primes below 2**10: 64 exact terms in a sum of products of balanced residues.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
TERMS = 64
# Bytes of anchors that are with the tasks at a time, and of one matrix of scores.
ANCHOR_BYTES = 16 << 20
SCORE_CELLS = 1 << 20
LEAST = np.iinfo(np.int64).min
# Stands for a missing id where ties are ordered: after all others.
NO_ID = np.iinfo(np.int64).max


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product exceeds all differences of scores up to ``bound``."""
    if bound >= 2**63:
        raise ValueError(f"scores up to {bound} do not fit a long")
    product, n = 1, 0
    while product <= 2 * bound + 1:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:n]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo p, between -(p - 1) / 2 and (p - 1) / 2."""
    r = x % p
    return r - p * (r > p // 2)


def residues(matrix: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    return [balanced(matrix, p).astype(np.float32) for p in primes]


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo p, balanced; every partial sum is an exact float32."""
    total = None
    for k in range(0, max(a.shape[1], 1), TERMS):
        part = balanced((a[:, k:k + TERMS] @ b[:, k:k + TERMS].T).astype(np.int32), p)
        total = part if total is None else balanced(total + part, p)
    return total


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Signed 64-bit inner products of all rows, from the residues of two matrices."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        left = product_mod(a[i], b[i], p)
        # The digits found so far, taken off and divided out modulo p.
        for digit, q in zip(digits, primes):
            left = balanced((left - digit) * pow(q, -1, p), p)
        digits.append(left)
    # The score fits a long, so its mixed-radix sum may wrap on the way.
    score, radix = digits[0].astype(np.int64).view(np.uint64), 1
    for digit, q in zip(digits[1:], primes):
        radix = radix * q % 2**64
        score = score + digit.astype(np.int64).view(np.uint64) * np.uint64(radix)
    return score.view(np.int64)


class Best:
    """For each of some slots the ``k`` first (score, id) pairs: highest score, then smallest id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), LEAST)
        self.id = np.full((slots, k), NO_ID)

    def offer(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates; ``LEAST`` is no score."""
        late = score == self.score[slots, -1]
        better = (score > self.score[slots, -1]) | (late & (ids < self.id[slots, -1]))
        slots, score, ids = slots[better], score[better], ids[better]
        if not slots.size:
            return
        own = np.unique(slots)
        slots = np.r_[slots, np.repeat(own, self.k)]
        score, ids = np.r_[score, self.score[own].ravel()], np.r_[ids, self.id[own].ravel()]
        order = np.lexsort((ids, ~score, slots))
        slots, score, ids = slots[order], score[order], ids[order]
        rank = np.arange(slots.size) - np.searchsorted(slots, slots)
        first = rank < self.k
        self.score[slots[first], rank[first]] = score[first]
        self.id[slots[first], rank[first]] = ids[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score != LEAST)
        return slot, self.score[slot, place], self.id[slot, place]


def matrix_of(column, width: int) -> np.ndarray:
    """A list column of an Arrow batch as integers; shorter vectors end in zeros."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)[offsets[0]:offsets[-1]]
    n = np.diff(offsets)
    if (n == width).all():
        return values.reshape(n.size, width)
    out = np.zeros((n.size, width), np.int64)
    row = np.repeat(np.arange(n.size), n)
    out[row, np.arange(values.size) - np.repeat(offsets[:-1] - offsets[0], n)] = values
    return out


def prepared(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """row, vec_id, label, v: written once, so that a row's number stays its own."""
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return kept(rows.where(F.col(vector).isNotNull() & label.isNotNull()).where(finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"), q.alias("v")), "vectors")


def candidates(table: DataFrame, anchors, pos: np.ndarray, primes: tuple[int, ...], width: int, k: int,
               inside: Callable) -> DataFrame:
    """(slot, score, vec_id): each task's first ``k`` rows for each slot.

    ``anchors`` (row, label, v) is an Arrow table of about ``ANCHOR_BYTES``, ``pos``
    has a row for each of them and a column for each window; slots number its cells.
    ``inside(score, same label, pos)`` says which scores belong to one window.
    """
    windows = pos.shape[1]
    own = {"row": anchors["row"].to_numpy(), "label": anchors["label"].to_numpy(), "pos": pos,
           "v": residues(matrix_of(anchors["v"].combine_chunks(), width), primes)}
    shared = table.sparkSession.sparkContext.broadcast(own)

    def run(batches) -> Iterator:
        import pyarrow as pa

        a = shared.value
        best = Best(a["row"].size * windows, k)
        for batch in batches:
            vectors = residues(matrix_of(batch.column("v"), width), primes)
            row, label = batch.column("row").to_numpy(), batch.column("label").to_numpy()
            ids = batch.column("vec_id").fill_null(NO_ID).to_numpy()
            step = max(1, SCORE_CELLS // max(row.size, 1))
            for i in range(0, a["row"].size, step):
                part = slice(i, i + step)
                score = exact_scores([m[part] for m in a["v"]], vectors, primes)
                same = a["label"][part, None] == label[None, :]
                other = a["row"][part, None] != row[None, :]
                for w in range(windows):
                    slot = np.arange(score.shape[0]) * windows + i * windows + w
                    fits = inside(score, same, a["pos"][part, w, None]) & other
                    fits &= score >= best.score[slot, -1, None]
                    at, place = np.nonzero(fits)
                    best.offer(slot[at], score[at, place], ids[place])
        slot, score, ids = best.rows()
        if slot.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(score), pa.array(ids, mask=ids == NO_ID)], names=["slot", "score", "vec_id"])

    return table.mapInArrow(run, "slot long, score long, vec_id long")


def firsts(found: DataFrame, k: int) -> DataFrame:
    """Of all tasks' candidates the first ``k`` of each slot, numbered from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


MINED = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
         "negative_score long")


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | str = "label", vec_id: str = "vec_id",
                   vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5,
                   least: int = 80) -> DataFrame:
    """Rows → anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x); a score is the inner product. Rows where
    ``anchor``, a condition on vec_id, holds are anchors, with the first ``positives`` other rows of their label.
    For each of these, the first ``negatives`` rows of another label whose score is
    between ``least`` % and all of the positive's; ``rank`` from 1. Order: higher
    scores, then smaller ids, rows without an id last. Rows without a label or vector,
    or with a component that is null or not finite, take no part. Shorter vectors end
    in zeros. Repeated rows are rows of their own, also beside an anchor. No anchors
    or no rows give no result. Scores beyond a long are refused.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    table = prepared(rows, vec_id, vector, label, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, square, chosen = table.agg(
        F.max(F.size("v")), F.max(norm), F.count(F.when(anchor, 1))).first()
    width = width or 0
    primes = primes_for(int((square or 0) * (1 + 1e-9)) + 1)
    held = table.where(anchor & F.col("vec_id").isNotNull())
    path = shared_folder(spark, "negatives")
    spark.createDataFrame([], MINED).write.parquet(f"{path}/block=-1")
    blocks = -(-chosen * (8 * max(width, 1) + 64) // ANCHOR_BYTES)
    for block in range(blocks):
        mine = held.where(F.pmod(F.hash("row"), F.lit(blocks)) == block).toArrow()
        if mine.num_rows:
            mined_block(table, mine, primes, width, positives, negatives, least).write.parquet(
                f"{path}/block={block}")
    return spark.read.schema(f"{MINED}, block int").parquet(path).drop("block")


def mined_block(table: DataFrame, anchors, primes: tuple[int, ...], width: int, positives: int,
                negatives: int, least: int) -> DataFrame:
    """The result for the anchors of one Arrow table: their positives first, then the windows."""
    import pyarrow as pa

    spark = table.sparkSession
    none = np.zeros((anchors.num_rows, 1), np.int64)
    near = firsts(candidates(table, anchors, none, primes, width, positives,
                             lambda score, same, pos: same), positives).toArrow()
    slot, place, score = (near[c].to_numpy() for c in ("slot", "rank", "score"))
    pos = np.full((anchors.num_rows, positives), -1)
    pos[slot, place - 1] = score

    def inside(score, same, pos):
        """Another label and least * p <= 100 n <= 100 p, which no n fulfils if p is negative."""
        low = pos // 100 * least + -(-(pos % 100) * least // 100)
        return ~same & (pos >= 0) & (score <= pos) & (score >= low)

    found = firsts(candidates(table, anchors, pos, primes, width, negatives, inside), negatives)
    pairs = spark.createDataFrame(pa.table({
        "slot": slot * positives + place - 1, "anchor_id": anchors["vec_id"].take(pa.array(slot)),
        "positive_id": near["vec_id"], "positive_score": score}))
    return found.join(F.broadcast(pairs), "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
