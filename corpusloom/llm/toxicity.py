"""Toxicity by classifier chains: each category's linear model sees the earlier ones' probabilities.

In training, the probabilities that a later model sees are out-of-fold: they come
from models that were not fitted on the document, as in prediction. Features are
the hashed words of a text and the first bytes of its longer words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import PUNCTUATION, U, column_bytes, constants, groups_of, hash_words, mix

DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6)
# The classifier is fitted on at most so many labelled rows, those of the smallest id hashes.
TRAIN_ROWS = 12_000
FEATURES = 3000
FOLDS = 3
STEPS = 200
RIDGE = 1e-4


class Link(NamedTuple):
    """A model of the chain: its features, their weights, those of earlier categories, intercept."""

    category: str
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


def text_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words and word starts of ``texts``, with repeats."""
    words = hash_words(texts, fold=True, separators=PUNCTUATION)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    raw = np.frombuffer(words.data, np.uint8)
    length = words.ends - words.starts
    shift = U(64 - int(DIMENSIONS).bit_length() + 1)
    rows, found = [owner], [words.hashes[0] >> shift]
    for k in PREFIXES:
        long = np.flatnonzero(length > k)
        code = np.full(long.size, k, U)
        for i in range(k):
            byte = raw[words.starts[long] + i]
            byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
            code = (code << U(8)) | byte.astype(U)
        with np.errstate(over="ignore"):
            found.append(mix(code * constants(1, 31)[0]) >> shift)
        rows.append(owner[long])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_logistic(rows: np.ndarray, columns: np.ndarray, size: int, dense: np.ndarray,
                 y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression: ``size`` sparse ones, dense ones, intercept.

    Accelerated gradient steps over the rows in ``use``; the sparse entries are 1.
    Each weight has its own step, the inverse of a bound of the curvature along it,
    so rare words move as fast as common ones.
    """
    n, extra = use.sum(), dense.shape[1]
    inside = use[rows]
    r, c = rows[inside], columns[inside]
    dense = np.where(use[:, None], dense, 0)
    load = np.where(use, np.bincount(r, minlength=y.size) + np.abs(dense).sum(1) + 1, 0)
    curvature = np.concatenate([
        np.bincount(c, weights=load[r], minlength=size), np.abs(dense).T @ load, [load.sum()]]) / (4 * n)
    ridge = np.full(size + extra + 1, RIDGE)
    ridge[-1] = 0
    rate = 1 / np.maximum(curvature + ridge, 1e-12)
    w = np.zeros(size + extra + 1)
    ahead, speed = w, 1.0
    for _ in range(STEPS):
        z = np.bincount(r, weights=ahead[c], minlength=y.size) + dense @ ahead[size:-1] + ahead[-1]
        error = np.where(use, sigmoid(z) - y, 0) / n
        grad = np.concatenate([np.bincount(c, weights=error[r], minlength=size), error @ dense, [error.sum()]])
        grad += ridge * ahead
        step = ahead - rate * grad
        if grad @ (step - w) > 0:  # overshot: start the momentum anew
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead = step + (speed - 1) / faster * (step - w)
        w, speed = step, faster
    return w


def fit_chain(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, fold: np.ndarray,
              names: list[str]) -> list[Link]:
    """The chain over distinct (row, feature) entries; ``labels`` has a column a category."""
    chain: list[Link] = []
    earlier = np.zeros((len(fold), 0))
    everything = np.ones(len(fold), bool)
    for k, name in enumerate(names):
        y = labels[:, k].astype(float)
        positive, negative = y.sum(), (1 - y).sum()
        if not positive or not negative:
            chain.append(Link(name, np.zeros(0, np.int64), np.zeros(0), np.zeros(k),
                              40.0 if positive else -40.0))
            earlier = np.column_stack([earlier, logit(y)])
            continue
        # Features whose document frequency differs most between the classes.
        hits = np.bincount(columns, weights=y[rows], minlength=DIMENSIONS)
        all_hits = np.bincount(columns, minlength=DIMENSIONS)
        share = all_hits / len(y)
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / positive + 1 / negative))
        z = np.abs(hits / positive - (all_hits - hits) / negative) / spread
        chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
        chosen = chosen[all_hits[chosen] >= 3]
        slot = np.full(DIMENSIONS, -1)
        slot[chosen] = np.arange(chosen.size)
        has = slot[columns] >= 0
        r, c = rows[has], slot[columns[has]]

        def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = fit_logistic(r, c, chosen.size, earlier, y, use)
            z = np.bincount(r, weights=w[c], minlength=y.size) + earlier @ w[chosen.size:-1] + w[-1]
            return w, sigmoid(z)

        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            unseen[fold == f] = fitted(fold != f)[1][fold == f]
        w, _ = fitted(everything)
        chain.append(Link(name, chosen, w[:chosen.size], w[chosen.size:-1], float(w[-1])))
        earlier = np.column_stack([earlier, logit(unseen)])
    return chain


def predict(chain: list[Link], texts: list[bytes | None]) -> np.ndarray:
    """Probabilities (text, category)."""
    rows, columns = text_features(texts)
    out = np.zeros((len(texts), len(chain)))
    slot = np.zeros(DIMENSIONS, bool)
    for link in chain:
        slot[link.features] = True
    has = slot[columns]
    entries = np.unique(rows[has] * DIMENSIONS + columns[has])
    rows, columns = entries // DIMENSIONS, entries % DIMENSIONS
    earlier = np.zeros((len(texts), 0))
    for k, link in enumerate(chain):
        weight = np.zeros(DIMENSIONS)
        weight[link.features] = link.weights
        z = np.bincount(rows, weights=weight[columns], minlength=len(texts))
        out[:, k] = sigmoid(z + earlier @ link.earlier + link.intercept)
        earlier = np.column_stack([earlier, logit(out[:, k])])
    return out


SAMPLE = "fold int, labels array<int>, features array<int>"


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
          train_rows: int = TRAIN_ROWS) -> list[Link]:
    """Fit the chain on at most ``train_rows`` labelled documents, whole texts.

    ``categories`` gives each category's 0/1 label as an expression over ``labels``;
    rows with a null label are not used. The sample and the model, at most
    ``FEATURES`` weights a category, are the only things that meet in one place.
    """
    names = list(categories)
    marks = labels.select("doc_id", F.array(*[c.cast("int") for c in categories.values()]).alias("labels"))
    marks = marks.where(F.col("doc_id").isNotNull() & ~F.exists("labels", lambda x: x.isNull()))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "labels").limit(train_rows)
    # Bounded by train_rows.
    chosen = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(
        F.broadcast(sample), "doc_id").select(
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "labels", "text")

    def featurize(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = column_bytes(batch, "text")
            for part in groups_of(texts, 2 << 20):
                rows, columns = text_features([texts[i] for i in part])
                entries = np.unique(rows * DIMENSIONS + columns)
                cuts = np.searchsorted(entries, np.arange(1, len(part)) * DIMENSIONS)
                each = np.split((entries % DIMENSIONS).astype(np.int32), cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fold").slice(part.start, len(part)),
                     batch.column("labels").slice(part.start, len(part)),
                     pa.array(each, pa.list_(pa.int32()))], names=["fold", "labels", "features"])

    def fit(batches) -> Iterator:
        import pyarrow as pa

        fold, marked, sizes, columns = [], [], [], []
        for batch in batches:
            fold += batch.column("fold").to_pylist()
            marked += batch.column("labels").to_pylist()
            lists = batch.column("features")
            sizes += lists.value_lengths().to_pylist()
            columns.append(lists.flatten().to_numpy())
        if not fold:
            return
        rows = np.repeat(np.arange(len(fold), dtype=np.int32), sizes)
        chain = fit_chain(rows, np.concatenate(columns), np.array(marked), np.array(fold), names)
        for k, link in enumerate(chain):
            kind = ["feature"] * link.features.size + ["earlier"] * link.earlier.size + ["intercept"]
            at = [*link.features.tolist(), *range(link.earlier.size), 0]
            weight = [*link.weights.tolist(), *link.earlier.tolist(), link.intercept]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(at), pa.int32()), pa.array(kind), pa.array(at, pa.int64()),
                 pa.array(weight, pa.float64())], names=["k", "kind", "at", "weight"])

    fitted = chosen.mapInArrow(featurize, SAMPLE).repartition(1).mapInArrow(
        fit, "k int, kind string, at long, weight double").toPandas()
    chain = []
    for k, name in enumerate(names):
        own = fitted[fitted["k"] == k].sort_values("at")
        part = {kind: own[own["kind"] == kind] for kind in ("feature", "earlier", "intercept")}
        intercept = part["intercept"]["weight"]
        chain.append(Link(
            name, part["feature"]["at"].to_numpy(np.int64), part["feature"]["weight"].to_numpy(),
            part["earlier"]["weight"].to_numpy() if len(own) else np.zeros(k),
            float(intercept.iloc[0]) if len(intercept) else -40.0))
    return chain


def scored_documents(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
                     threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Documents → doc_id, p_<category> for each, and <category> for the last of the chain.

    Whole texts are scored. Null texts and texts without a word have probability 0
    in every category. Without labelled rows nothing is predicted. Repeated rows are
    scored each; a label of a repeated id counts once for each text.
    """
    chain = train(docs, labels, categories, train_rows)
    names = list(categories)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"p_{name} double" for name in names))
    def score(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        out = np.zeros((len(values), len(names)))
        for part in groups_of(values, 2 << 20):
            own = [values[i] for i in part]
            worded = np.fromiter(
                (bool(t) and any(not PUNCTUATION[b] for b in t) for t in own), bool, len(own))
            out[part.start:part.stop] = predict(shared.value, own) * worded[:, None]
        return pd.DataFrame(out, columns=[f"p_{name}" for name in names])

    scored = docs.select("doc_id", score(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")
    return scored.withColumn(names[-1], F.col(f"p_{names[-1]}") >= threshold)
