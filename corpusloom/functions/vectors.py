"""Vector expressions (I8) and embedder hooks.

An embedder is a function from an ``array<string>`` Column to an array of
vectors. Column expressions and vectorized UDFs both fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """I8: cosine similarity with 1e-8 added to the denominator."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def udf_embedder(make_encoder: Callable[[], Callable[[list[str]], list[list[float]]]],
                 batch_size: int = 32) -> Embedder:
    """An Arrow-batched embedder that loads its model once per worker task.

    ``make_encoder`` runs on the worker and returns a function that encodes a
    list of texts; it is called with at most ``batch_size`` texts. Rows of a numpy
    array are passed on as they are.
    """
    import pandas as pd

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for rows in batches:
            texts = [t for row in rows for t in row]
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch_size):
                vectors.extend(encoder(texts[i : i + batch_size]))
            out, at = [], 0
            for row in rows:
                out.append(list(vectors[at : at + len(row)]))
                at += len(row)
            yield pd.Series(out)

    # Real annotations (not strings): Spark reads the UDF kind from them.
    encode.__annotations__ = {
        "batches": Iterator[pd.Series],
        "return": Iterator[pd.Series],
    }
    return F.pandas_udf(encode, "array<array<float>>")
