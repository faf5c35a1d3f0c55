"""Packing along a space-filling curve: neighbours on the curve share training sequences.

A document's hashed word counts are projected to a few dimensions. The point's
place on a Hilbert curve through that space is its sort key. Documents are
range-sorted by it, and each range is cut into full sequences in that order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept
from corpusloom.llm.words import U, constants, groups_of, hash_words

LENGTH = 2048
END = 1
DIMENSIONS = 3
BITS = 10
BUCKETS = 256
# Text in one range: many thousand sequences, of which only the last is padded.
RANGE_BYTES = 64 << 20
_ENCODERS: dict[str, object] = {}


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dimensions) below ``2**bits``.

    Gray-code form: axes are exchanged and inverted from the highest bit down,
    then the interleaved bits are Gray-decoded.
    """
    x = points.astype(np.int64).T.copy()
    n = x.shape[0]
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        mask = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(turned, mask, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = high
    while q > 1:
        fix = np.where((x[n - 1] & q) != 0, fix ^ (q - 1), fix)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projection(dimensions: int = DIMENSIONS, buckets: int = BUCKETS) -> np.ndarray:
    """A fixed random matrix with entries +1 and -1."""
    bits = constants(buckets * dimensions, 7) >> U(40)
    return np.where(bits & U(1), 1.0, -1.0).reshape(buckets, dimensions)


def points_of(texts: list[bytes | None], bits: int = BITS) -> np.ndarray:
    """Grid points of texts: unit vectors of hashed word counts, projected.

    A text without words is the middle of the grid.
    """
    out = np.zeros((len(texts), DIMENSIONS))
    matrix = projection()
    for part in groups_of(texts):
        words = hash_words([texts[i] for i in part], fold=True)
        owner = np.repeat(np.arange(len(part)), np.diff(words.offsets))
        bucket = (words.hashes[0] >> U(32)).astype(np.int64) % BUCKETS
        counts = np.bincount(owner * BUCKETS + bucket, minlength=len(part) * BUCKETS)
        vectors = np.sqrt(counts.reshape(len(part), BUCKETS))
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        out[part.start:part.stop] = (vectors / np.maximum(norm, 1)) @ matrix
    cells = 1 << bits
    # A unit vector's projection has a spread of about one; three of them fill the grid.
    return np.clip((out / 6 + 0.5) * cells, 0, cells - 1).astype(np.int64)


def curve_key(text: Column) -> Column:
    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(points_of(texts.tolist())))

    return key(text.cast("binary"))


class Encoder:
    """Token ids of a byte-level vocabulary file, special tokens read as ordinary text.

    Texts of Latin letters go through the rank form of the same vocabulary where it
    lies beside the file, which gives the same ids several times faster.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = None
        self.other = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u2027]|\\s{256}|\\S{512}")
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not self.other.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH,
                     range_bytes: int = RANGE_BYTES, end_id: int = END) -> DataFrame:
    """Documents → pieces of sequences of ``length`` tokens, in curve order.

    Each document is its ids and ``end_id``; null and empty texts are ``end_id``
    alone. A range's documents follow each other without a gap and are cut where a
    sequence is full, so only the last sequence of a range is short. Repeated rows
    are packed each; ties on the curve are ordered by id and text.
    Sequence ids are unique: the range's number in the upper 32 bits. The number of
    ranges follows the bytes of text alone. Keys are written beside the texts, since
    the bounds of the ranges are found in a pass of their own.
    """
    keyed = kept(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "key", curve_key(F.col("text"))), "curve-keys")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    in_order = keyed.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions(
        "key", "doc_id", F.crc32(F.col("text").cast("binary")))

    def pack(batches) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer)
        sequence, offset = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text), end_id], "<u4")
                start = 0
                while start < ids.size:
                    n = min(length - offset, ids.size - start)
                    crc = zlib.crc32(ids[start:start + n].tobytes())
                    rows.append((doc_id, start, n, crc, ids.size, sequence, offset))
                    start += n
                    offset += n
                    if offset == length:
                        sequence, offset = sequence + 1, 0
            if rows:
                names = [f.split()[0] for f in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return in_order.select("doc_id", "text").mapInArrow(pack, PIECES)
