"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has ``bands * rows`` coordinates. In round after round every shingle is
hashed to one bin with a value, and a bin keeps the smallest value of the first
round that reaches it; from round ``bins`` on, round i sends all shingles to bin
``i - bins``. So every coordinate is filled, two sketches agree in a coordinate
with the probability of the sets' similarity, and the agreements concentrate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import components, kept, maybe_among
from corpusloom.llm.words import U, column_bytes, constants, groups_of, hash_words, mix, shingles

SHINGLE = 4
PERCENT = 80
ROWS = 6
BANDS = 50
# Members compared with each other in one task; larger buckets are dealt over several.
BLOCK = 256
EMPTY = U(2**64 - 1)


def fast_similarity_sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a non-empty set of hashes: ``bins`` values, all of them filled."""
    salt = constants(2 * bins, 3)
    out = np.full(bins, EMPTY, U)
    step = max(1, 2048 // items.size)
    low = U(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for first in range(0, bins, step):
            rounds = np.arange(first, min(bins, first + step))
            x = mix(items[None, :] * salt[rounds][:, None])
            at = ((x >> U(32)) * U(bins)) >> U(32)
            value = (x & low) | (rounds.astype(U) << U(32))[:, None]
            np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
            if not (out == EMPTY).any():
                return out
        for i in np.flatnonzero(out == EMPTY):
            x = mix(items * salt[bins + i])
            out[i] = (x & low).min() | (U(bins + i) << U(32))
    return out


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salted = sketch.reshape(bands, rows) * constants(rows, 5)[None, :]
        return mix(salted.sum(1, dtype=U) + constants(bands, 6))


def set_key(items: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    with np.errstate(over="ignore"):
        pair = [mix(items * c).sum(dtype=U) for c in constants(2, 8)]
    return tuple(int(x.astype(np.int64)) for x in pair)


SKETCHED = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"


def sketched(docs: DataFrame, words: int = SHINGLE, rows: int = ROWS,
             bands: int = BANDS) -> DataFrame:
    """One row per document: set size, set key and band keys (null for an empty set)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column("doc_id")
            for part in groups_of(texts):
                found = hash_words([texts[i] for i in part], fold=True)
                out = []
                for i in range(len(part)):
                    s = shingles(found.of(i), words)
                    if s.size:
                        keys = band_keys(fast_similarity_sketch(s, rows * bands), rows, bands)
                        out.append((s.size, *set_key(s), keys.view(np.int64)))
                    else:
                        out.append((0, None, None, None))
                n, c1, c2, keys = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.start, len(part)), pa.array(n, pa.int64()),
                     pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "c1", "c2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHED)


def buckets(nodes: DataFrame) -> DataFrame:
    """(id, bands) → (bucket, id, n): the distinct member sets of two or more nodes.

    Most keys have one member: keys are counted first, on 8 bytes a row.
    Members that meet in many bands meet in one bucket here: of the buckets with
    the same members one is kept.
    """
    rows = nodes.select("id", F.explode("bands").alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = rows.join(met, "key")
    members = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    one = members.groupBy("n", "first", "x", "y").agg(F.min("key").alias("key"))
    return shared.join(one.select("key", "n"), "key").select(F.col("key").alias("bucket"), "id", "n")


def confirmed_links(docs: DataFrame, members: DataFrame, words: int = SHINGLE,
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between members of a bucket, confirmed on their full shingle sets.

    A bucket is cut into blocks by a hash of the id; each pair of blocks is one
    comparison of at most two blocks' texts, so no task holds a large bucket and
    pairs are never emitted. Of the links of a comparison only a spanning forest
    leaves the task; it joins the same nodes.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("bucket", "id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(
        F.sequence(F.lit(0), blocks - 1))).select(
        "id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "bucket")
    # Texts of documents that are in no bucket are not shuffled.
    member = maybe_among(members.select("id").distinct())
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(
        F.col("text").isNotNull() & member(F.col("id")))
    group = ["bucket", "x", "y"]
    shipped = dealt.join(texts, "id").select(*group, "own", "id", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group)))
            rows = zip(batch.column("own").to_pylist(), batch.column("id").to_pylist(),
                       column_bytes(batch, "text"))
            links = []
            for k, row in zip(keys, rows):
                if k != key:
                    links += forest(held, key, words, percent)
                    held, key = [], k
                held.append(row)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])
        links = forest(held, key, words, percent)
        if links:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*links)], names=["u", "v"])

    return shipped.repartition(tasks, *group).sortWithinPartitions(*group).mapInArrow(
        run, "u long, v long")


def forest(rows: list[tuple[int, int, bytes]], key: tuple, words: int,
           percent: int) -> list[tuple[int, int]]:
    """Spanning links of one comparison: rows are (own block, id, text), key names the blocks."""
    if len(rows) < 2:
        return []
    sets = []
    for part in groups_of([t for *_, t in rows]):
        found = hash_words([rows[i][2] for i in part], fold=True)
        sets += [shingles(found.of(i), words) for i in range(len(part))]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    within = key[1] == key[2]
    side = np.fromiter((own == key[1] for own, *_ in rows), bool, len(rows))
    # An inverted index of the shingles that two or more rows have.
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    runs = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    run_of = np.repeat(np.arange(runs.size), np.diff(np.r_[runs, values.size]))
    lengths = np.diff(np.r_[runs, values.size])
    back = np.argsort(owner, kind="stable")
    own_runs = np.split(run_of[back], np.cumsum(sizes)[:-1])
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(rows)):
        mine = own_runs[i][lengths[own_runs[i]] > 1]
        if not mine.size:
            continue
        first, count = runs[mine], lengths[mine]
        offset = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count)
        shared = np.bincount(owner[offset + np.arange(count.sum())], minlength=len(rows))
        near = 100 * shared >= percent * (sizes + sizes[i] - shared)
        near[:i + 1] = False
        if not within:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((rows[i][1], rows[j][1]))
    return links


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT,
                    rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Documents → doc_id, n_shingles, component_id, kept.

    Documents of equal shingle sets are one node, named by the smallest id; nodes
    are linked if 100 * intersection >= ``percent`` * union. Null, empty and blank
    texts have no shingles and stay alone. Rows that repeat an id are one document
    of several texts: what any of them links, the id links. A row without an id is
    alone, keeps a null component and is kept.
    """
    table = kept(sketched(docs, words, rows, bands), "sketches")
    key = ["c1", "c2", "n_shingles"]
    named = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Aggregated sides of joins are written, so that a class of very many copies is split.
    classes = kept(named.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    nodes = named.join(classes, key).where("doc_id = rep").select(
        F.col("rep").alias("id"), "bands").dropDuplicates(["id", "bands"])
    links = confirmed_links(docs, kept(buckets(nodes), "buckets"), words, percent)
    # An id with several texts belongs to the class of each.
    member = named.select("doc_id", *key).join(classes, key).select("doc_id", "rep")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    extra = member.join(several.select("doc_id"), "doc_id", "left_semi").where("doc_id <> rep")
    found = kept(components(links.union(extra)), "components")
    placed = named.select("doc_id", *key).join(classes, key).join(
        found, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = table.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
