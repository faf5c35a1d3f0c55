"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words, each followed by a blank, then an end mark. Each byte
is coded as the bits of a prefix code, one for each byte before it. The predictors of a
bit know how often each byte followed the last ``LEAST`` to ``ORDER`` bytes in the training texts: a context is a
64-bit hash of these bytes, and its frozen counts give a logit for each bit. A mixer
adds the predictors' logits with weights; the set of weights is gated by the longest
context that is known. After each byte the weights move down the gradient of its bits'
coding cost. A probability map, indexed by the mixed logit, refines the result and is
moved toward the bits, too. Weights and map start anew every ``PIECE`` bytes of a text;
contexts go on. Each probability thus depends on training texts and earlier bytes
alone, so the code lengths belong to one distribution over all texts.

Counts of contexts and words are a table that grows with the training texts. A bounded
number of the most frequent ones goes to all tasks. Documents are dealt into groups of
bounded size; a group asks for all its other contexts and words and meets the answers
in one task. So the whole table never passes through the driver, and nothing is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import kept
from corpusloom.llm.words import U, column_bytes, groups_of, hash_words, mix

LEAST, ORDER = 3, 5
# Bytes of text in a group, in the arrays of one step and of the mixing, and until weights start anew.
GROUP_BYTES = 16 << 20
CHUNK_BYTES, MIXED_BYTES = 3 << 19, 3 << 20
PIECE = 1024
# The most frequent words and contexts, sent to all tasks: 16 bytes a word, 12 for each
# byte after a context, of which there are 256 at most and a few as a rule.
HOT_WORDS, HOT_CONTEXTS = 1 << 18, 1 << 16
# Bytes of text that one task counts before its counts are shuffled.
TASK_BYTES = 128 << 20
BLANK, END = b" ", b"\n"
# Lower-cases A-Z; every separator becomes a blank.
NORMAL = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
# Counts that each bit has before any is seen; logits come in steps of 1 / LOGIT.
PRIOR, LOGIT = 0.1, 16
RATE, MAP_RATE, MAP_CELLS, MAP_EDGE = 0.0005, 0.02, 33, 12.0
INPUTS = ORDER + 1 - LEAST
# What the rows of the count tables and requests are about.
WORD, CONTEXT = 0, 1
UNKNOWN = -128
# Codes whose inputs are worked out at once.
SLICE = 1 << 16
# Steps of all pieces that are read from memory at once.
AHEAD = 16


def first_weights() -> np.ndarray:
    """Of each gate, the longest known order or 0: the weights of all orders."""
    out = np.zeros((ORDER + 1, INPUTS), np.float32)
    for gate in range(LEAST, ORDER + 1):
        for k in range(LEAST, gate + 1):
            out[gate, k - LEAST] = (0.8, 0.3, 0.05)[min(gate - k, 2)]
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def normal(text: bytes | None) -> bytes:
    """Lower-cased words, a blank after each."""
    words = (text or b"").translate(NORMAL).strip(BLANK)
    while BLANK * 2 in words:
        words = words.replace(BLANK * 2, BLANK)
    return words + BLANK if words else b""


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of normal texts: each coded byte with the ``ORDER`` bytes before it as one number,
    and the bounds of each text. End marks stand before a text's first byte.
    """
    parts = [END * ORDER + t + END for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    n = max(int(sizes.sum()) - ORDER, 0)
    # Eight bytes from each place on, as one number, and of these the first ones.
    data = b"".join([*parts, bytes(7 - ORDER)])
    codes = np.ndarray(n, ">u8", data, strides=(1,)).astype(U)
    codes >>= U(56 - 8 * ORDER)
    first = np.cumsum(sizes) - sizes
    whole = np.ones(n, bool)
    for j in range(ORDER):  # numbers that run over from one text into the next
        whole[(first[1:] - 1 - j)] = False
    return codes[whole], np.r_[0, np.cumsum(sizes - ORDER)]


def pairs_of(codes: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes and the byte itself."""
    return codes & U(256 ** (order + 1) - 1)


def last_two(codes: np.ndarray) -> np.ndarray:
    """The byte before and the byte itself: which code, and which of its leaves."""
    return (codes & U(0xFFFF)).astype(np.int64)


def context_keys(pairs: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of a context, one-to-one on its order and bytes."""
    with np.errstate(over="ignore"):
        return mix((pairs >> U(8)) | U(order << 56)).view(np.int64)


def distinct(*keys: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    key = np.sort(np.concatenate(keys))
    return key[np.r_[True, key[1:] != key[:-1]]] if key.size else key


def finder(known: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of values that the sorted distinct ``known`` has: where each of them is.

    A table of slots names one place for each, a second one a place that lost its slot;
    only those that lost both are searched.
    """
    probes, rest = [], np.arange(known.size, dtype=np.int32)

    def slots(values, factor, bits):
        with np.errstate(over="ignore"):
            return ((values.view(U) * factor) >> U(64 - bits)).view(np.int64)

    for factor in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
        bits = max(rest.size, 2).bit_length() + 2
        table, slot = np.zeros(1 << bits, np.int32), slots(known[rest], factor, bits)
        table[slot] = rest
        probes.append((table, factor, bits))
        rest = rest[table[slot] != rest]

    def find(asked):
        (table, *way), (other, *way_again) = probes
        at = table[slots(asked, *way)]
        wrong = np.flatnonzero(known[at] != asked)
        again = asked[wrong]
        found = other[slots(again, *way_again)]
        lost = np.flatnonzero(known[found] != again)
        found[lost] = np.searchsorted(known, again[lost])
        at[wrong] = found
        return at

    return find


def places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each of ``asked`` is in the sorted distinct ``known``, which has them all."""
    return finder(known)(asked)


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    own = distinct(*keys)
    sums = np.zeros(own.size, np.int64)
    for key, n in zip(keys, counts):
        sums += np.bincount(places(own, key), weights=n, minlength=own.size).astype(np.int64)
    return own, sums


def packed(texts: list[bytes | None]):
    import pyarrow as pa

    return pa.array([None if t is None else pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())


def unpacked(column, sizes) -> list[bytes]:
    import pyarrow as pa

    return [b"" if t is None else pa.decompress(t, n, "zstd", asbytes=True)
            for t, n in zip(column.to_pylist(), sizes.to_pylist())]


COUNTS = "kind int, key long, byte int, n long"


def counted(groups: DataFrame) -> DataFrame:
    """(text, n_bytes) → kind, key, counts, total: how often each word, and each byte after a
    context, occurs. A word has one count, of byte 0. ``byte`` holds the last byte of the
    context, too, as 256 times its value.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], CONTEXT: []}

        def fold(kind):
            held[kind] = [tally(*map(list, zip(*held[kind])))] if held[kind] else []

        def rows(kind, key, byte, n):
            for a in range(0, key.size, 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(key[part].size, kind, np.int32)), pa.array(key[part]),
                     pa.array(byte[part].astype(np.int32)), pa.array(n[part])],
                    names=[f.split()[0] for f in COUNTS.split(", ")])

        for batch in batches:
            for own in chunks(unpacked(batch.column("text"), batch.column("n_bytes"))):
                for kind, found in ((WORD, hash_words(own).hashes[0]), (CONTEXT, coded(own)[0])):
                    if found.size:
                        held[kind].append(np.unique(found, return_counts=True))
                    if len(held[kind]) > 16:
                        fold(kind)
        for kind in held:
            fold(kind)
            for key, n in held[kind]:
                if kind == WORD:
                    yield from rows(kind, key.view(np.int64), np.zeros(key.size), n)
                    continue
                for order in range(LEAST, ORDER + 1):
                    pairs, sums = tally([pairs_of(key, order)], [n])
                    yield from rows(kind, context_keys(pairs, order), last_two(pairs), sums)

    # A task's rows are distinct, so they are dealt by key at once, which serves both groupings.
    dealt = groups.select("text", "n_bytes").mapInArrow(run, COUNTS).repartition("kind", "key")
    return dealt.groupBy("kind", "key", "byte").agg(F.sum("n").alias("n")).groupBy("kind", "key").agg(
        F.collect_list(F.struct("byte", "n")).alias("counts"), F.sum("n").alias("total"))


class Code(NamedTuple):
    """A prefix code of all bytes for each byte before. The leaves stand in a row; a node is a range of it.

    Of each two bytes (``last_two``): how many bits the second one has, and for each of
    them the ``low``, ``mid`` and ``high`` of the node where it is decided. ``leaf`` is its place.
    """

    bits: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    mid: np.ndarray
    high: np.ndarray


def prefix_codes(counts: np.ndarray) -> Code:
    """Huffman's code for each row of ``counts`` (byte before, byte).

    Rare bytes count as 1 in 2**12 at least, which bounds its depth. Bytes that
    nothing is known of follow a code of their own, of all counts together.
    """
    whole = counts.sum(0)
    parts = [huffman(row if row.any() else whole) for row in counts]
    depth = max(p[2].shape[2] for p in parts)
    nodes = np.zeros((3, 256 * 256, depth), np.int16)
    for i, (_, _, own) in enumerate(parts):
        nodes[:, i * 256:(i + 1) * 256, :own.shape[2]] = own
    return Code(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), *nodes)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits and leaf of each byte, and its nodes (low, mid, high)."""
    weight = np.maximum(counts, 1 + (int(counts.sum()) >> 12)).tolist()
    heap = [(weight[b], b, (b,)) for b in range(256)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, i, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, i, (a, b)))
    paths: dict[int, list[list[int]]] = {}
    leaf = np.zeros(256, np.int64)

    def walk(node, start, path) -> int:
        if len(node) == 1:
            leaf[node[0]], paths[node[0]] = start, path
            return start + 1
        own = [start, 0, 0]
        own[1] = walk(node[0], start, [*path, own])
        own[2] = walk(node[1], own[1], [*path, own])
        return own[2]

    walk(heap[0][2], 0, [])
    bits = np.array([len(paths[b]) for b in range(256)])
    nodes = np.zeros((3, 256, bits.max()), np.int16)
    for b, path in paths.items():
        nodes[:, b, :len(path)] = np.array(path).T
    return bits, leaf, nodes


def order_logits(pairs: np.ndarray, order: int, table: dict, code: Code) -> np.ndarray:
    """Of each (context, byte) pair and bit of the byte: the logit of a one in steps of
    1 / ``LOGIT``; ``UNKNOWN`` if the context has never seen the node of this bit.
    """
    depth = code.low.shape[1]
    out = np.full((pairs.size, depth), UNKNOWN, np.int8)
    keys = context_keys(pairs, order)
    at = np.searchsorted(table["key"], keys)
    at[at == table["key"].size] = 0
    known = np.flatnonzero(table["key"][at] == keys) if table["key"].size else at[:0]
    # In the order of the table: neighbouring look-ups then read neighbouring counts.
    known = known[np.argsort(at[known])]
    entry, byte = at[known], last_two(pairs[known])

    def before(place):
        return table["sums"][np.searchsorted(table["cell"], place)]

    edge = before(np.arange(table["key"].size + 1) * 256)
    low, high = edge[entry], edge[entry + 1]
    entry = entry * 256
    for d in range(depth):
        mine = code.bits[byte] > d
        known, entry, byte, low, high = (x[mine] for x in (known, entry, byte, low, high))
        mid = before(entry + code.mid[byte, d])
        logit = np.log((high - mid + PRIOR) / (mid - low + PRIOR)) * LOGIT
        out[known, d] = np.where(high > low, np.clip(np.rint(logit), -127, 127), UNKNOWN)
        one = code.leaf[byte] >= code.mid[byte, d]
        low, high = np.where(one, mid, low), np.where(one, high, mid)
    return out


def inputs_of(codes: np.ndarray, table: dict, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Four small numbers of each bit of distinct ``codes``: all orders' logits, and the bit with
    twice the gate. They come as one 32-bit number each, with the first of each code.
    """
    byte = last_two(codes)
    n = code.bits[byte]
    first = np.cumsum(n) - n
    out = np.zeros((n.sum(), INPUTS + 1), np.int8)
    logits, at = [], []
    for order in range(LEAST, ORDER + 1):
        pairs = distinct(pairs_of(codes, order))
        at.append(places(pairs, pairs_of(codes, order)))
        logits.append(order_logits(pairs, order, table, code))
    for a in range(0, codes.size, SLICE):
        part = slice(a, a + SLICE)
        row = np.repeat(np.arange(n[part].size), n[part])
        base = first[a]
        d = np.arange(row.size) - (first[part] - base)[row]
        own = out[base:base + row.size]
        gate = np.zeros(n[part].size, np.int8)
        for i in range(INPUTS):
            logit = logits[i][at[i][part][row], d]
            own[:, i] = np.where(logit != UNKNOWN, logit, 0)
            gate[logits[i][at[i][part], 0] != UNKNOWN] = LEAST + i
        own[:, INPUTS] = code.leaf[byte[part]][row] >= code.mid[byte[part]][row, d]
        own[:, INPUTS] += 2 * gate[row]
    return out.view(np.int32).ravel(), first


def heads_of(codes: np.ndarray, first: np.ndarray, code: Code) -> np.ndarray:
    """Of distinct ``codes`` one number each: the first of its inputs, then in the last 8 bits
    by how many its bits are fewer than the most that a byte has.
    """
    return (first << 8) | (code.low.shape[1] - code.bits[last_two(codes)])


def mixed_cost(inputs: np.ndarray, heads: np.ndarray, depth: int, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Nats that each piece costs. Pieces start at ``starts`` of ``heads``; longest ones first.

    All pieces advance side by side, a byte in a step: those of most bits come first, so that
    the bytes that have a bit d are the first ones. All first bits of a step come first, then
    all second ones, and so on.
    """
    lanes = starts.size
    # Three weights, and a fourth that is not used: 16 bytes, looked up as one number.
    weights = np.zeros((lanes, ORDER + 1, INPUTS + 1), np.float32)
    weights[:, :, :INPUTS] = first_weights() / LOGIT
    weights = weights.view(np.complex128).ravel()
    grid = np.linspace(-MAP_EDGE, MAP_EDGE, MAP_CELLS)
    cells = np.tile((1 / (1 + np.exp(-grid))).astype(np.float32), lanes)
    pieces, spent = [], []
    rate, map_rate, edge = np.float32(RATE / LOGIT), np.float32(MAP_RATE), np.float32(MAP_EDGE)
    per_cell = np.float32((MAP_CELLS - 1) / (2 * MAP_EDGE))
    middle, half = np.float32((MAP_CELLS - 1) / 2 + 0.5), np.float32(0.5)
    lane, bits = np.arange(lanes), np.arange(depth)
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    for t, n in enumerate(active.tolist()):
        if t % AHEAD == 0:
            ahead = heads.take(starts[:n, None] + np.arange(t, t + AHEAD), mode="clip").T.copy()
        head = ahead[t % AHEAD, :n]
        fewer = (head & 255).astype(np.uint8)
        piece = fewer.argsort(kind="stable")
        sizes = np.bincount(fewer, minlength=depth)[:depth].cumsum()[::-1]
        at = np.repeat(bits, sizes)
        sizes = [m for m in sizes.tolist() if m]
        byte = np.concatenate([lane[:m] for m in sizes])
        at += (head.take(piece) >> 8).take(byte)
        v = inputs.take(at).view(np.int8).reshape(-1, INPUTS + 1)
        x = v.T[:INPUTS].astype(np.float32, order="C")
        bit = (v[:, INPUTS] & 1).astype(np.float32)
        own = piece * (ORDER + 1) + (v[:n, INPUTS] >> 1)
        w = weights.take(own)
        logit = (x * w.take(byte).view(np.float32).reshape(-1, INPUTS + 1).T[:INPUTS]).sum(0)
        logit.clip(-edge, edge, out=logit)
        p = 1 / (1 + np.exp(-logit))
        logit *= per_cell
        logit += middle
        cell = logit.astype(np.int64)
        cell += (piece * MAP_CELLS).take(byte)
        mapped = cells.take(cell)
        # The last column: what the bit costs, so that one loop adds up all of a byte.
        moves = np.empty((at.size, INPUTS + 1), np.float32)
        np.multiply(x, (bit - p) * rate, out=moves.T[:INPUTS])
        p += mapped
        p *= half
        loss = 1 - bit
        loss -= p
        np.abs(loss, out=loss)
        moves[:, INPUTS] = np.log(loss, out=loss)
        bit -= mapped
        bit *= map_rate
        cells[cell] = mapped + bit
        sums, moves, first = np.zeros(n * (INPUTS + 1), np.float32), moves.ravel(), 0
        for m in sizes:
            m *= INPUTS + 1
            sums[:m] += moves[first:first + m]
            first += m
        pieces.append(piece)
        spent.append(sums[INPUTS::INPUTS + 1].copy())
        w = w.view(np.float32)
        w += sums
        weights[own] = w.view(np.complex128)
    return -np.bincount(np.concatenate(pieces), np.concatenate(spent), lanes)


def chunk_bits(texts: list[bytes], inputs: np.ndarray, heads: np.ndarray, find: Callable, code: Code) -> np.ndarray:
    """Bits of each of some normal texts. ``find`` tells which of ``heads`` a code has."""
    codes, bounds = coded(texts)
    starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(bounds[:-1], bounds[1:])])
    length = np.diff(np.r_[starts, bounds[-1]])
    lane = np.argsort(-length, kind="stable")
    own = heads[find(codes)]
    cost = np.empty(lane.size)
    cost[lane] = mixed_cost(inputs, own, code.low.shape[1], starts[lane], length[lane]) / np.log(2)
    return np.bincount(np.searchsorted(bounds, starts, side="right") - 1, weights=cost, minlength=len(texts))


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    for part in groups_of(texts, size):
        yield [normal(texts[i]) for i in part]


def grouped(docs: DataFrame, group_bytes: int) -> DataFrame:
    """doc_id, text, held, n_bytes, grp: neighbouring rows of about ``group_bytes`` have one number.

    The text is compressed, since it is shuffled; ``n_bytes`` is its own size.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        # At most 2**40 groups in a task.
        group, size = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts = column_bytes(batch, "text")
            n = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
            before = size + np.cumsum(n) - n
            size += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), packed(texts), batch.column("held"), pa.array(n),
                 pa.array(group + before // group_bytes)], names=[f.split()[0] for f in GROUPS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"),
                       held_out(F.col("doc_id")).alias("held"))
    return rows.mapInArrow(run, GROUPS)


GROUPS = "doc_id long, text binary, held boolean, n_bytes long, grp long"


class Answers(NamedTuple):
    """Entries of the count table: of each its ``size`` counts, one entry after the other."""

    kind: np.ndarray
    key: np.ndarray
    size: np.ndarray
    byte: np.ndarray
    n: np.ndarray


def answers_of(table) -> Answers:
    """From an Arrow table (kind, key, counts)."""
    import pyarrow as pa

    lists = table["counts"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("counts").type)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    byte, n = (np.asarray(lists.values.field(c))[offsets[0]:offsets[-1]] for c in ("byte", "n"))
    return Answers(table["kind"].to_numpy().astype(np.int8), table["key"].to_numpy(),
                   np.diff(offsets).astype(np.int32), byte.astype(np.uint16), n)


def lookup_tables(parts: list[Answers], code: Code) -> tuple[dict, np.ndarray, np.ndarray]:
    """The context table of ``order_logits``, sorted word keys and their counts. Entries may repeat."""
    kind, key, size, byte, n = (np.concatenate(x) for x in zip(*parts))
    at = np.cumsum(size, dtype=np.int64) - size
    order = np.lexsort((key, kind))
    new = (key[order][1:] != key[order][:-1]) | (kind[order][1:] != kind[order][:-1])
    order = order[np.r_[True, new]] if order.size else order
    cut = int(np.searchsorted(kind[order], CONTEXT))
    words, contexts = order[:cut], order[cut:]
    sizes = size[contexts].astype(np.int64)
    ends = np.cumsum(sizes)
    rank = np.repeat(np.arange(contexts.size), sizes)
    place = np.arange(rank.size) + (at[contexts] - (ends - sizes))[rank]
    cell = rank * 256 + code.leaf[byte[place]]
    by_cell = np.argsort(cell)
    table = {"key": key[contexts], "cell": cell[by_cell], "sums": np.r_[0, np.cumsum(n[place][by_cell])]}
    return table, key[words], n[at[words]]


def requests(groups: DataFrame, hot) -> DataFrame:
    """(grp, kind, key): the words and contexts of each group that the broadcast ``hot`` has not.

    Each once for a group that one task reads, as a rule; a few may repeat.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: dict[int, list[np.ndarray]] = {WORD: [], CONTEXT: []}
        now = None

        def answer():
            for kind, keys in held.items():
                if not keys:
                    continue
                own = distinct(*keys)
                if kind == WORD:
                    asked = [own.view(np.int64)]
                else:
                    asked = [context_keys(distinct(pairs_of(own, k) >> U(8)) << U(8), k) for k in range(LEAST, ORDER + 1)]
                common = np.sort(hot.value.key[hot.value.kind == kind])
                for key in asked:
                    key = np.setdiff1d(key, common, assume_unique=True)
                    for a in range(0, key.size, 50_000):
                        part = key[a:a + 50_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(part.size, now)), pa.array(np.full(part.size, kind, np.int32)),
                             pa.array(part)], names=["grp", "kind", "key"])
                keys.clear()

        for batch in batches:
            values = unpacked(batch.column("text"), batch.column("n_bytes"))
            numbers = batch.column("grp").to_numpy()
            turns = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, numbers.size]
            for a, b in zip(turns[:-1], turns[1:]):
                if a < b and numbers[a] != now:
                    yield from answer()
                    now = int(numbers[a])
                for own in chunks(values[a:b]):
                    held[WORD].append(distinct(hash_words(own).hashes[0]))
                    held[CONTEXT].append(distinct(coded(own)[0]))
                    for kind in held:
                        if len(held[kind]) > 16:
                            held[kind] = [distinct(*held[kind])]
        yield from answer()

    return groups.mapInArrow(run, "grp long, kind int, key long")


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, words_log10 double, n_bytes long, "
          "bits double")


def scorer(codes, hot):
    """A function of a group's documents and the answers to its requests, beside what was broadcast."""

    def score(docs, answers):
        import pyarrow as pa

        code = codes.value
        table, word_keys, word_n = lookup_tables([hot.value, answers_of(answers)], code)
        texts = unpacked(docs["text"], docs["n_bytes"])
        own_codes = []
        for own in chunks(texts):
            own_codes.append(distinct(coded(own)[0]))
        known = distinct(*own_codes)
        del own_codes
        inputs, first = inputs_of(known, table, code)
        heads, find = heads_of(known, first, code), finder(known)
        out = []
        for own in chunks(texts, MIXED_BYTES):
            found = hash_words(own)
            keys = found.hashes[0].view(np.int64)
            at = np.minimum(np.searchsorted(word_keys, keys), max(word_keys.size - 1, 0))
            c = np.where(word_keys[at] == keys, word_n[at], 0) if word_keys.size else np.zeros(keys.size, np.int64)
            text = np.repeat(np.arange(len(own)), np.diff(found.offsets))
            out.append((np.diff(found.offsets) + 1, np.bincount(text, weights=c > 0, minlength=len(own)),
                        np.bincount(text, weights=np.log10(c + 0.5), minlength=len(own)),
                        np.fromiter(map(len, own), np.int64, len(own)) + 1,
                        chunk_bits(own, inputs, heads, find, code)))
        tokens, seen, logs, size, bits = (np.concatenate(x) for x in zip(*out))
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held"], "n_tokens": tokens,
            "n_known": seen.astype(np.int64), "words_log10": logs, "n_bytes": size, "bits": bits})

    return score


def scored_documents(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents (doc_id, text) → doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes, bits_per_byte.

    Tokens are the lower-cased words and one end mark. Trained on the documents that
    ``held_out`` does not name, all scored, whole texts. ``base_score`` is the log10
    probability of the tokens by their counts, each with half a count more, and a
    token of no count. ``score`` is the mixed model's log10 probability of words and
    end mark; ``n_bytes`` are what it codes. Null and blank texts have only the end
    mark. Repeated rows count each. Without training texts no token is known, and
    every bit costs about 1. A text is held whole by one task.
    """
    groups = kept(grouped(docs, group_bytes), "lm-groups")
    train = groups.where(~F.col("held"))
    size, ends = train.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    table = kept(counted(train.coalesce(max(cores, -(-size // TASK_BYTES)))), "lm-counts")
    words, contexts = (table.where(F.col("kind") == k) for k in (WORD, CONTEXT))
    kinds, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    total, kinds = total + ends, kinds + (ends > 0)
    seen = contexts.select(F.explode("counts").alias("c")).groupBy("c.byte").agg(F.sum("c.n").alias("n"))
    # Each coded byte was counted once for each order.
    pairs = np.zeros(256 * 256, np.int64)
    for r in seen.collect():
        pairs[r["byte"]] = r["n"] // INPUTS
    code = prefix_codes(pairs.reshape(256, 256))
    first = lambda df, n: df.orderBy(F.desc("total"), "key").limit(n).select("kind", "key", "counts")
    hot = docs.sparkSession.sparkContext.broadcast(
        answers_of(first(words, HOT_WORDS).union(first(contexts, HOT_CONTEXTS)).toArrow()))
    codes = docs.sparkSession.sparkContext.broadcast(code)
    answers = requests(groups, hot).join(table, ["kind", "key"]).select("grp", "kind", "key", "counts")
    scored = groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(scorer(codes, hot), SCORED)
    base = F.col("words_log10") + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(
        float(np.log10(total + 0.5 * (kinds + 1))))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2.0)))).alias("score"), "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
