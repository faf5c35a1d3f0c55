"""op11 language-model scores, op12 hard negatives, op13 periodic runs, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import ODD, WORDS, prose

from corpusloom.llm import context_mixing as lm
from corpusloom.llm import hard_negatives as hard
from corpusloom.llm import periodic
from corpusloom.llm.words import hash_words


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op13


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(
                    all(w[x] == w[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(seed):
    rng, w = random.Random(seed), []
    kinds = rng.choice([1, 2, 3, 40])
    while len(w) < rng.choice([10, 90, 300]):
        block = [f"a{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 30))]
        w += block if rng.random() < 0.5 else (block * 9)[:rng.randrange(1, len(block) * 7)]
    return w


def test_runs_of_random_texts_equal_brute_force():
    texts = [periodic_text(seed) for seed in range(250)]
    found = hash_words([" ".join(w).encode() for w in texts], lanes=2)
    got = periodic.runs_of(found.hashes[0], found.offsets, found.hashes[1])
    want = [(s + found.offsets[i], n, q) for i, w in enumerate(texts) for s, n, q in brute_runs(w)]
    assert [tuple(r) for r in got] == want and len(want) > 100


def test_segments_are_stable_and_keep_every_run():
    w = periodic_text(7) + ["once"] + periodic_text(11)
    found = hash_words([" ".join(w).encode()])
    starts, ends = periodic.frequency_split(found.hashes[0], found.offsets)
    for a, b in zip(starts, ends):
        assert b - a >= 24 and min(Counter(w[a:b]).values()) >= 3
    for s, n, _ in brute_runs(w):
        assert any(a <= s and s + n <= b for a, b in zip(starts, ends))


def test_scan_of_a_long_text_is_not_quadratic():
    w = np.tile(np.arange(100_000), 4).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert periodic.runs_of(w, np.array([0, w.size])).tolist() == [[0, 400_000, 100_000]]


def brute_periodic(doc_id, text):
    w, h = words_of(text), crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_documents_equal_brute_force(make):
    rows = [(i, " \n".join(periodic_text(i))) for i in range(60)] + [(i, " ".join(prose(i, 90))) for i in range(100, 160)]
    rows += [r for r in ODD if r[0] != 5] + [(i, "kan lor mist " * 40) for i in (7, 200)]
    docs = make(rows)
    planted = docs.withColumn("text", periodic.with_planted_periods(F.col("doc_id"), F.col("text")))
    got = periodic.summary(periodic.periodic_runs(planted)).drop("n_words").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r[:6]) + tuple(r[6:])
    assert sorted((tuple(r) for r in got), key=key) == sorted((brute_periodic(*r) for r in rows), key=key)
    assert sum(crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3


def test_periodic_runs_keep_spans_and_texts(make):
    got = periodic.periodic_runs(make([(1, "x " * 9 + "kan lor " * 20 + "end"), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0].runs] == [(9, 40, 2)] and got[0].strongest == 0
    assert got[0].collapsed_text == "x " * 9 + "kan lor end"
    assert (got[1].n_words, got[1].runs, got[1].strongest, got[1].collapsed_text) == (0, [], None, "")
    assert periodic.periodic_runs(make([])).count() == 0


# op12


@pytest.mark.parametrize("width,high", [(64, 256), (130, 5000), (3, 2**29), (70, 2**27), (0, 1)])
def test_scores_are_exact(width, high):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-high, high, (20, width)), rng.integers(-high, high, (31, width))
    bound = max([0, *(int(s) for s in (np.r_[a, b].astype(object) ** 2).sum(1))])
    primes = hard.primes_for(bound)
    got = hard.exact_scores(hard.residues(a, primes), hard.residues(b, primes), primes)
    assert got.dtype == np.int64 and (got == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()


def test_scores_beyond_a_long_are_refused():
    with pytest.raises(ValueError, match="do not fit a long"):
        hard.primes_for(2**63)


def brute_mined(rows, positives=5, negatives=5):
    """rows: (vec_id, vector, label) that take part."""
    q = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    width = max([0, *(len(v) for _, v, _ in q)])
    q = [(i, v + [0] * (width - len(v)), label) for i, v, label in q]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, (i, v, label) in enumerate(q):
        if i is None or i % 100:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, u)), m) for n, (j, u, m) in enumerate(q) if n != k]
        for j, p, _ in sorted((r for r in scored if r[2] == label), key=order)[:positives]:
            fits = [r for r in scored if r[2] != label and 80 * p <= 100 * r[1] <= 100 * p]
            out += [(i, j, rank, n, p, s) for rank, (n, s, _) in enumerate(sorted(fits, key=order)[:negatives], 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, row string, slot int, score int, v int"


def vectors(seed, n, tied):
    rng = random.Random(seed)
    draw = (lambda: rng.choice([0.0, 0.25, -0.25])) if tied else (lambda: rng.gauss(0, 0.1))
    return [(i, [float(np.float32(draw())) for _ in range(8)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("tied", [False, True])
def test_hard_negatives_equal_brute_force(spark, tied, monkeypatch, request):
    request.getfixturevalue("make")
    rows = vectors(3, 420, tied)
    rows += [rows[100], rows[200], (None, rows[5][1], 1), (None, [0.25] * 8, 2), (500, [0.5, 0.25], 1), (600, [], 1)]
    out = [(700, None, 1), (800, rows[1][1], None), (900, [0.1, None], 1), (1000, [float("nan")] * 8, 1),
           (1100, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "r", 1, 2, 3) for r in rows + out], VECTORS).repartition(5)
    anchor = F.col("vec_id") % 100 == 0
    want = brute_mined(rows)
    got = sorted((tuple(r) for r in hard.hard_negatives(df, anchor).collect()), key=repr)
    assert got == want and len(want) > 40
    monkeypatch.setattr(hard, "ANCHOR_BYTES", 400)
    monkeypatch.setattr(hard, "SCORE_CELLS", 100)
    assert sorted((tuple(r) for r in hard.hard_negatives(df, anchor).collect()), key=repr) == want


def test_hard_negatives_without_rows(spark, request):
    request.getfixturevalue("make")
    none = spark.createDataFrame([], VECTORS)
    assert hard.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [0.5], 1, "r", 1, 2, 3)], VECTORS)
    assert hard.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0


# op11


def tokens_of(text):
    return [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def plain_bits(text, counts, code):
    """Bits of one normal text, bit by bit in plain floats."""
    s, total = lm.END * lm.ORDER + text + lm.END, 0.0
    weights = cells = None
    for at in range(lm.ORDER, len(s)):
        if (at - lm.ORDER) % lm.PIECE == 0:
            weights = lm.first_weights().astype(float) / lm.LOGIT
            cells = 1 / (1 + np.exp(-np.linspace(-lm.MAP_EDGE, lm.MAP_EDGE, lm.MAP_CELLS)))
        byte = s[at]
        leaf, bits, low, mid, high = (x.reshape(256, 256, *x.shape[1:])[s[at - 1]] for x in (
            code.leaf, code.bits, code.low, code.mid, code.high))
        gate = max([0, *(k for k in counts if s[at - k:at] in counts[k])])
        inside, moves, grown = set(range(256)), [], 0
        for d in range(bits[byte]):
            inside = {b for b in inside if d < bits[b] and (low[b, d], high[b, d]) == (low[byte, d], high[byte, d])}
            ones = {b for b in inside if leaf[b] >= mid[byte, d]}
            x = np.array([0] * lm.INPUTS)
            for k in counts:
                own = counts[k].get(s[at - k:at], {})
                n1, n0 = (sum(n for b, n in own.items() if b in group) for group in (ones, inside - ones))
                if n1 + n0:
                    x[k - lm.LEAST] = int(np.clip(np.rint(math.log((n1 + lm.PRIOR) / (n0 + lm.PRIOR)) * lm.LOGIT), -127, 127))
            z = float(np.clip(np.dot(x, weights[gate]), -lm.MAP_EDGE, lm.MAP_EDGE))
            p = 1 / (1 + math.exp(-z))
            c = int((z + lm.MAP_EDGE) * (lm.MAP_CELLS - 1) / (2 * lm.MAP_EDGE) + 0.5)
            bit = byte in ones
            refined = (p + cells[c]) / 2
            total -= math.log2(refined if bit else 1 - refined)
            grown = grown + (bit - p) * lm.RATE / lm.LOGIT * x
            moves.append((c, cells[c] + lm.MAP_RATE * (bit - cells[c])))
            inside = ones if bit else inside - ones
        weights[gate] += grown
        for c, value in moves:  # of two bits of a byte that move one cell, the later one counts
            cells[c] = value
    return total


def plain_scores(rows):
    train = [t for i, t in rows if crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens_of(t))
    total, kinds = sum(c.values()), len(c)
    counts = {k: {} for k in range(lm.LEAST, lm.ORDER + 1)}
    seen = np.zeros((256, 256), np.int64)
    for t in train:
        s = lm.END * lm.ORDER + lm.normal((t or "").encode()) + lm.END
        for at in range(lm.ORDER, len(s)):
            seen[s[at - 1], s[at]] += 1
            for k in counts:
                counts[k].setdefault(s[at - k:at], Counter())[s[at]] += 1
    code = lm.prefix_codes(seen)
    for i, t in rows:
        w = tokens_of(t)
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        bits = plain_bits(lm.normal((t or "").encode()), counts, code)
        yield i, crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), total, base, -bits * math.log10(2)


@pytest.mark.parametrize("hot", [(lm.HOT_WORDS, lm.HOT_CONTEXTS), (5, 70)])
def test_scores_equal_a_plain_model(make, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot[0])
    monkeypatch.setattr(lm, "HOT_CONTEXTS", hot[1])
    rows = [(i, " ".join(prose(i, 3 + i % 50))) for i in range(40)] + [r for r in ODD if r[0] not in (5, 10)]
    rows += [(77, "MiXeD Case\tand\x0bblanks "), (78, "漢字 unseen ÄÖ"), (79, " ".join(prose(9, 500)))]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 2))
    want = sorted(plain_scores(rows), key=key)
    for group_bytes in (lm.GROUP_BYTES, 300):
        got = sorted((tuple(r)[:7] for r in lm.scored_documents(make(rows), group_bytes).collect()), key=key)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-4, atol=1e-4)


def test_scores_without_training_texts(make):
    own = [i for i in range(200) if crc32(str(i).encode()) % 5 == 1][:3]
    got = lm.scored_documents(make([(i, "kan lor") for i in own])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3
    assert all(abs(r.bits_per_byte - 8) < 0.1 for r in got)
    assert lm.scored_documents(make([])).count() == 0


def test_a_learned_model_beats_word_counts(make):
    texts = [(i, " ".join(WORDS[(i + k * (1 + i % 5)) % len(WORDS)] for k in range(90))) for i in range(200)]
    got = lm.scored_documents(make(texts)).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_bits_sum_to_one_over_all_bytes():
    """Whatever came before, the code lengths of all next bytes are those of a distribution."""
    seen = np.zeros((256, 256), np.int64)
    seen[97, 98:120] = np.arange(22) ** 3
    code = lm.prefix_codes(seen)
    table = {"key": np.zeros(0, np.int64), "cell": np.zeros(0, np.int64), "sums": np.zeros(1, np.int64)}
    for before in (97, 0):
        own = slice(before * 256, before * 256 + 256)
        bits, low, high = code.bits[own], code.low[own], code.high[own]
        assert sum(2.0 ** -bits) == 1.0 and sorted(code.leaf[own]) == list(range(256))
        for a, b in product((0, 99, 119, 255), repeat=2):
            same = [d for d in range(min(bits[a], bits[b])) if low[a, d] == low[b, d] and high[a, d] == high[b, d]]
            assert same == list(range(len(same))) and (a != b) == (len(same) < bits[a])
    nodes, first = lm.inputs_of((97 * 256 + np.arange(256)).astype(np.uint64), table, code)
    bits = code.bits[97 * 256:98 * 256]
    assert nodes.size == bits.sum() and first[-1] == bits[:-1].sum()


def score_of(texts):
    """The scorer's answer for a group of texts, without any training text."""
    import pyarrow as pa

    class Sent:
        def __init__(self, value):
            self.value = value

    none = pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "counts": pa.array(
        [], pa.list_(pa.struct([("byte", pa.int32()), ("n", pa.int64())])))})
    docs = pa.table({"doc_id": pa.array(range(len(texts))), "text": lm.packed(texts), "held": [True] * len(texts),
                     "n_bytes": pa.array([len(t) for t in texts], pa.int64())})
    code = lm.prefix_codes(np.zeros((256, 256), np.int64))
    return lm.scorer(Sent(code), Sent(lm.answers_of(none)))(docs, none)


def test_mixing_lays_out_no_bits_beforehand():
    """Bits are laid out step by step, in the processor's caches: a byte of text costs its codes, not its bits."""
    import tracemalloc

    texts = [(" ".join(prose(i, 20)) + " ").encode() * 500 for i in range(20)]
    tracemalloc.start()
    try:
        got = score_of(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150 * got["n_bytes"].to_numpy().sum()
    assert np.allclose(got["bits"].to_numpy() / got["n_bytes"].to_numpy(), 8, atol=0.1)


@pytest.mark.parametrize("n", [0, 1, 2, 300_000])
def test_places_of_values_that_share_slots(n):
    rng = np.random.default_rng(n)
    known = np.unique(rng.integers(0, 2**48, n, dtype=np.uint64))
    asked = rng.integers(0, max(known.size, 1), 2 * known.size)
    assert (lm.finder(known)(known[asked]) == asked).all()
    assert (lm.places(known.view(np.int64), known.view(np.int64)[asked]) == asked).all()
