"""op3 packing, op4 secret scans, op5 language ID, op8 toxicity."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from samples import ODD, prose
from pyspark.sql import functions as F

from corpusloom.llm import language, packing, secret_scan, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_packed_sequences_hold_every_token_once(make, corpus):
    rows = corpus + [(None if i is None else 1000 + i, t) for i, t in ODD]
    got = packing.packed_documents(make(rows), TOKENIZER, length=128, range_bytes=20000).collect()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    slow.encode_special_tokens = True
    ids = Counter()
    for i, t in rows:
        own = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ids[(i, own.tobytes())] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for (i, data), times in ids.items():
        want[(i, len(data) // 4)] += times
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    for (i, data), _ in ids.items():
        for r in pieces[(i, len(data) // 4)]:
            part = data[4 * r.start:4 * (r.start + r.length)]
            if i != 1007:
                assert r.ids_crc32 == zlib.crc32(part)
    short = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
        short += at < 128
    assert short <= len({s >> 32 for s in sequences})
    assert packing.packed_documents(make([]), TOKENIZER).count() == 0


def test_ranges_follow_the_bytes_alone(make):
    """More ranges than shuffle partitions, or any fixed number, if the bytes ask for them."""
    rows = [(i, f"{' '.join(prose(i, 6))} {i}") for i in range(900)]
    got = packing.packed_documents(make(rows), TOKENIZER, length=16, range_bytes=40)
    assert sum(len(t) for _, t in rows) > 20_000 and got.rdd.getNumPartitions() > 300


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_like_texts_lie_near_each_other():
    a, b = prose(1, 300), [f"z{i % 40}" for i in range(300)]
    texts = [" ".join(random.Random(i).sample(x, 250)).encode() for i in range(4) for x in (a, b)]
    keys = packing.hilbert_keys(packing.points_of(texts))
    order = [int(i) % 2 for i in np.argsort(keys)]
    assert sum(x != y for x, y in zip(order, order[1:])) <= 2
    assert len(packing.points_of([None, b""])) == 2


def test_fast_ids_equal_the_tokenizer_file():
    encode = packing.encoder(TOKENIZER)
    for text in ["Hello, World's  best\n\n x", "ñandú  über\tfaß 12345", "漢字 <|endoftext|> é", " " * 700 + "a", "  x", "a\x1cb"]:
        assert encode(text) == encode.slow.encode(text, add_special_tokens=False).ids


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + i]) * 40) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))


def b64(x):
    return base64.b64encode(x).decode()


def url(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def field(x):
    return len(x).to_bytes(4, "big") + x


SSH = (b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big")
       + field(field(b"ssh-ed25519") + field(b"k" * 32)) + field(b"p" * 64))
TOKEN = ".".join([url(json.dumps({"alg": "HS256"}).encode()), url(json.dumps({"sub": 1}).encode()), url(b"s" * 32)])


@pytest.mark.parametrize("text,spans", [
    ('password = "abcdefgh1"', "assign:0:21"),
    ("Api_Key:short", ""), ("token=secret=abcdefghijk", "assign:0:24"),
    ("password=token: abcdefghi", ""),
    ("é AKIAABCDEFGHIJKL x", "access:2:18"), ("AKIAABC", ""),
    ("0123456789abcdef0123456789abcdef", "hex:0:32"), ("0123456789ABCDEF0123456789ABCDEF", ""),
    ("x " + b64(RSA) + " y", f"der:2:{2 + len(b64(RSA))}"),
    ("x " + b64(RSA)[:-12], ""),
    ("k " + RSA.hex(), f"hex:2:{2 + 2 * len(RSA)},der:2:{2 + 2 * len(RSA)}"),
    ("k " + b64(SSH), f"ssh:2:{2 + len(b64(SSH))}"),
    ("j " + TOKEN, f"jwt:2:{2 + len(TOKEN)}"),
    ("j " + "abcdefghij.abcdefghij.abcdefghij", ""),
])
def test_spans(text, spans):
    assert secret_scan.described(secret_scan.find(text)) == spans


def test_pem_block_is_one_span_and_keys_parse():
    body = b64(PKCS8)
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(body[i:i + 64] for i in range(0, len(body), 64)) + "\n-----END PRIVATE KEY-----"
    assert [s[2] for s in secret_scan.find("a " + pem) if s[2] in ("pem", "der")] == ["pem"]
    assert secret_scan.is_private_der(PKCS8) and not secret_scan.is_private_der(PKCS8 + b"\0")
    assert not secret_scan.is_private_der(der(0x30, b"\x02\x7f\x01"))
    assert secret_scan.masked("x password: abcdefghij y") == "x [SECRET] y"


def armoured(data, end="\n", headers=""):
    lines = [b64(data)[i:i + 64] for i in range(0, len(b64(data)), 64)]
    name = "RSA PRIVATE KEY"
    return end.join([f"-----BEGIN {name}-----", *([headers, ""] if headers else []), *lines, f"-----END {name}-----"])


def wrapped(data, end="\n", width=64):
    return end.join(b64(data)[i:i + width] for i in range(0, len(b64(data)), width))


DEK = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF"


@pytest.mark.parametrize("secret,kind", [
    (TOKEN, "jwt"), (armoured(bytes(range(64)), headers=DEK), "pem"), (armoured(RSA, "\\n"), "pem"),
    (wrapped(RSA), "der"), (wrapped(PKCS8, "\r\n  ", 76), "der"), (wrapped(SSH), "ssh"), (wrapped(RSA, "\\n"), "der"),
    (b64(armoured(RSA).encode()), "pem"), (wrapped(armoured(RSA).encode(), width=76), "pem"), ("0x" + RSA.hex(), "der"),
])
@pytest.mark.parametrize("before,after", [
    ("see ", " end"), ("at ", "."), ("a word\n", "\nthen more words"), ("x.", "..."), ("the \n\n", "\n\nend"),
    ("https://h.example/", "/x"),
])
def test_secrets_in_other_forms(secret, kind, before, after):
    if before.startswith("http") and kind != "jwt":
        return
    found = [s for s in secret_scan.find(before + secret + after) if s[2] not in secret_scan.BASE_KINDS]
    assert found == [(len(before), len(before + secret), kind)]


@pytest.mark.parametrize("text", [
    armoured(bytes(range(64))), armoured(b"no key" * 9, "\\n"), wrapped(bytes(range(200))), b64(armoured(b"x" * 90).encode()),
    TOKEN.replace(".", "..."), "a.b.c.d." * 20, "0x" + "12" * 40, wrapped(RSA[:-3]),
])
def test_what_does_not_parse_is_no_secret(text):
    assert not [s for s in secret_scan.find(text) if s[2] not in secret_scan.BASE_KINDS]


def test_scan_of_odd_rows(make):
    rows = ODD + [(50, "token=abcdefgh12 and 0123456789abcdef0123456789abcdef")]
    got = {r.doc_id: r for r in secret_scan.scanned_documents(make(rows)).collect()}
    assert got[50].spans == "assign:0:16,hex:21:53" and (got[50].n_assign, got[50].n_hex) == (1, 1)
    assert got[50].base_sha256 == hashlib.sha256(got[50].spans.encode()).hexdigest()
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = secret_scan.redacted_documents(make(rows))
    assert clean.columns == make(rows).columns
    texts = {(r.doc_id, r.text) for r in clean.collect()}
    assert texts == {(i, t) for i, t in ODD} | {(50, "[SECRET] and [SECRET]")}
    assert secret_scan.scanned_documents(make([])).count() == 0


def brute_bits(training, text, order=3):
    """PPM with escape method C and exclusion, byte by byte."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in training:
        x = b"\0\0\0" + t
        for i in range(3, len(x)):
            for o in range(order + 1):
                seen[o][x[i - o:i]][x[i]] += 1
    bits, x = 0.0, b"\0\0\0" + text
    for i in range(3, len(x)):
        out, o = set(), order
        while o >= 0 and not seen[o][x[i - o:i]]:
            o -= 1
        while o >= 0:
            c = {k: v for k, v in seen[o][x[i - o:i]].items() if k not in out}
            total, kinds = sum(c.values()), len(c)
            if x[i] in c:
                bits -= math.log2(c[x[i]] / (total + kinds))
                break
            if total:
                bits -= math.log2(kinds / (total + kinds))
            out |= set(seen[o][x[i - o:i]])
            o -= 1
        else:
            bits += math.log2(max(1, 256 - len(out)))
    return bits


def test_code_lengths_equal_plain_ppm(make, monkeypatch):
    aa, bb = ["kan lor mist. kan", "lor lor"], ["tul rem é sok", "van"]
    df = make([(i, t) for i, t in enumerate(aa)]).union(make([(9 + i, t) for i, t in enumerate(bb)]))
    df = df.withColumn("lang", F.when(F.col("doc_id") < 9, "aa").otherwise("bb"))
    tables = language.build_tables(language.train(df.select("lang", "text")))
    texts = [b"kan tul", b"", b"xyz\xff", "é é lor".encode(), b"lor" * 9]
    want = [[brute_bits([t.encode() for t in x], text) for x in (aa, bb)] for text in texts]
    assert np.allclose(language.code_lengths(texts, tables), want, rtol=1e-5)
    monkeypatch.setattr(language, "PIECE", 4)
    assert np.allclose(language.code_lengths(texts, tables), want, rtol=1e-5)


def test_every_context_is_kept(make):
    rng = random.Random(8)
    big = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30000))
    small = "".join(rng.choices("stuvwxyz", k=600))
    df = make([(2, big), (1, small)])
    counts = language.train(df.select("lang", "text"))
    contexts = {t[i:i + 3] for t in (big, small) for i in range(len(t) - 3)}
    assert len(contexts) > 12000
    texts = [big[500:560].encode(), small[-60:].encode(), b"stuv 07"]
    want = [[brute_bits([x.encode()], text) for x in (big, small)] for text in texts]
    assert np.allclose(language.code_lengths(texts, language.build_tables(counts)), want, rtol=1e-5)


def test_forgotten_prices_are_found_again(make, monkeypatch):
    df = make([(1, "tul rem sok van"), (2, "kan lor mist. kan")])
    tables = language.build_tables(language.train(df.select("lang", "text")))
    texts = [b"kan tul", b"rem mist sok", b"kan tul"]
    want = language.code_lengths(texts, tables)
    monkeypatch.setattr(language, "PRICED", 5)
    tables.forget()
    assert (language.code_lengths(texts, tables) == want).all()
    assert (np.concatenate([language.code_lengths([t], tables) for t in texts]) == want).all()


def test_languages_are_told_apart(make):
    rows = [(2 * i, " ".join(w + "ing" for w in prose(i, 30))) for i in range(40)]
    rows += [(2 * i + 1, " ".join("sch" + w for w in prose(90 + i, 30))) for i in range(40)]
    rows += [(None if i is None else 1000 + i, t) for i, t in ODD]
    got = language.predicted_documents(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 100:
            assert r.lang_pred == ("aa" if r.doc_id % 2 == 0 else "bb") and r.score > 0.9
        if r.doc_id in (1001, 1002, 1003, 1011):
            assert r.lang_pred == "und" and r.score == 0
    nothing = language.predicted_documents(make(rows).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.predicted_documents(make([])).count() == 0


def test_toxic_texts_are_caught_and_clean_ones_left(make, spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        own, toxic = prose(i, rng.randrange(10, 80)), i % 9 == 0
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["vilething", "nastyone", "Foul!", "grunk" + rng.choice("abc")]))
        rows.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, int(rng.random() < 0.8), int(toxic)))
    labels += [(10**6, 1, 1), (None, 1, 0), (3, None, 1)]
    odd = [(None if i is None else 10000 + i, t) for i, t in ODD]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    got = {r.doc_id: r for r in toxicity.scored_documents(make(rows + odd), marks, chain).collect()}
    unseen = [i for i in range(0, 600, 2)]
    assert np.mean([got[i].toxic == (i % 9 == 0) for i in unseen]) > 0.97
    assert got[10001].p_toxic == 0 and not got[10003].toxic
    none = toxicity.scored_documents(make(rows), marks.limit(0), chain)
    assert none.where("toxic").count() == 0 and toxicity.scored_documents(make([]), marks, chain).count() == 0


def test_later_links_of_a_chain_use_earlier_ones():
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 900)
    rows = np.concatenate([np.flatnonzero(first), np.arange(900)])
    columns = np.concatenate([np.full(first.sum(), 5), np.full(900, 9)])
    chain = toxicity.fit_chain(rows, columns, np.column_stack([first, first]), np.arange(900) % 3, ["a", "b"])
    assert chain[1].earlier[0] > 0 and chain[0].earlier.size == 0
