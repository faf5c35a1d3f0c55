"""Secret scans: patterns, and candidates confirmed by the structure of what they encode.

Base kinds are matched by pattern alone. A base64 or hexadecimal run is reported
only if its decoded bytes parse as a private key (nested DER lengths, or the
length-prefixed fields of an OpenSSH key) or hold one in PEM, and a dotted token only
if its header and claims are JSON objects and the header names a signature algorithm.
Runs may be wrapped over lines; line ends may be written as escapes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# All runs of 32 or more: a run is maximal, so shorter ones need not be matched.
HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
ESCAPED_END = re.compile(r"\\+[rn]")
HEADER = re.compile(r"\s*([A-Za-z][A-Za-z0-9-]*):(.*)")
ENCODED = re.compile(r"[A-Za-z0-9+/_.-]{24,}={0,2}")
HEX_RUN = re.compile(r"(?:0[xX])?([0-9a-fA-F]+)")
TOKENS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
# Base64 lines that follow each other; only the last may be short or padded.
LINE_END = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
WRAPPED = re.compile(
    rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{24,}}+(?:{LINE_END}[A-Za-z0-9+/_-]{{24,}}+)*+"
    rf"(?:{LINE_END}[A-Za-z0-9+/_-]++)?+={{0,2}}")
LINE = re.compile(r"(?<![A-Za-z0-9+/_\\-])[A-Za-z0-9+/_-]++={0,2}|(?<=\\[rn])[A-Za-z0-9+/_-]++={0,2}")
MASK = "[SECRET]"

Span = tuple[int, int, str]


def base_spans(text: str) -> Iterator[Span]:
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            yield (*m.span(), "assign")
    for m in ACCESS.finditer(text):
        if len(m[0]) >= 16:
            yield (*m.span(), "access")
    for m in HEX.finditer(text):
        yield (*m.span(), "hex")


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run of either alphabet, padded or not; None if it is none."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, object]] | None:
    """(tag, content) of DER values that fill ``data`` exactly; constructed ones parsed, too."""
    items: list[tuple[int, object]] = []
    at = 0
    while at < len(data):
        if depth > 16 or len(data) - at < 2:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            octets = length & 0x7F
            if not 1 <= octets <= 4 or at + octets > len(data):
                return None
            length = int.from_bytes(data[at:at + octets], "big")
            at += octets
        if at + length > len(data):
            return None
        content: object = data[at:at + length]
        if tag & 0x20:
            content = der_items(data[at:at + length], depth + 1)
            if content is None:
                return None
        items.append((tag, content))
        at += length
    return items


def is_private_der(data: bytes) -> bool:
    """An RSA, EC or PKCS#8 private key, plain or encrypted."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = top[0][1]
    tags = [tag for tag, _ in inner]
    algorithm = [c for tag, c in inner[:2] if tag == 0x30 and c and c[0][0] == 0x06]
    if tags[:1] == [0x02] and int.from_bytes(inner[0][1], "big") <= 2:
        many_integers = len(tags) >= 6 and tags[:6] == [0x02] * 6
        return many_integers or tags[1:2] == [0x04] or (bool(algorithm) and tags[2:3] == [0x04])
    return bool(algorithm) and tags == [0x30, 0x04]


def is_openssh_private(data: bytes) -> bool:
    """The magic, then cipher, kdf, its options, the key count, public keys and one private blob."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size:at]

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    public = [field() for _ in range(keys)]
    return all(p and p[4:].startswith((b"ssh-", b"ecdsa-", b"sk-")) for p in public) and (
        field() is not None and at == len(data))


def pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """PEM blocks whose body is a private key, or is encrypted as the block's headers say."""
    for m in PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        headers, body = {}, []
        for line in ESCAPED_END.sub("\n", m[2]).replace("\\/", "/").splitlines():
            header = HEADER.match(line)
            if header:
                headers[header[1].lower()] = header[2]
            else:
                body += line.split()
        data = decoded("".join(body))
        encrypted = "ENCRYPTED" in headers.get("proc-type", "") and "dek-info" in headers
        if key_kind(data) or (encrypted and data and len(data) >= 32 and len(data) % 8 == 0):
            yield m.span()


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_openssh_private(data) else "der" if is_private_der(data) else None


def content_kind(data: bytes | None) -> str | None:
    """The kind of a key, or ``pem`` for bytes that hold one in PEM."""
    kind = key_kind(data)
    if not kind and data and b"PRIVATE KEY-----" in data:
        kind = "pem" if any(True for _ in pem_spans(data.decode("latin-1"))) else None
    return kind


def run_kind(run: str) -> str | None:
    digits = HEX_RUN.fullmatch(run)
    if digits and len(digits[1]) % 2 == 0:
        kind = content_kind(bytes.fromhex(digits[1]))
        if kind:
            return kind
    return content_kind(decoded(run))


def der_size(start: bytes) -> int | None:
    """Size of the DER sequence that begins with ``start``, header included."""
    if len(start) < 6 or start[0] != 0x30:
        return None
    octets = start[1] & 0x7F
    if start[1] < 0x80:
        return 2 + octets
    return 2 + octets + int.from_bytes(start[2:2 + octets], "big") if 1 <= octets <= 4 else None


def wrapped_spans(text: str) -> Iterator[Span]:
    """Keys in base64 that is wrapped over lines without armour."""
    for m in WRAPPED.finditer(text):
        lines = [line.span() for line in LINE.finditer(text, *m.span())]
        i = 0
        while i < len(lines) - 1:
            start = decoded(text[lines[i][0]:lines[i][0] + 20]) or b""
            size = der_size(start)
            ends, kind = [], None
            if size:  # its size says where it ends
                ends, have = [], 0
                for k in range(i, len(lines)):
                    have += len(text[lines[k][0]:lines[k][1]].rstrip("="))
                    if have >= -(-size * 4 // 3):
                        ends = [k] if have == -(-size * 4 // 3) else []
                        break
            elif start.startswith((b"openssh-key-v", b"-----BEGIN ", b"{")):
                ends = [len(lines) - 1, len(lines) - 2]  # the last may be a word of the text
            for k in ends:
                kind = content_kind(decoded("".join(text[a:b] for a, b in lines[i:k + 1])))
                if kind and k > i:
                    yield (lines[i][0], lines[k][1], kind)
                    i = k
                    break
            i += 1


def is_signed_token(run: str) -> bool:
    parts = run.split(".")
    if len(parts) != 3 or not all(parts):
        return False
    try:
        header, claims = (json.loads(decoded(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return (isinstance(header, dict) and isinstance(claims, dict)
            and isinstance(header.get("alg"), str) and header["alg"].lower() != "none"
            and bool(decoded(parts[2])))


def token_spans(run: str) -> Iterator[tuple[int, int]]:
    """Signed tokens in a run: all of it, or three parts that follow each other inside it."""
    if run.count(".") == 2 and is_signed_token(run):
        yield (0, len(run))
        return
    for m in TOKENS.finditer(run):
        parts = list(re.finditer(r"[^.]+", m[0]))
        i = 0
        while i + 2 < len(parts):
            start, end = parts[i].start(), parts[i + 2].end()
            if is_signed_token(m[0][start:end]):
                yield (m.start() + start, m.start() + end)
                i += 2
            i += 1


def structural_spans(text: str) -> Iterator[Span]:
    blocks = []
    for span in pem_spans(text):
        blocks.append(span)
        yield (*span, "pem")
    for start, end, kind in list(wrapped_spans(text)):
        if not any(a < end and start < b for a, b in blocks):
            blocks.append((start, end))
            yield (start, end, kind)
    for m in ENCODED.finditer(text):
        start, end = m.span()
        if any(a <= start and end <= b for a, b in blocks):
            continue
        tokens = list(token_spans(m[0]))
        for a, b in tokens:
            yield (start + a, start + b, "jwt")
        for part in re.finditer(r"[^.]{24,}", m[0]):
            if any(a < part.end() and part.start() < b for a, b in tokens):
                continue
            run = part[0]
            first, kind = part.start(), run_kind(run)
            if not kind and (run[0] == "/" or run[-1] == "/"):
                first, run = first + len(run) - len(run.lstrip("/")), run.strip("/")
                kind = run_kind(run)
            if kind:
                yield (start + first, start + first + len(run), kind)


def find(text: str | None) -> list[Span]:
    """All spans in code points, end exclusive, by start and then kind."""
    if not text:
        return []
    return sorted([*base_spans(text), *structural_spans(text)],
                  key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def described(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str | None) -> str | None:
    """``text`` with every reported span replaced; overlapping spans are one."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])


REPORT = ("n_assign long, n_access long, n_hex long, n_structural long, base_sha256 string, "
          "spans string")


def report(text: Column) -> Column:
    """A struct with counts by kind, the digest of base spans, and all spans."""

    @F.pandas_udf(REPORT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = find(text)
            kinds = [s[2] for s in spans]
            base = [s for s in spans if s[2] in BASE_KINDS]
            counts = [kinds.count(k) for k in BASE_KINDS]
            digest = hashlib.sha256(described(base).encode()).hexdigest()
            rows.append((*counts, len(spans) - len(base), digest, described(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_structural",
                                           "base_sha256", "spans"])

    return scan(text)


def scanned_documents(docs: DataFrame) -> DataFrame:
    """Documents → one row each with its secrets: doc_id and the fields of ``REPORT``.

    Null and empty texts have none. Whole texts are scanned, one row at a time;
    repeated rows are reported each, and other columns are not looked at.
    """
    return docs.select("doc_id", report(F.col("text")).alias("found")).select("doc_id", "found.*")


def redacted_documents(docs: DataFrame) -> DataFrame:
    """Documents with every reported span replaced by ``MASK``; n_chars follows the text.

    Texts without a secret stay as they are, nulls included. Other columns pass.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn("text", mask(F.col("text")))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.char_length("text").cast(kind))
