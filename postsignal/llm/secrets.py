"""Secrets in texts: plain patterns, and encoded keys that are confirmed by their structure.

Pattern kinds are ``assign``, ``access`` and ``hex``. The other kinds are reported only once the
candidate is decoded and what is inside reads as a key or a signed token to its last byte:

* ``jwt``: three base64url parts whose first is a JSON header with ``alg``, the second a JSON object;
* ``pem``: a private-key block whose body decodes to one of the encodings below, or that has a header
  of encryption and a body that decodes; its line breaks may be written as backslash-n;
* ``key``: a base64 run holding a DER private key (nested lengths must add up), an OpenSSH key or a
  chain of length-prefixed fields that starts with a key type;
* ``hexkey``: the same in hex.

Places are code points, ends exclusive. Null or empty text: no spans. Ties: two kinds may report the
same place; they are listed by start, then in the order of ``KINDS``. Repeated rows: all returned.
Empty table: no rows. Other columns are left out, whatever their names. Rows are worked on one by one,
so memory is bounded by the longest text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "jwt", "pem", "key", "hexkey"]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The three base patterns. Only A-Z fold with a-z, so the cases are spelt out.
WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ASSIGN = re.compile(
    "(?:" + "|".join([*map(_either, WORDS[:4]), _either("api_?key")]) + r""")["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")

RUN = re.compile(r"[A-Za-z0-9_-]+")
# Up to its own END line; a further BEGIN ends the search, so no stray one swallows the block after it.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----BEGIN ).)*?)-----END \1-----", re.DOTALL)
# Line breaks as JSON and .env files write them; headers of an encrypted body.
BREAK = re.compile(r"(?<!\\)\\+[nr]")
SEALED = re.compile(r"Proc-Type: *4 *, *ENCRYPTED|DEK-Info: *[A-Za-z0-9-]+(?: *, *[0-9A-Fa-f]+)?")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEXES = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
# Names of key types in length-prefixed encodings.
PREFIXED = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\x00"
# How the identifiers of password-based encryption begin (1.2.840.113549.1.5 and .1.12.1).
SEALING = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def from_base64(run: str) -> bytes | None:
    bare = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, depth: int = 0) -> list | None:
    """Nested ``(tag, content)`` items that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 8:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
            if length < 128:
                return None
        if at + length > len(data):
            return None
        inner = data[at : at + length]
        if tag & 0x20:
            inner = der(inner, depth + 1)
            if inner is None:
                return None
        out.append((tag, inner))
        at += length
    return out


def fields(data: bytes) -> list[bytes] | None:
    """Four-byte lengths and their fields that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or at + 4 > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _seals(algorithm: list) -> bool:
    """Whether an algorithm identifier is one of encryption; a digest's has the same form."""
    return bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1].startswith(SEALING)


def is_key(data: bytes | None) -> bool:
    """Whether ``data`` is, to its last byte, an encoded key."""
    if not data:
        return False
    if data.startswith(OPENSSH):
        rest, parts = data[len(OPENSSH) :], []
        for _ in range(3):
            n = int.from_bytes(rest[:4], "big")
            if len(rest) < 4 + n:
                return False
            parts.append(rest[4 : 4 + n])
            rest = rest[4 + n :]
        return len(rest) >= 4
    if data[0] == 0x30:
        items = der(data)
        if not items or len(items) != 1:
            return False
        tags = [tag for tag, _ in items[0][1]]
        plain = tags[:2] == [2, 2] and len(tags) >= 6 and set(tags) == {2}
        curve = tags[:2] == [2, 4]
        wrapped = tags[:3] == [2, 0x30, 4]
        sealed = tags == [0x30, 4] and _seals(items[0][1][0][1])
        return plain or curve or wrapped or sealed
    parts = fields(data) if data[:2] == b"\x00\x00" else None
    return bool(parts) and len(parts) >= 2 and parts[0] in PREFIXED


def _object(part: str) -> dict | None:
    data = from_base64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_token(header: str, payload: str) -> bool:
    found = _object(header)
    return found is not None and isinstance(found.get("alg"), str) and _object(payload) is not None


def tokens(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of signed tokens: three runs with a dot between, the first from its ``eyJ`` on.

    Every run is looked at once, so a text without dots takes no longer than any other.
    """
    out, held = [], []
    for run in RUN.finditer(text):
        a, b = run.span()
        if held and (held[-1][1] + 1 != a or text[a - 1] != "."):
            held = []
        held.append((a, b))
        if len(held) == 3:
            first, second, last = held
            start = text.find("eyJ", *first)
            if 0 <= start < first[1] - 3:
                if is_token(text[start : first[1]], text[slice(*second)]):
                    out.append((start, last[1]))
                held = []
            else:
                del held[0]
    return out


def is_block(raw: str) -> bool:
    """Whether ``raw``, what stands between BEGIN and END, is a key or an encrypted one."""
    text = BREAK.sub("\n", raw)
    bare = SEALED.sub("\n", text)
    sealed = bare != text
    lines = [line.split() for line in bare.splitlines()]
    # Other headers fill their lines; where line breaks are lost, only the word with the colon is one.
    for words in ([w for line in lines for w in line if ":" not in w], [w for line in lines if ":" not in "".join(line) for w in line]):
        body = "".join(words)
        data = None if "-" in body else from_base64(body)
        if is_key(data) or (sealed and data):
            return True
    return False


def spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of all secrets, in order."""
    out = []
    low = text.lower()
    if any(word in low for word in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(a, "jwt", b) for a, b in tokens(text)]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if is_block(m[2]):
                out.append((m.start(), "pem", m.end()))
    for m in BASE64.finditer(text):
        # What the encodings start with, as base64 shows it: 0x30, four zero-led bytes, "openssh".
        escaped = m[0][0] in "nr" and text[max(0, m.start() - 1) : m.start()] == "\\" and len(m[0]) > 40
        start, run = m.start() + escaped, m[0][escaped:]
        if run.startswith(("M", "AAAA", "b3Blbn")) and is_key(from_base64(run)):
            out.append((start, "key", m.end()))
    for m in HEXES.finditer(text):
        if m[0].startswith(("30", "0000", "6f70656e", "6F70656E")) and is_key(bytes.fromhex(m[0])):
            out.append((m.start(), "hexkey", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: an array of ``(kind, start, end)`` for each row; nothing is shuffled."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for a, k, b in spans(text or "")] for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    counts = [_of_kind(k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
