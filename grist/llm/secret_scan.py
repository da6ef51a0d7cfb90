"""Secret scan (operator 10): candidates are decoded and their structure parsed before anything is reported.

Candidates are runs of base64 characters, hex runs that begin as a key does, PEM blocks (also inside JSON, .env or source strings, where
line ends and other characters are escaped and lines are strings of their own), and what follows an assignment cue
("token = ...", "password=...", "Authorization: Bearer ..."). A candidate is reported only when a parser confirms it:

  der_key         base64 (in PEM or bare) or bare hex of an ASN.1 SEQUENCE whose nested lengths add up to the end and that holds an
                  INTEGER, an OID or an OCTET STRING, as PKCS#1, PKCS#8 and SEC1 keys do
  ssh_key         base64 of length-prefixed fields that use up all bytes, the first naming a key type, or of an OpenSSH
                  private-key container, its nested lengths followed through cipher, public keys and private part to the last byte
  signed_token    three base64url parts, the first a JSON object with "alg", the second a JSON object
  access_key_id   a four-letter AWS-style prefix and 16 base32 characters that decode to 10 bytes
  hex_key         an assigned run of hex digits, an even number of them, that decodes to 8 bytes or more, not of few values
  base64_key      an assigned run of base64 that decodes to 12 bytes or more of high entropy, with letters and digits

Results have character positions, start and end, in the whole text. Spans of one text don't overlap: the earliest stays, of
equal starts the longest. Defined results: null or empty text has no findings; null ids stay null; equal rows are
reported once each; other columns are passed over, or passed through by redact(); redact() leaves null n_chars null.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

MASK = "[SECRET]"
_MAGIC = b"openssh-key-v1\0"
_CUE = r"(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passw(?:or)?d|pwd|credential|private[_-]?key|bearer)"
_ASSIGNED = re.compile(rf"(?i:(?<![A-Za-z]){_CUE})[\"']?\s{{0,3}}(?:[:=]|=>|:=)\s{{0,3}}[\"']?(?P<v>[A-Za-z0-9+/_=.-]{{12,}})")
_BEARER = re.compile(r"(?i:(?<![A-Za-z])bearer)\s{1,3}(?P<v>[A-Za-z0-9+/_=.-]{12,})")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,30})PRIVATE KEY-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\\"'-]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA|AGPA|ANPA|ANVA)([A-Z2-7]{16})(?![A-Za-z0-9])", re.I)
#: Structure shows in the first characters: MC.. to MI.. is an ASN.1 SEQUENCE, AAAA a length, b3BlbnNza a container's name.
_BARE = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[C-I]|AAAA|b3BlbnNza)[A-Za-z0-9+/_-]{30,}={0,2}")
#: 30 and a length: a SEQUENCE of 24 bytes or more in hex.
_HEX = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt])|(?<=\b0[xX]))30(?:1[6-9a-fA-F]|[2-7][0-9a-fA-F]|8[1-4])[0-9a-fA-F]{44,}(?![A-Za-z0-9])")
#: A text that has none of these, in lower case, and no bare key has no candidates.
_SIGNS = ("token", "passw", "pwd", "secret", "key", "credential", "bearer", "eyj", "akia", "asia", "aroa", "aida", "agpa", "anpa", "anva", "aaaa", "b3blbnnza")
_DER = re.compile(r"M[C-I][A-Za-z0-9+/_-]{30}")
_HEX_DER = re.compile(r"30[1-8][0-9a-fA-F]{45}")
_ESCAPED = re.compile(r"\\+(?:u00([0-9a-fA-F]{2})|([nrt/])|(?=\s))")


def decode_base64(s: str) -> bytes | None:
    """Either alphabet, with or without padding; None if it isn't base64."""
    s = re.sub(r"\s+", "", s).rstrip("=").translate(str.maketrans("-_", "+/"))
    if not s or len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unescaped(s: str) -> str:
    """The body of a PEM block as it is outside of strings: escapes read, the ends of strings that follow each other dropped."""
    s = _ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else "/" if m[2] == "/" else "\n" if m[2] else "", s)
    return re.sub(r"\\*[\"'][\s+,]*(?:\\*[\"'])?", "\n", s)


def _der_items(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the elements that fill b[at:end] exactly, or None."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
            if n < 0x80:
                return None  # DER takes the short form
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der_key(b: bytes) -> bool:
    """One SEQUENCE over all bytes, every constructed element nested exactly, with the parts of a key."""
    top = _der_items(b, 0, len(b))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    tags: Counter[int] = Counter()
    todo = [top[0][1:]]
    while todo:
        items = _der_items(b, *todo.pop())
        if items is None:
            return False
        for tag, lo, hi in items:
            tags[tag] += 1
            if tag & 0x20:
                todo.append((lo, hi))
    return len(b) >= 24 and (tags[0x02] >= 2 or (tags[0x06] >= 1 and tags[0x03] + tags[0x04] >= 1) or (tags[0x02] >= 1 and tags[0x04] >= 1))


def _fields(b: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """n fields of four-byte lengths from a place on, and where they end; without n, those that end with the bytes. None if they don't fit."""
    fields: list[bytes] = []
    while at < len(b) if n is None else len(fields) < n:
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + size > len(b):
            return None
        fields.append(b[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def _names_key(fields: list[bytes]) -> bool:
    return len(fields) >= 2 and bool(re.fullmatch(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]{2,60}", fields[0]))


def is_openssh_container(b: bytes) -> bool:
    """The magic, cipher, derivation and its options, a number of keys, so many public keys and one private part, up to the last byte, every length nested exactly."""
    at = len(_MAGIC)
    if not b.startswith(_MAGIC) or not (head := _fields(b, at, 3)):
        return False
    (cipher, derivation, options), at = head
    keys = int.from_bytes(b[at : at + 4], "big")
    if not all(re.fullmatch(rb"[a-z0-9@.-]{2,60}", x) for x in (cipher, derivation)) or not 1 <= keys <= len(b) // 16:
        return False
    if not (rest := _fields(b, at + 4, keys + 1)) or rest[1] != len(b):
        return False
    *public, private = rest[0]
    if any(not (x := _fields(p, 0)) or not _names_key(x[0]) for p in public) or not private or len(private) % 8:
        return False
    if cipher != b"none":
        return derivation != b"none" and bool(options)
    return private[:4] == private[4:8] and bool(inner := _fields(private, 8, 2)) and _names_key(inner[0])


def is_ssh_key(b: bytes) -> bool:
    """An OpenSSH container, or fields of four-byte lengths that end with the bytes, the first a key type."""
    return is_openssh_container(b) or bool(x := _fields(b, 0)) and _names_key(x[0])


def is_signed_token(head: str, body: str) -> bool:
    """A JSON header that names its algorithm, and a JSON object as body."""
    try:
        h, p = (json.loads(decode_base64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def entropy(b: bytes | str) -> float:
    """Bits for each element."""
    n = len(b)
    return -sum(c / n * math.log2(c / n) for c in Counter(b).values()) if n else 0.0


def _assigned(value: str) -> str | None:
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        if len(value) % 2 == 0 and len(value) >= 16 and len(set(bytes.fromhex(value))) * 2 >= min(16, len(value) // 2):
            return "hex_key"
        return None
    if (b := decode_base64(value)) is None:
        return None
    if is_der_key(b):
        return "der_key"
    if is_ssh_key(b):
        return "ssh_key"
    mixed = re.search(r"[0-9]", value) and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)
    return "base64_key" if len(b) >= 12 and mixed and entropy(value) >= 3.5 else None


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each confirmed secret, in order, without overlaps."""
    if not text:
        return []
    low = text.lower()
    if not any(x in low for x in _SIGNS) and not _DER.search(text) and not _HEX_DER.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    begin = None
    for m in _PEM.finditer(text):  # a block ends at the mark that follows its beginning, so each byte is looked at once
        if m[1] == "END" and begin and begin[2] == m[2] and _PEM_BODY.fullmatch(text, begin.end(), m.start()):
            b = decode_base64(re.sub(r"(?m)^[A-Za-z-]+:.*$", "", _unescaped(text[begin.end() : m.start()])))
            if b and (is_der_key(b) or is_ssh_key(b)):
                found.append((begin.start(), m.end(), "der_key" if is_der_key(b) else "ssh_key"))
        begin = m if m[1] == "BEGIN" else None
    for m in _JWT.finditer(text):
        if is_signed_token(m[1], m[2]):
            found.append((m.start(), m.end(), "signed_token"))
    for m in _ID.finditer(text):
        if len(base64.b32decode(m[1].upper())) == 10 and len(set(m[1].upper())) >= 5:
            found.append((m.start(), m.end(), "access_key_id"))
    for m in _BARE.finditer(text):
        b = decode_base64(m[0])
        if b and (is_der_key(b) or is_ssh_key(b)):
            found.append((m.start(), m.end(), "der_key" if is_der_key(b) else "ssh_key"))
    for m in _HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append((m.start(), m.end(), "der_key"))
    for m in chain(_ASSIGNED.finditer(text), _BEARER.finditer(text)):
        value = m["v"].rstrip(".-_")
        if kind := _assigned(value):
            found.append((m.start("v"), m.start("v") + len(value), kind))
    out: list[tuple[str, int, int]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


def mask(text: str, mark: str = MASK) -> str:
    """text with each confirmed secret replaced by mark."""
    for _, a, b in reversed(scan(text)):
        text = text[:a] + mark + text[b:]
    return text


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, length) of each secret in each row of docs; nothing of the secret itself."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text")) for x in scan(t.as_py())]
            ids, kinds, a, b = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "kind", "start", "end"]
            )

    own = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return own.mapInArrow(task, "doc_id bigint, kind string, start bigint, end bigint").selectExpr("doc_id", "kind", "start", "end", "end - start AS length")


def redact(docs: DataFrame, mark: str = MASK) -> DataFrame:
    """docs with each secret in text replaced by mark; where that changes a text, n_chars follows. No row goes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, old = batch.schema.get_field_index("text"), column(batch, "text")
            texts = old.to_pylist()
            new = [t if t is None else mask(t, mark) for t in texts]
            columns = batch.columns
            columns[at] = pa.array(new, old.type)
            k = batch.schema.get_field_index("n_chars")
            if k >= 0:
                columns[k] = pa.array([n if t == u or n is None else len(u) for n, t, u in zip(columns[k].to_pylist(), texts, new)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(task, docs.schema)
