"""PII by anchor expansion (operator 9): Aho-Corasick finds anchors, local parsers expand and validate around them.

One automaton runs over each whole text, letters in lower case and every digit as 0, and finds at-signs, schemes, identifier
cues (words such as "passport", and the digit shapes of addresses, telephone numbers, accounts, and of IBANs: two letters, two digits). Around an anchor a
deterministic parser decides the exact boundaries. Names, hosts and numbers in dots are followed as far as they reach; the other kinds have a greatest
length, SPAN at most, by their own rules, and are looked for so far around the anchor. Each stretch of text is walked once for each kind, so
the time is linear in the text.

  email            a local part of any length and a domain of two labels or more, at most 63 and 253 bytes (as DNS has it); letters beyond ASCII are allowed in both
  url_credentials  user:password in front of the host of a URL, of any length
  ipv4             four numbers of 0 to 255 without leading zeros, not part of a longer dotted number
  phone            international (+), or North American with separators, or after tel:; 7 to 15 digits
  ssn              ddd-dd-dddd in its permitted ranges
  iban             with or without a cue, in one run or in groups of four; the check digits must be right
  account          12 to 19 digits in one run, in groups of four, or grouped 4-6-5 or 4-6-4; "valid" says whether the Luhn digit is right.
                   After a cue such as "account" or "passport": 5 to 20 letters, digits and hyphens, four digits at least

Results have character positions, start and end, in the whole text; findings of a text don't overlap (the earliest stays, of equal
starts the longest, of equal spans the more specific kind). Defined results: null or empty text has none; null ids stay null; each of equal rows is
reported; other columns are passed over.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

#: No phone number, account, social security number or IBAN, and nothing after a cue, is longer than this.
SPAN = 64
_FOLD = bytes(ord("0") if 48 <= i <= 57 else i + 32 if 65 <= i <= 90 else i for i in range(256))

_ANCHORS = {
    "email": ("@",),
    "url": ("://",),
    "ip": ("0.0",),
    "phone": ("+0", "+(0", "(000)", "000-0000", "000 0000", "000.0000", "tel:"),
    "ssn": ("000-00-0000",),
    "account": ("0" * 12, "0000 0000", "0000-0000"),
    "iban": tuple(f"{a}{b}00" for a in string.ascii_lowercase for b in string.ascii_lowercase),
    "cue": ("account", "acct", "passport", "customer id", "member id", "licence no", "license no", "national id", "tax id", "ssn"),
}

# Latin-1 views of UTF-8: \x80-\xff are bytes of characters beyond ASCII. A number may stand right beside these, as scripts without spaces have it.
_LOCAL = "".join(chr(i) for i in range(256) if chr(i) in string.ascii_letters + string.digits + "._%+-" or i >= 0x80)
_DOTTED = string.digits + "."
_WORD = string.ascii_letters + string.digits + "_-"
_DOMAIN = re.compile(r"(?:[A-Za-z0-9\x80-\xff](?:[A-Za-z0-9\-\x80-\xff]{0,61}[A-Za-z0-9\x80-\xff])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9\x80-\xff])")
_USER = re.compile(r"[^\s/?#@:\"'<>]++:[^\s/?#@\"'<>]++@")
_DIGITS = re.compile(r"\d+", re.A)
_PHONES = (
    re.compile(r"(?<![\w+.])\+\(?1\)?[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?![\w])", re.A),
    re.compile(r"(?<![\w+.])\+\(?\d{1,3}\)?(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?![\w])", re.A),
    re.compile(r"(?<![\w+.\-])(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[.\- ])\d{3}[.\- ]\d{4}(?![\w\-]|\.\d)", re.A),
)
_AFTER_TEL = re.compile(r"\+?[\d ().\-]*+", re.A)
_SSN = re.compile(r"(?<![\w\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])", re.A)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", re.A)
_ACCOUNT = re.compile(r"(?<![\w.\-])(?:\d{12,19}|\d{4}(?:([ \-])\d{4})(?:\1\d{4}){1,2}(?:\1\d{1,3})?|\d{4}(?P<six>[ \-])\d{6}(?P=six)\d{4,5})(?![\w\-]|\.\d)", re.A)
_AFTER_CUE = re.compile(r"(?i:\s?(?:number|no|nr|id|is|was)?[\s.:#=]{1,4}){1,3}(?P<v>[A-Za-z0-9](?:[A-Za-z0-9\-]{3,18})[A-Za-z0-9])(?![A-Za-z0-9\-])", re.A)


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in _ANCHORS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    """Whether the two check digits are right (ISO 7064, modulo 97)."""
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _back(raw: str, at: int, of: str, least: int = 0) -> int:
    """Where the run of these characters that ends before at begins; steps double, so that a long run costs its length."""
    step = 64
    while at > least:
        part = raw[max(least, at - step) : at]
        at -= len(part) - len(part.rstrip(of))
        if part.rstrip(of):
            break
        step *= 2
    return at


#: Parsers: (text, place of the anchor, its length) -> what was found, or the end of the stretch in which no other anchor of this kind finds anything, or None.
Found = tuple[str, int, int, bool] | int | None


def _email(raw: str, at: int, _: int, least: int = 0) -> Found:
    domain = _DOMAIN.match(raw, at + 1)
    if not domain or domain.end() - at - 1 > 253:
        return None
    name = raw[_back(raw, at, _LOCAL, least) : at].lstrip(".-%+")
    while name and 0x80 <= ord(name[0]) < 0xC0:  # the rest of a character, if the text is broken
        name = name[1:]
    name = name.rpartition("..")[2].lstrip(".")
    return ("email", at - len(name), domain.end(), True) if name and not name.endswith(".") else None


def _url(raw: str, at: int, n: int) -> Found:
    m = _USER.match(raw, at + n)
    return ("url_credentials", m.start(), m.end() - 1, True) if m else None


def _ip(raw: str, at: int, n: int) -> Found:
    a, end = _back(raw, at, _DOTTED), at + n
    while end < len(raw) and raw[end] in _DOTTED:
        end += 1
    b = end
    while raw[a] == ".":
        a += 1
    while raw[b - 1] == ".":
        b -= 1
    near = raw[max(0, a - 1) : a] + raw[b : b + 1]
    if b - a > 15 or any(c in _WORD for c in near):
        return end
    parts = raw[a:b].split(".")
    if len(parts) != 4 or any(not p or len(p) > 3 or int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return end
    return "ipv4", a, b, True


def _first(patterns, raw: str, at: int, n: int) -> re.Match | None:
    """The match around this anchor."""
    for p in patterns:
        for m in p.finditer(raw, max(0, at - SPAN), at + n + SPAN):
            if m.start() <= at + n and m.end() >= at:
                return m
            if m.start() > at + n:
                break
    return None


def _phone(raw: str, at: int, n: int) -> Found:
    if raw[at : at + n].lower() == "tel:":
        m = _AFTER_TEL.match(raw, at + n)
        s = m[0].rstrip(" ().-+")
        return ("phone", m.start(), m.start() + len(s), True) if 7 <= sum(c.isdigit() for c in s) <= 15 else m.end()
    # Numbers with a plus begin at it.
    m = _PHONES[0].match(raw, at) or _PHONES[1].match(raw, at) if raw[at] == "+" else _first(_PHONES, raw, at, n)
    if not m:
        return None
    s = m[0]
    while sum(c.isdigit() for c in s) > 15:  # what follows the number isn't part of it
        s = re.sub(r"[ .\-]?\(?\d+\)?$", "", s)
    return ("phone", m.start(), m.start() + len(s), True) if sum(c.isdigit() for c in s) >= 7 else None


def _ssn(raw: str, at: int, n: int) -> Found:
    m = _first((_SSN,), raw, at, n)
    return ("ssn", m.start(), m.end(), True) if m else None


def _account(raw: str, at: int, n: int) -> Found:
    if n == 12:  # twelve digits: of a longer run than accounts have, none is one
        end = _DIGITS.match(raw, at).end()
        if end - at > 19:
            return end
    m = _first((_ACCOUNT,), raw, at, n)
    if not m:
        return None
    digits = re.sub(r"\D", "", m[0])
    return ("account", m.start(), m.end(), luhn(digits)) if 12 <= len(digits) <= 19 else None


def _iban(raw: str, at: int, n: int) -> Found:
    m = _IBAN.match(raw, at)
    s = m[0] if m else ""
    while s and not iban_valid(s):  # groups that follow the account aren't part of it
        s = s.rpartition(" ")[0]
    return ("iban", m.start(), m.start() + len(s), True) if s else None


def _cue(raw: str, at: int, n: int) -> Found:
    if raw[max(0, at - 1) : at].isalpha():
        return None
    m = _AFTER_CUE.match(raw, at + n, at + n + SPAN)
    return ("account", m.start("v"), m.end("v"), True) if m and sum(c.isdigit() for c in m["v"]) >= 4 else None


_PARSERS = {"email": _email, "url": _url, "ip": _ip, "phone": _phone, "ssn": _ssn, "account": _account, "iban": _iban, "cue": _cue}


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of each finding, in order, without overlaps."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    raw = None
    found = set()
    done: dict[str, int] = {}
    for last, (kind, n) in automaton().iter(data.translate(_FOLD).decode("latin-1")):
        raw = raw or data.decode("latin-1")
        at = last - n + 1
        if done.get(kind, -1) >= last:  # inside what this parser has found already
            continue
        x = _email(raw, at, n, done.get(kind, -1) + 1) if kind == "email" else _PARSERS[kind](raw, at, n)  # what was found isn't part of the next name
        if isinstance(x, tuple):
            found.add(x)
            x = x[2]
        if x is not None:
            done[kind] = max(done.get(kind, -1), x - 1)
    out: list[tuple[str, int, int, bool]] = []
    for kind, a, b, valid in sorted(found, key=lambda x: (x[1], -x[2], x[0] == "account", x[0])):
        if not out or a >= out[-1][2]:
            out.append((kind, a, b, valid))
    if len(data) == len(text):
        return out
    # Bytes that begin a character, up to each place.
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(k, int(chars[a]), int(chars[b]), v) for k, a, b, v in out]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, valid) of each finding in each row of docs; nothing of the data itself."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text")) for x in scan(t.as_py())]
            parts = zip(*rows) if rows else ((), (), (), (), ())
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(p), t) for p, t in zip(parts, types)], ["doc_id", "kind", "start", "end", "valid"])

    own = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return own.mapInArrow(task, "doc_id bigint, kind string, start bigint, end bigint, valid boolean")
