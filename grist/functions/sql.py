"""The analysis as functions of SQL: porter_stem(word), which stays in the JVM, and the table function tokenize(text, stop)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .porter import stem_sql
from .stopwords import STOPWORDS

_TAG = re.compile(r"<[^>]*>")


class _Table(dict):
    """What str.translate() makes of characters; each is worked out once."""

    def __init__(self, f: Callable[[str], str | None]):
        self.f = f

    def __missing__(self, code: int) -> str | None:
        self[code] = self.f(chr(code))
        return self[code]


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 or c == "\u0130" else c


_LOWER = _Table(_lower)
_MARKS = _Table(lambda c: None if unicodedata.category(c) == "Mn" else c)
_CONTROL = _Table(lambda c: None if c not in "\n\t" and unicodedata.category(c) in ("Cc", "Cf", "Co", "Cs") else c)
_KEPT = _Table(lambda c: c if c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "So" else " ")


def plain_tokens(text: str | None, stop: bool = False) -> list[str]:
    """The tokens of one text, in Python; the same as analysis.analyze() gives."""
    folded = (text or "").translate(_LOWER)
    if not folded.isascii():
        folded = unicodedata.normalize("NFC", unicodedata.normalize("NFD", folded).translate(_MARKS))
    found = _TAG.sub(" ", folded.translate(_CONTROL)).translate(_KEPT).split()
    return [t for t in found if t not in STOPWORDS] if stop else found


class _Tokenize:
    def eval(self, text: str, stop: bool) -> Iterator[tuple[int, str]]:
        yield from enumerate(plain_tokens(text, bool(stop)))


def register(spark: SparkSession) -> None:
    """Registers porter_stem and tokenize in a session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION porter_stem(word STRING) RETURNS STRING RETURN {stem_sql('word')}")
    spark.udtf.register("tokenize", udtf(_Tokenize, returnType="nth int, term string"))
