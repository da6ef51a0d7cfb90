"""Text analysis as Column expressions, all inside the JVM: clean, tokenize, drop stop words.

The order is fixed: lower case, accents (decompose, strip non-spacing marks, recompose), control characters,
tags, punctuation, tokens, stop words. Stemming is done on vocabularies, see porter.py.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import STOPWORDS

CONTROL = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^\n\t]]"
TAG = r"<[^>]*>"
PUNCTUATION = r"[^\p{L}\p{N}\p{So}\s]+"


@functools.lru_cache(maxsize=1)
def folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, expansions): characters that lose their marks one to one, and those that become several."""
    one, to, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Cs", "Cn"):
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        bare = unicodedata.normalize("NFC", bare)
        if bare and bare != c:
            if len(bare) == 1:
                one.append(c)
                to.append(bare)
            else:
                several.append((c, bare))
    return "".join(one), "".join(to), tuple(several)


def lower(text: Column) -> Column:
    """Lower case rune by rune: a capital sigma is never final."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def fold(text: Column) -> Column:
    """Without accents and control characters (but for new lines and tabs). Text in plain ASCII only loses its control characters."""
    one, to, several = folding()
    bare_text = F.translate(text, one, to)
    for c, bare in several:
        bare_text = F.replace(bare_text, F.lit(c), F.lit(bare))
    bare_text = F.regexp_replace(bare_text, rf"[\p{{Mn}}{CONTROL}]+", "")
    return F.when(F.octet_length(text) == F.char_length(text), F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", "")).otherwise(bare_text)


def clean(text: Column) -> Column:
    """Folded text, tags and punctuation as spaces; emoji and other symbols of class So stay."""
    return F.regexp_replace(F.regexp_replace(fold(text), TAG, " "), PUNCTUATION, " ")


def tokenize(cleaned: Column) -> Column:
    """The runs of anything but white space."""
    return F.filter(F.split(cleaned, r"\s+"), lambda t: t != "")


def remove_stopwords(tokens: Column) -> Column:
    """tokens without stop words; the others keep their number and order."""
    return F.filter(tokens, lambda t: ~t.isin(sorted(STOPWORDS)))


def analyze(text: Column, stopwords_removal: bool = False) -> Column:
    """The tokens of a text, unstemmed; null text has none."""
    tokens = tokenize(clean(lower(F.coalesce(text, F.lit("")))))
    return remove_stopwords(tokens) if stopwords_removal else tokens


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def byte_length(text: Column) -> Column:
    """The length that ranking uses: UTF-8 bytes of the trimmed text."""
    return F.octet_length(trim_space(F.coalesce(text, F.lit("")))).cast("bigint")
