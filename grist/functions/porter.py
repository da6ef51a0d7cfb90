"""The Porter stemmer (Porter 1980), as SQL over a vocabulary and as a Python function.

stem_vocabulary() runs in the JVM: each step is one projection of built-in string functions. The same text, in
DuckDB's dialect, serves as oracle. Words of up to two letters stay; everything but a, e, i, o, u, and y after a
consonant, is a consonant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"^({_C})?{_V}{_C}"
_M1 = f"^({_C})?{_V}{_C}({_V})?$"
_M2 = f"^({_C})?{_V}{_C}{_V}{_C}"
_HAS_VOWEL = f"^({_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"

_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _by_length(suffixes) -> list[str]:
    return sorted(suffixes, key=lambda s: (-len(s), s))


def _dialect(duckdb: bool):
    matches = (lambda x, p: f"regexp_matches({x}, '{p}')") if duckdb else (lambda x, p: f"({x} RLIKE '{p}')")
    return matches, (lambda n: f"left(w, CAST(length(w) - {n} AS INT))")


def steps(duckdb: bool = False) -> list[str]:
    """SQL expressions over w, to be applied one after the other to words of three letters or more whose first y is Y."""
    matches, cut = _dialect(duckdb)

    def rules(pairs: dict[str, str], measure: str) -> str:
        whens = (f"WHEN w LIKE '%{s}' THEN CASE WHEN {matches(cut(len(s)), measure)} THEN concat({cut(len(s))}, '{to}') ELSE w END" for s in _by_length(pairs) for to in [pairs[s]])
        return f"CASE {' '.join(whens)} ELSE w END"

    one_a = f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {cut(1)} ELSE w END"
    # A word that loses ed or ing gets the mark | for the step after.
    one_b = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {matches(cut(3), _M0)} THEN {cut(1)} ELSE w END"
        f" WHEN w LIKE '%ed' THEN CASE WHEN {matches(cut(2), _HAS_VOWEL)} THEN concat({cut(2)}, '|') ELSE w END"
        f" WHEN w LIKE '%ing' THEN CASE WHEN {matches(cut(3), _HAS_VOWEL)} THEN concat({cut(3)}, '|') ELSE w END ELSE w END"
    )
    doubled = f"substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND {matches(cut(1), '[^aeiouylsz]$')} AND length(w) > 2"
    one_b2 = (
        f"CASE WHEN w NOT LIKE '%|' THEN w WHEN w LIKE '%at|' OR w LIKE '%bl|' OR w LIKE '%iz|' THEN concat({cut(1)}, 'e')"
        f" WHEN {doubled} THEN {cut(2)} WHEN {matches(cut(1), _CVC)} THEN concat({cut(1)}, 'e') ELSE {cut(1)} END"
    )
    one_c = f"CASE WHEN w LIKE '%y' AND {matches(cut(1), _HAS_VOWEL)} THEN concat({cut(1)}, 'i') ELSE w END"
    four = dict.fromkeys(_STEP4, "")
    whens = [(s, f"WHEN w LIKE '%{s}' THEN CASE WHEN {matches(cut(len(s)), _M2)} THEN {cut(len(s))} ELSE w END") for s in four]
    whens.append(("ion", f"WHEN w LIKE '%ion' THEN CASE WHEN {matches(cut(3), _M2)} AND {matches(cut(3), '[st]$')} THEN {cut(3)} ELSE w END"))
    step4 = f"CASE {' '.join(sql for _, sql in sorted(whens, key=lambda x: (-len(x[0]), x[0])))} ELSE w END"
    five_a = f"CASE WHEN w LIKE '%e' AND ({matches(cut(1), _M2)} OR ({matches(cut(1), _M1)} AND NOT {matches(cut(1), _CVC)})) THEN {cut(1)} ELSE w END"
    five_b = f"CASE WHEN w LIKE '%ll' AND {matches('w', _M2)} THEN {cut(1)} ELSE w END"
    return [one_a, one_b, one_b2, one_c, rules(_STEP2, _M0), rules(_STEP3, _M0), step4, five_a, five_b]


def stem_sql(word: str) -> str:
    """Spark's SQL for the stem of a column.

    Each step is bound to w by a lambda: as a projection over the one before, its many uses of w would multiply whenever the optimizer moves a filter through all steps.
    """
    w = f"CASE WHEN {word} LIKE 'y%' THEN concat('Y', substr({word}, 2)) ELSE {word} END"
    last = "CASE WHEN w LIKE 'Y%' THEN concat('y', substr(w, 2)) ELSE w END"
    for step in [*steps(), last]:
        w = f"transform(array({w}), w -> {step})[0]"
    return f"CASE WHEN length({word}) <= 2 THEN {word} ELSE {w} END"


def stem_vocabulary(words: DataFrame, word: str = "term", out: str = "stem") -> DataFrame:
    """words with their stems in one more column; meant for distinct words."""
    return words.selectExpr("*", f"{stem_sql(f'`{word}`')} AS `{out}`")


def duckdb_stems(words: str) -> str:
    """DuckDB SQL: (term, stem) of the relation words, which has the column term."""
    sql = f"SELECT term, CASE WHEN term LIKE 'y%' THEN concat('Y', substr(term, 2)) ELSE term END AS w FROM {words}"
    for step in steps(duckdb=True):
        sql = f"SELECT term, {step} AS w FROM ({sql})"
    return f"SELECT term, CASE WHEN length(term) <= 2 THEN term WHEN w LIKE 'Y%' THEN concat('y', substr(w, 2)) ELSE w END AS stem FROM ({sql})"


def _kinds(w: str) -> str:
    """c for each consonant, v for each vowel; in one pass, as words may be of any length."""
    out, last = [], "v"
    for c in w:
        last = "v" if c in "aeiou" or (c == "y" and out and last == "c") else "c"
        out.append(last)
    return "".join(out)


def _consonant(w: str, i: int) -> bool:
    return _kinds(w[: i + 1])[i] == "c"


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def stem(w: str | None) -> str | None:
    """The stem of one word in lower case, by the published rules."""
    if w is None or len(w) <= 2:
        return w
    vowel = lambda s: "v" in _kinds(s)
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) >= 2 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for s in _by_length(table):
            if w.endswith(s):
                w = w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > 0 else w
                break
    for s in _by_length([*_STEP4, "ion"]):
        if w.endswith(s):
            if _measure(w[: -len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


#: So many words keep their stems in a task.
_KEPT = 500_000


def stem_lists(df: DataFrame, column: str) -> DataFrame:
    """df with the words of an array column stemmed where they are: a task stems each word once, and nothing is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            at = batch.schema.get_field_index(column)
            lists = batch.column(at)
            coded = lists.flatten().dictionary_encode()
            if len(stems) > _KEPT:
                stems.clear()
            words = coded.dictionary.to_pylist()
            for w in words:
                if w not in stems:
                    stems[w] = stem(w)
            flat = pa.array([stems[w] for w in words], pa.string()).take(coded.indices)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(task, df.schema)
