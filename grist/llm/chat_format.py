"""Chat formatting (operator 7): tool-call linking.

A turn is plain text, or a JSON object that the public chat conventions use:
  tools       {"tools": [{"name": .., "parameters": <JSON Schema>}, ..]} (also inside {"function": ..}) declares schemas for the conversation
  calls       {"content": .., "tool_calls": [{"id": .., "name": .., "arguments": ..}, ..]} (also {"function": {"name", "arguments"}}; arguments as
              an object or as a JSON string)
  result      {"tool_call_id": .., "content": ..}
An argument {"$result": id} stands for the result of another call.

Calls and results are hash-joined by (conversation, identifier). The turns, calls and results of a conversation are then ordered
topologically: a call after the turn that makes it and after the results that its arguments name, a result after its call, otherwise by
turn (Kahn's algorithm, the least turn first). Arguments are validated against the schema of the tool, and the whole is serialised as canonical JSON:
keys sorted, no white space, no escapes but those that JSON demands, whole numbers without fraction.

Rows of the result: (conv_id, chat, messages, calls, linked, problems). problems, in order, are
  no_result:ID, no_call:ID, duplicate_call:ID, duplicate_result:ID, unknown_tool:ID, invalid_arguments:ID:PATH, unchecked_keyword:ID:KEYWORD, cycle:ID

Schemas are checked by the keywords of JSON Schema 2020-12 and the older forms of items, dependencies and definitions, $ref within the schema.
A keyword that can't be checked (a $ref that leads nowhere or elsewhere, $dynamicRef, unevaluated..., a format without a check here, a value of the wrong
kind, an unknown keyword) is reported as unchecked_keyword; annotations and keywords that begin with x- are passed over.

Defined results: rows that agree in conv_id, turn, role and text are one message. A row with null conv_id is a conversation of its own, without id, as nothing
says what it belongs to. Null turns come first; rows of equal turn are ordered by role, then text, and calls follow the very row that makes them; a null role or text
is JSON null, an empty text "". Text that isn't a JSON object of these forms, or is nested too deep for a parser, is plain, however long. Identifiers that aren't
strings stand for their canonical JSON; a tool's name that isn't a string is unknown. Numbers that no double holds are null. Arguments too deep to be checked,
and patterns that take longer than PATTERN_SECONDS for a value, are reported as unchecked_keyword. The first of equal call identifiers takes the first result. Nodes on a
cycle follow at the end, by turn. An empty table gives none; other columns are passed over.
"""

from __future__ import annotations

import heapq
import ipaddress
import json
import math
import re
from collections.abc import Iterator, Mapping
from datetime import date
from fractions import Fraction
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, row_keys

#: A pattern of a schema is data, and may take for ever.
PATTERN_SECONDS = 2.0


def _whole(s: str) -> str:
    """s with ? for halves of surrogate pairs, which UTF-8 doesn't have."""
    return s.encode("utf-8", "replace").decode("utf-8")


def _scalar(v: Any) -> str:
    if isinstance(v, float):
        v = (int(v) if v.is_integer() and abs(v) < 1e21 else v) if math.isfinite(v) else None
    return json.dumps(v, ensure_ascii=False)


def _deep(x: Any) -> str:
    """canonical() by a stack of its own, for values nested deeper than the interpreter recurses."""
    out: list[str] = []
    todo: list[Any] = [(x,)]  # values in tuples, and strings to be written as they are
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
            continue
        v = v[0]
        if isinstance(v, dict):
            parts: list[Any] = ["{"]
            for k, key in enumerate(sorted(v)):
                parts += ["," if k else "", _scalar(key) + ":", (v[key],)]
            todo += reversed([*parts, "}"])
        elif isinstance(v, list):
            parts = ["["]
            for k, w in enumerate(v):
                parts += ["," if k else "", (w,)]
            todo += reversed([*parts, "]"])
        else:
            out.append(_scalar(v))
    return "".join(out)


def canonical(x: Any) -> str:
    """Canonical JSON of a parsed value."""

    def plain(v: Any) -> Any:
        if isinstance(v, float):
            return (int(v) if v.is_integer() and abs(v) < 1e21 else v) if math.isfinite(v) else None
        if isinstance(v, dict):
            return {k: plain(w) for k, w in v.items()}
        return [plain(w) for w in v] if isinstance(v, list) else v

    try:
        return _whole(json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    except RecursionError:
        return _whole(_deep(x))


def _name(x: Any) -> str:
    """An identifier as text."""
    return _whole(x) if isinstance(x, str) else canonical(x)


def _parsed(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


#: These say nothing about values, or are read with another keyword.
_SILENT = frozenset(
    "$schema $id $anchor $comment $defs $vocabulary definitions title description default example examples deprecated readOnly writeOnly contentEncoding contentMediaType contentSchema then else minContains maxContains additionalItems".split()
)
_TIME = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)"


def _date(s: str) -> bool:
    return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", s, re.A)) and bool(date.fromisoformat(s))


def _regex(s: str) -> bool:
    return bool(regex.compile(s))


#: A check raises ValueError or re.error, or gives False, where a string hasn't the format.
_FORMATS = {
    "date": _date,
    "time": lambda s: bool(re.fullmatch(_TIME, s, re.I | re.A)),
    "date-time": lambda s: bool(re.fullmatch(r".{10}T" + _TIME, s, re.I | re.A)) and _date(s[:10]),
    "email": lambda s: bool(re.fullmatch(r"[^\s@]+@[^\s@]+", s)),
    "ipv4": lambda s: bool(ipaddress.IPv4Address(s)) or True,
    "ipv6": lambda s: "%" not in s and (bool(ipaddress.IPv6Address(s)) or True),
    "uri": lambda s: bool(re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*", s)),
    "uuid": lambda s: bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s)),
    "regex": _regex,
}


def _holds(pattern: str, value: str) -> bool:
    """Whether the pattern is found in value; TimeoutError if that takes too long."""
    return bool(regex.search(pattern, value, timeout=PATTERN_SECONDS))


def _resolve(ref: Any, root: Any) -> Any:
    """What a $ref within root stands for; LookupError or ValueError if it is elsewhere or nowhere."""
    if not isinstance(ref, str) or not ref.startswith("#"):
        raise LookupError(ref)
    if len(ref) > 1 and ref[1] != "/":
        todo = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, dict) and x.get("$anchor") == ref[1:]:
                return x
            todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        raise LookupError(ref)
    at = root
    for part in ref[2:].split("/") if len(ref) > 1 else ():
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at[part]
    if not isinstance(at, (dict, bool)):
        raise LookupError(ref)
    return at


def violations(value: Any, schema: Any, path: str = "$", root: Any = None, unchecked: set[str] | None = None, refs: tuple[str, ...] = ()) -> list[str]:
    """Where value breaks the schema; the keywords that can't be checked are added to unchecked.

    root is the whole schema, refs what led to this schema at this same value.
    """
    root, unchecked = schema if root is None else root, set() if unchecked is None else unchecked
    if not isinstance(schema, dict):
        if not isinstance(schema, bool) and schema is not None:
            unchecked.add("schema")
        return [] if schema is not False else [path]
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # its value is known only when the call is made
    out: list[str] = []
    for keyword in schema:
        if keyword in _SILENT or keyword.startswith("x-"):
            continue
        try:
            broken = _broken(value, schema, keyword, path, root, unchecked, refs)
            if broken and keyword == "type":  # what else is wrong with a value of another type says nothing
                return [path]
            out += broken
        except (TypeError, AttributeError, ValueError, LookupError, ArithmeticError, RecursionError, TimeoutError, re.error, regex.error):
            unchecked.add(keyword)
    return list(dict.fromkeys(out))


def _broken(value: Any, schema: dict, keyword: str, path: str, root: Any, unchecked: set[str], refs: tuple[str, ...]) -> list[str]:
    """Where value breaks one keyword of schema."""
    x = schema[keyword]
    open_ = next(_references(value), None) is not None  # holds the result of a call, so that only part of it is known
    here = lambda bad: [path] if bad else []
    same = lambda s: violations(value, s, path, root, unchecked, refs)
    fits = lambda v, s: not violations(v, s, path, root, unchecked)
    part = lambda k, s: violations(value[k], s, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", root, unchecked)
    match keyword:
        case "type":
            kinds = [x] if isinstance(x, str) else x
            if not all(k in _TYPES or k in ("integer", "number") for k in kinds):
                raise ValueError(x)
            return here(not any(_is(value, k) for k in kinds))
        case "enum":
            return here(not open_ and canonical(value) not in {canonical(v) for v in x})
        case "const":
            return here(not open_ and canonical(value) != canonical(x))
        case "$ref":
            if x in refs:
                raise LookupError(x)  # it leads to itself
            return violations(value, _resolve(x, root), path, root, unchecked, (*refs, x))
        case "allOf":
            return [p for s in x for p in same(s)]
        case "anyOf":
            return here(all([same(s) for s in x]))
        case "oneOf":
            n = sum(not same(s) for s in x)
            return here(n == 0 or (n > 1 and not open_))
        case "not":
            return here(not same(x) and not open_)
        case "if":
            broken = same(x)
            if open_ and not broken:
                return []
            return same(schema.get("else" if broken else "then", True))
    if isinstance(value, dict):
        match keyword:
            case "required":
                return [f"{path}.{k}" for k in x if k not in value]
            case "properties":
                return [p for k in sorted(value) if k in x for p in part(k, x[k])]
            case "patternProperties":
                return [p for k in sorted(value) for name, s in x.items() if _holds(name, k) for p in part(k, s)]
            case "additionalProperties":
                known, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
                return [p for k in sorted(value) if k not in known and not any(_holds(name, k) for name in patterns) for p in part(k, x)]
            case "propertyNames":
                return [f"{path}.{k}" for k in sorted(value) if not fits(k, x)]
            case "minProperties":
                return here(len(value) < x)
            case "maxProperties":
                return here(len(value) > x)
            case "dependentRequired" | "dependentSchemas" | "dependencies":
                out = []
                for k in sorted(set(x) & set(value)):
                    out += [f"{path}.{n}" for n in x[k] if n not in value] if isinstance(x[k], list) else same(x[k])
                return out
    if isinstance(value, list):
        match keyword:
            case "minItems":
                return here(len(value) < x)
            case "maxItems":
                return here(len(value) > x)
            case "uniqueItems":
                return here(x and len({canonical(v) for v in value}) < len(value))
            case "prefixItems":
                return [p for i, s in enumerate(x[: len(value)]) for p in part(i, s)]
            case "items":
                if isinstance(x, list):  # the older form of prefixItems
                    every = [*x, *[schema.get("additionalItems", True)] * (len(value) - len(x))]
                    return [p for i in range(len(value)) for p in part(i, every[i])]
                return [p for i in range(len(schema.get("prefixItems") or ()), len(value)) for p in part(i, x)]
            case "contains":
                n = sum(fits(v, x) for v in value)
                return here(n < schema.get("minContains", 1) or (n > schema.get("maxContains", math.inf) and not open_))
    if isinstance(value, str):
        match keyword:
            case "minLength":
                return here(len(value) < x)
            case "maxLength":
                return here(len(value) > x)
            case "pattern":
                return here(not _holds(x, value))
            case "format":
                check = _FORMATS[x]
                try:
                    return here(not check(value))
                except (ValueError, re.error, regex.error):
                    return [path]
    if _is(value, "number"):
        match keyword:
            case "minimum":
                return here(value < x)
            case "maximum":
                return here(value > x)
            case "exclusiveMinimum":
                return here(value <= x)
            case "exclusiveMaximum":
                return here(value >= x)
            case "multipleOf":
                return here(Fraction(str(value)) % Fraction(str(x)) != 0)
    if keyword not in _KNOWN:
        raise LookupError(keyword)
    return []


#: Those that are for values of one kind only.
_KNOWN = frozenset(
    "required properties patternProperties additionalProperties propertyNames minProperties maxProperties dependentRequired dependentSchemas dependencies minItems maxItems uniqueItems prefixItems items contains minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf".split()
)


def _references(x: Any) -> Iterator[str]:
    todo = [x]
    while todo:
        v = todo.pop()
        if isinstance(v, dict) and set(v) == {"$result"}:
            yield _name(v["$result"])
        elif isinstance(v, (dict, list)):
            todo += v.values() if isinstance(v, dict) else v


def _items(text: str | None) -> tuple[str, list[tuple[str, str, str]], str | None, dict]:
    """(kind, [(identifier, name, JSON)], content, schemas) of a turn's text; name is JSON too."""
    x = _parsed(text)
    if x and isinstance(x.get("tool_calls"), list) and all(isinstance(c, dict) for c in x["tool_calls"]):
        calls = []
        for c in x["tool_calls"]:
            f = c.get("function") if isinstance(c.get("function"), dict) else c
            args = f.get("arguments")
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except (ValueError, RecursionError):
                    pass
            calls.append((_name(c.get("id")), canonical(f.get("name")), canonical(args)))
        content = x.get("content")
        return "calls", calls, content if content is None else _name(content), {}
    if x and "tool_call_id" in x:
        return "result", [(_name(x["tool_call_id"]), "null", canonical(x.get("content")))], None, {}
    if x and isinstance(x.get("tools"), list) and all(isinstance(t, dict) for t in x["tools"]):
        tools = [t["function"] if isinstance(t.get("function"), dict) else t for t in x["tools"]]
        return "tools", [], canonical(x), {t["name"]: t.get("parameters", True) for t in tools if isinstance(t.get("name"), str)}
    return "text", [], text if text is None else _whole(text), {}


def _read(text: str) -> tuple[Any, bool]:
    """The value of canonical JSON, and whether it could be read; what is nested too deep can't."""
    try:
        return json.loads(text), True
    except (ValueError, RecursionError):
        return None, False


def assemble(messages: list[dict], schemas: Mapping[str, Any] | None = None) -> tuple[str, int, int, int, list[str]]:
    """(chat, messages, calls, linked, problems) of one conversation.

    messages: kind, row (of the conversation), role, id, name, content (JSON but for messages), repeat, linked, schemas; in the order of their turns.
    """
    known = dict(schemas or {})
    for m in messages:
        known |= m.get("schemas") or {}
    problems: list[str] = []
    after: dict[int, list[int]] = {i: [] for i in range(len(messages))}
    waits = [0] * len(messages)
    message_at = {m["row"]: i for i, m in enumerate(messages) if m["kind"] == "message"}
    call_at = {m["id"]: i for i, m in enumerate(messages) if m["kind"] == "call" and not m["repeat"]}
    result_at = {m["id"]: i for i, m in enumerate(messages) if m["kind"] == "result" and m["linked"]}

    def edge(a: int, b: int) -> None:
        after[a].append(b)
        waits[b] += 1

    for i, m in enumerate(messages):
        if m["kind"] == "call":
            edge(message_at[m["row"]], i)
            m["value"], m["read"] = _read(m["content"])
            for r in sorted(set(_references(m["value"]))):
                if r in result_at:
                    edge(result_at[r], i)
        elif m["kind"] == "result" and m["linked"]:
            edge(call_at[m["id"]], i)
    ready = [i for i in range(len(messages)) if not waits[i]]
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)
        order.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    stuck = sorted(set(range(len(messages))) - set(order))
    cyclic = set(stuck)
    out, calls, linked = [], 0, 0
    for i in order + stuck:
        m = messages[i]
        if m["kind"] == "call":
            calls += 1
            ident, name = m["id"], _read(m["name"])[0]
            out.append(f'{{"arguments":{m["content"]},"id":{_scalar(ident)},"name":{m["name"]},"type":"call"}}')
            if m["repeat"]:
                problems.append(f"duplicate_call:{ident}")
            elif m["linked"]:
                linked += 1
            else:
                problems.append(f"no_result:{ident}")
            if not isinstance(name, str) or name not in known:
                problems.append(f"unknown_tool:{ident}")
            elif not m["read"]:
                problems.append(f"unchecked_keyword:{ident}:schema")
            else:
                unchecked: set[str] = set()
                problems += [f"invalid_arguments:{ident}:{p}" for p in violations(m["value"], known[name], unchecked=unchecked)]
                problems += [f"unchecked_keyword:{ident}:{k}" for k in sorted(unchecked)]
        elif m["kind"] == "result":
            out.append(f'{{"content":{m["content"]},"id":{_scalar(m["id"])},"type":"result"}}')
            if not m["linked"]:
                problems.append(("duplicate_result:" if m["repeat"] else "no_call:") + m["id"])
        else:
            out.append(f'{{"content":{_scalar(m["content"])},"role":{_scalar(m["role"])},"type":"message"}}')
        if i in cyclic and m["kind"] != "message":
            problems.append(f"cycle:{m['id']}")
    return "[" + ",".join(out) + "]", sum(m["kind"] == "message" for m in messages), calls, linked, [_whole(p) for p in problems]


_KEY = ["none", "k1", "k2"]
_COLUMNS = ["none", "k1", "k2", "row", "role", "kind", "at", "id", "name", "content", "schemas"]
_PARTS = "none boolean, k1 bigint, k2 bigint, row bigint, role string, kind string, at bigint, id string, name string, content string, schemas string"


def format_chats(conversations: DataFrame, schemas: Mapping[str, Any] | None = None) -> DataFrame:
    """(conv_id, chat, messages, calls, linked, problems), a row for each conversation."""
    c = conversations
    own = c.select(c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].cast("bigint").alias("turn"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))
    r1, r2 = row_keys(F.col("turn"), F.col("role"), F.col("text"))
    # A conversation is known by its id, or else by its one row.
    own = own.withColumns({"none": F.col("conv_id").isNull(), "k1": F.coalesce("conv_id", r1), "k2": F.when(F.col("conv_id").isNull(), r2).otherwise(0)})
    own = own.select(*_KEY, "turn", "role", "text").repartition(*_KEY).sortWithinPartitions(*_KEY, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = last = None
        row = 0
        types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for none, k1, k2, turn, role, text in zip(*(column(batch, x).to_pylist() for x in (*_KEY, "turn", "role", "text"))):
                key = (none, k1, k2)
                if key != current:
                    current, last, row = key, None, 0
                if last == (turn, role, text):
                    continue
                last, row = (turn, role, text), row + 1
                kind, items, content, tools = _items(text)
                if kind == "result":
                    rows.append((*key, row, role, "result", 0, *items[0], None))
                    continue
                rows.append((*key, row, role, "message", 0, None, None, content, canonical(tools) if tools else None))
                rows += [(*key, row, role, "call", 1 + k, *x, None) for k, x in enumerate(items)]
            parts = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(p), t) for p, t in zip(parts, types)], _COLUMNS)

    parts = materialise(own.mapInArrow(parse, _PARTS))
    ends = parts.filter("kind <> 'message'").withColumn("nth", F.row_number().over(Window.partitionBy(*_KEY, "id", "kind").orderBy("row", "at")))
    calls = ends.filter("kind = 'call' AND nth = 1").select(*_KEY, "id")
    results = ends.filter("kind = 'result' AND nth = 1").select(*_KEY, "id")
    # Only the first call and the first result of an identifier meet; nth > 1 are repeats.
    met = calls.join(results.hint("shuffle_hash"), [*_KEY, "id"]).withColumn("linked", F.lit(True))
    ends = ends.join(met.hint("shuffle_hash"), [*_KEY, "id"], "left").withColumn("repeat", F.col("nth") > 1)
    ends = ends.withColumn("linked", F.coalesce("linked", F.lit(False)) & ~F.col("repeat")).drop("nth")
    plain = parts.filter("kind = 'message'").withColumns({"linked": F.lit(False), "repeat": F.lit(False)})
    together = plain.unionByName(ends).repartition(*_KEY).sortWithinPartitions(*_KEY, "row", "at")
    given = dict(schemas or {})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        current = None

        def flush() -> tuple:
            for m in held:
                m["schemas"] = _read(m["schemas"])[0] if m["schemas"] else None
            done = (None if held[0]["none"] else held[0]["k1"], *assemble(held, given))
            held.clear()
            return done

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            parts = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(list(p), t) for p, t in zip(parts, types)], ["conv_id", "chat", "messages", "calls", "linked", "problems"])

        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                key = (m["none"], m["k1"], m["k2"])
                if key != current:
                    if held:
                        rows.append(flush())
                    current = key
                held.append(m)
            yield batch_of(rows)
        if held:
            yield batch_of([flush()])

    return together.mapInArrow(build, "conv_id bigint, chat string, messages bigint, calls bigint, linked bigint, problems array<string>")
