"""HTML extraction (operator 1): site template removal by counting hashed element subtrees for each host.

1. Each page is parsed (a tokenizer of its own, linear in the page, with HTML's void elements, raw text and implied end tags),
   and each element gets a Merkle hash of its name, attributes, text and children.
2. Spark counts, for each host and hash, the pages that hold it, pages whose other text agrees as well as one; partial counts are
   made before the shuffle, and a hot host is spread over its hashes.
3. A subtree that recurs on MIN_PAGES pages of a host is template; on a host of more than MIN_PAGES / SHARE pages, the number grows with the
   logarithm of the host's pages (5 up to 500 pages, 32 at 100000). From each page the
   outermost template subtrees are deleted, and the text of the rest is extracted: entities decoded, white space
   collapsed, a line for each block.

Elements count however much of their page's text they hold. What copies of a page have in common is not template, as the rest of these pages
agrees too. Script, style, head and comments give no text. Pages are counted by row: rows that agree in all columns are one page.

Defined results: null html gives null text, empty html empty text; pages with null or unreadable url share the host ''. Null ids stay null; each row
gives a row, equal rows too; broken markup is read as far as it can be, a "<" that opens nothing is text; an empty table gives none; other columns are
passed over.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, column, discard, materialise, row_keys

MIN_PAGES, SHARE = 5, 0.01

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head script style noscript template title textarea svg math iframe object select".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of this name ends an open one of these, up to the nearest of the fences.
_ENDS = {name: (frozenset({"p"}), frozenset({"button", "td", "th", "table"})) for name in _BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}}
_ENDS |= {"li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"}))}
_ENDS |= {"td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"}))}
#: What an open head holds; any other start tag, and text, ends it (</head> may be omitted).
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")


class Element:
    __slots__ = ("attributes", "children", "hash", "name", "size", "sum")

    def __init__(self, name: str, attributes: str):
        self.name, self.attributes, self.children, self.hash, self.size, self.sum = name, attributes, [], 0, 0, 0


def parse(page: str) -> Element:
    """The tree of a page: children are elements and strings."""
    root = Element("#page", "")
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = {"#page": [0]}  # of the open elements of each name in stack
    unclosed: set[str] = set()

    def top(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def close(k: int) -> None:
        for e in stack[k:]:
            places[e.name].pop()
        del stack[k:]

    def end_head() -> None:
        if top("template") < top("head"):
            close(top("head"))

    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            if stack[-1].name == "head" and not page[at:i].isspace():
                end_head()
            stack[-1].children.append(page[at:i])
            at = i
            if at >= n:
                break
        if page.startswith("<!--", at) and "-->" not in unclosed:
            end = page.find("-->", at + 4)
            if end >= 0:
                at = end + 3
                continue
            unclosed.add("-->")
        m = _TAG.match(page, at)
        if not m:
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if top(name) > 0:
                close(top(name))
            continue
        if top("head") > 0 and name not in _HEAD:
            end_head()
        if rule := _ENDS.get(name):
            ends, fences = rule
            fence = max(0, *map(top, fences))
            if cuts := [places[x][k] for x in ends if places.get(x) and (k := bisect_right(places[x], fence)) < len(places[x])]:
                close(min(cuts))
        e = Element(name, m[3] if m[2] else m[6] or "")
        stack[-1].children.append(e)
        if name in _VOID or e.attributes.endswith("/"):
            continue
        if name in _RAW and name not in unclosed:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                if end.start() > at:
                    e.children.append(page[at : end.start()])
                at = end.end()
                continue
            unclosed.add(name)
        places.setdefault(name, []).append(len(stack))
        stack.append(e)
    return root


def _order(root: Element) -> list[Element]:
    """Elements, parents before children; no recursion, for deep pages."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    return out


def hashed(page: str) -> tuple[Element, list[Element]]:
    """The tree, with each element's hash, the size of its visible text and the sum of the hashes of its pieces; its elements in document order."""
    root = parse(page)
    order = _order(root)
    for e in reversed(order):
        parts = [e.name]
        if e.attributes:
            parts += sorted(f"{k.lower()}={a or b or c}" for k, a, b, c in _ATTRIBUTE.findall(e.attributes))
        size = total = 0
        for c in e.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    parts.append("t" + text)
                    size += len(text)
                    total += xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
            else:
                parts.append("e%x" % c.hash)
                size += c.size
                total += c.sum
        e.size, e.sum = (0, 0) if e.name in _SILENT else (size, total)
        e.hash = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return root, order


def candidates(page: str | None) -> dict[int, int]:
    """The hashes of the subtrees of a page that may be template, those with text, each with a hash of the page's other text."""
    if not page:
        return {}
    root, order = hashed(page)
    return {e.hash: ((root.sum - e.sum) & ((1 << 64) - 1)) - (1 << 63) for e in order[1:] if e.size > 0}


def extract(page: str | None, template: frozenset[int] | set[int]) -> tuple[str | None, int]:
    """The text of a page without its template subtrees, and how many were deleted."""
    if page is None:
        return None, 0
    root, _ = hashed(page)
    removed, out = 0, []
    todo: list[Element | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.name in _SILENT:
            continue
        if x.hash in template and x is not root and x.size > 0:
            removed += 1
            out.append("\n" if x.name in _BLOCK else " ")
            continue
        block = x.name in _BLOCK
        if block:
            out.append("\0")
            todo.append("\0")
        todo += reversed(x.children)
    lines = (" ".join(html.unescape(line).split()) for line in "".join(s if s == "\0" else s.replace("\0", " ") for s in out).split("\0"))
    return "\n".join(x for x in lines if x), removed


def host_of(url):
    """The host of a URL column in lower case, '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1), F.lit(""))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, text, removed) for each row of pages.

    Templates meet pages by a broadcast of each host's hashes if these take at most limit bytes, else by a shuffle on the
    rows' keys, which doesn't depend on how large a host is.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    r1, r2 = row_keys(F.col("page_id"), F.col("url"), F.col("html"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), r1.alias("r1"), r2.alias("r2"), "html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(h.as_py()) for h in column(batch, "html")]
            lists = [pa.array([list(x) for x in part], pa.list_(pa.int64())) for part in (found, [x.values() for x in found])]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("r1", "r2", "host")), *lists], ["r1", "r2", "host", "hashes", "rests"])

    seen = own.filter("html IS NOT NULL").mapInArrow(count, "r1 bigint, r2 bigint, host string, hashes array<bigint>, rests array<bigint>")
    seen = materialise(seen.dropDuplicates(["r1", "r2"]))
    each = seen.select("r1", "r2", "host", F.explode("hashes").alias("hash"))
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages"))
    met = seen.select("host", F.explode(F.arrays_zip("hashes", "rests")).alias("x")).select("host", F.col("x.hashes").alias("hash"), F.col("x.rests").alias("rest")).distinct()
    often = met.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    needed = min_pages * (1 + F.log(F.greatest(F.lit(1.0), F.col("pages") * share / max(min_pages, 1))))
    template = materialise(often.join(sizes, "host").filter(F.col("n") >= needed).select("host", "hash"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, frozenset()
        for batch in batches:
            out = []
            for page, hashes in zip(column(batch, "html"), column(batch, "hashes")):
                values = hashes.values if hashes.is_valid else None
                if values is None:
                    known, last = frozenset(), None
                elif last is None or not values.equals(last):
                    known, last = frozenset(values.to_pylist()), values
                out.append(extract(page.as_py(), known))
            texts, removed = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "host"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["page_id", "host", "text", "removed"])

    if template.count() * 48 <= limit:
        lists = F.broadcast(template.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes")))
        joined = own.join(lists, "host", "left")
        discard(seen)
    else:
        lists = each.join(template, ["host", "hash"]).groupBy("r1", "r2").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
        joined = own.join(lists, ["r1", "r2"], "left")
    return joined.select("page_id", "host", "html", "hashes").mapInArrow(delete, "page_id bigint, host string, text string, removed bigint")
