"""Pages as node trees, and selectors over them.

Python reads a page once: its pieces of text in order, and its elements as places (of the element, its parent, its last
descendant) and as the range of pieces that lie in it.  No text is stored twice, however elements nest.  All else, selectors
included, is column functions, which cut the text of those elements that are asked for.

A selector is a list of alternatives with commas; each is a chain of simple selectors (tag, #id, .class, [attribute] with
=, ^=, $=, *=; attributes are id, class, name and href) joined by white space (inside) or `>` (child).

Defined results: a null or empty page has no pieces and no elements; an element that is never closed ends with its parent; an
end tag without an element is passed over; text in script, style and noscript isn't text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Elements that hold no text, and such as have no end.
SILENT = ("script", "style", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: The tag of a piece of text that stands among elements.
TEXT = "#text"

_FIELDS = [("pos", "int"), ("tag", "string"), ("id", "string"), ("cls", "string"), ("name", "string"), ("href", "string"), ("parent", "int"), ("last", "int"), ("begin", "int"), ("end", "int")]
NODE = T.StructType([T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in _FIELDS])
TREE = T.StructType([T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("nodes", T.ArrayType(NODE))])
_ARROW = pa.struct([("pieces", pa.list_(pa.string())), ("nodes", pa.list_(pa.struct([(n, pa.int32() if k == "int" else pa.string()) for n, k in _FIELDS])))])


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.pieces: list[str] = []
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.tags: Counter[str] = Counter()
        self.data: list[str] = []
        self.silent = 0

    def _add(self, tag: str, attrs: dict) -> int:
        pos = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        given = {"id": attrs.get("id"), "cls": attrs.get("class"), "name": attrs.get("name"), "href": attrs.get("href")}
        self.nodes.append({"pos": pos, "tag": tag, **given, "parent": parent, "last": pos, "begin": len(self.pieces), "end": len(self.pieces)})
        return pos

    def flush(self) -> None:
        """Data between two tags is one piece; tags without text between them leave none."""
        text = "".join(self.data).strip()
        self.data.clear()
        if text and not self.silent:
            node = self._add(TEXT, {})
            self.pieces.append(text)
            self.nodes[node]["end"] += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        self.silent += tag in SILENT
        pos = self._add(tag, {k: v for k, v in reversed(attrs)})
        if tag not in VOID:
            self.open.append(pos)
            self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()
        self._add(tag, {k: v for k, v in reversed(attrs)})

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if not self.tags[tag]:
            return
        while self.close_last() != tag:
            pass

    def close_last(self) -> str:
        node = self.nodes[self.open.pop()]
        node["last"], node["end"] = len(self.nodes) - 1, len(self.pieces)
        self.tags[node["tag"]] -= 1
        self.silent -= node["tag"] in SILENT
        return node["tag"]

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()


def tree_of(html: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    while reader.open:
        reader.close_last()
    return {"pieces": reader.pieces, "nodes": reader.nodes}


def page_trees(df: DataFrame, html_col: str = "html", tree_col: str = "tree") -> DataFrame:
    """df with the tree of each page in a column."""
    at, names = df.columns.index(html_col), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [tree_of(h) for h in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _ARROW)], [*names, tree_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(tree_col, TREE)]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def node_text(tree: Column, node: Column, joint: str = " ") -> Column:
    """The pieces in an element, joined; null for no element."""
    return let(node, lambda n: F.array_join(F.slice(tree["pieces"], n["begin"] + 1, n["end"] - n["begin"]), joint))


def _simple(text: str, n: Column) -> Column:
    """A node is what a simple selector says."""
    parts = re.findall(r"""^[\w#*-]+?(?=[#.\[]|$)|#[\w-]+|\.[\w-]+|\[[^\]]*\]""", text)
    if "".join(parts) != text:
        raise ValueError(f"selector not understood: {text}")
    tests = []
    for p in parts:
        if p[0] == "#" and p != TEXT:
            tests.append(n["id"] == p[1:])
        elif p[0] == ".":
            tests.append(F.array_contains(F.split(n["cls"], r"\s+"), p[1:]))
        elif p[0] == "[":
            name, op, value = re.fullmatch(r"""\[([\w-]+)(?:([\^$*]?=)["']?(.*?)["']?)?\]""", p).groups()
            field = n["cls" if name == "class" else name]
            tests.append(field.isNotNull() if op is None else {"=": field.__eq__, "^=": field.startswith, "$=": field.endswith, "*=": field.contains}[op](value))
        elif p != "*":
            tests.append(n["tag"] == p)
    return F.coalesce(reduce(lambda a, b: a & b, tests, n["tag"] != TEXT), F.lit(False))


def below(tree: Column, node: Column) -> Column:
    """The nodes inside an element; none for no element.  Nodes stand at their places, so no others are looked at."""
    return F.slice(tree["nodes"], F.coalesce(node["pos"], F.lit(0)) + 2, F.coalesce(node["last"] - node["pos"], F.lit(0)))


def select(tree: Column, selector: str, inside: Column | None = None) -> Column:
    """The elements of a tree that a selector finds, in document order; inside: below that element only."""
    nodes = tree["nodes"]

    def chain(steps: list[str], n: Column) -> Column:
        here = _simple(steps[-1], n)
        if len(steps) == 1:
            return here
        child, rest = (True, steps[:-2]) if steps[-2] == ">" else (False, steps[:-1])
        # `&` stops at the first false, so the nodes above are looked for only where the last step holds.
        above = F.filter(nodes, lambda m: chain(rest, m))
        return here & F.exists(above, (lambda m: n["parent"] == m["pos"]) if child else (lambda m: (m["pos"] < n["pos"]) & (n["pos"] <= m["last"])))

    ways = [re.sub(r"\s*>\s*", " > ", s.strip()).split() for s in selector.split(",")]

    def found(n: Column) -> Column:
        return reduce(lambda a, b: a | b, [chain(w, n) for w in ways])

    if inside is None:
        return F.filter(nodes, found)
    return let(inside, lambda i: F.filter(below(tree, i), found))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def select_text(tree: Column, selector: str, joint: str = "", inside: Column | None = None) -> Column:
    """Text of the first element found; null if none is found or it has no text."""
    return F.nullif(node_text(tree, first(select(tree, selector, inside)), joint), F.lit(""))


def root(tree: Column) -> Column:
    """The whole page as an element."""
    return F.struct(F.lit(-1).alias("pos"), (F.size(tree["nodes"]) - 1).alias("last"), F.lit(0).alias("begin"), F.size(tree["pieces"]).alias("end"))


def grid(tree: Column, table: str) -> Column:
    """The rows of a table element as arrays of the cells that are their children; no rows if there is no such table."""
    cells = F.transform(select(tree, "tr", first(select(tree, table))), lambda r: F.filter(below(tree, r), lambda n: (n["parent"] == r["pos"]) & (n["tag"] == "td")))
    return F.coalesce(cells, F.array().cast(T.ArrayType(T.ArrayType(NODE))))


def siblings_until(tree: Column, start: Column, stops: Column) -> Column:
    """The nodes beside an element, from behind it up to the next of the stops (or any beside it), pieces of text included."""
    first_stop = F.coalesce(F.array_min(F.transform(F.filter(stops, lambda s: (s["pos"] > start["pos"]) & (s["parent"] == start["parent"])), lambda s: s["pos"])), F.lit(1 << 30))
    return let(first_stop, lambda stop: F.filter(tree["nodes"], lambda n: (n["parent"] == start["parent"]) & (n["pos"] > start["last"]) & (n["pos"] < stop)))
