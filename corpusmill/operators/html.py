"""Pages to text: node trees (see dom.py) to blocks, sections and links, by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import normalize_space
from .dom import first, let, node_text, select

#: Block tags and their marks, texts that are navigation.
MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "p": "", "li": "- "}
NAVIGATION = ("Top", "21.1.1")
#: Dotted leaders of an index, and the headings that a converter puts before a file and its pages.
LEADERS = r"(?m)^.{0,80}(?:\.\s){5,}"
PAGE_HEADING = r"^(?:#\s+\S*\.pdf|##\s+Page\s+\d+)\s*$"


def markdownish(tree: Column) -> Column:
    """Headings, paragraphs and list items of the body as lines with marks; navigation and repeated lines left out."""
    marked = lambda n: n["tag"].isin(*MARKS) & (n["begin"] < n["end"])
    wanted = let(first(select(tree, "body")), lambda body: F.filter(tree["nodes"], lambda n: marked(n) & (body.isNull() | ((n["pos"] > body["pos"]) & (n["pos"] <= body["last"])))))
    blocks = F.filter(F.transform(wanted, lambda n: F.struct(n["tag"].alias("tag"), normalize_space(node_text(tree, n)).alias("text"))), lambda n: (n["text"] != "") & ~n["text"].isin(*NAVIGATION))
    marks = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    return F.array_join(F.transform(F.array_distinct(blocks), lambda n: F.concat(F.element_at(marks, n["tag"]), n["text"])), "\n\n")


def section_text(tree: Column, section: Column) -> Column:
    """Paragraphs from the one that holds the anchor `sec_<section>` up to the next beside it that holds a section's anchor.

    Null where the page has no such anchor, or none inside a paragraph.
    """
    nodes = tree["nodes"]
    named = F.filter(nodes, lambda n: (n["tag"] == "span") & n["id"].isNotNull())
    inside = lambda m, n: (m["pos"] > n["pos"]) & (m["pos"] <= n["last"])
    of = lambda name: first(F.filter(nodes, lambda n: n["id"] == F.concat(F.lit("sec_"), name)))
    anchor = F.coalesce(of(F.lower(section)), of(section))
    start = let(anchor, lambda a: let(F.filter(nodes, lambda n: (n["tag"] == "p") & inside(a, n)), lambda around: F.element_at(F.when(F.size(around) > 0, around), -1)))

    def body(start: Column, named: Column) -> Column:
        begins = lambda n: F.coalesce(first(F.filter(named, lambda m: inside(m, n)))["id"].startswith("sec_"), F.lit(False))
        beside = F.filter(nodes, lambda n: (n["parent"] == start["parent"]) & (n["pos"] > start["pos"]) & begins(n))
        own = let(F.coalesce(first(beside)["pos"], F.lit(1 << 30)), lambda stop: F.filter(nodes, lambda n: (n["tag"] == "p") & (n["parent"] == start["parent"]) & (n["pos"] >= start["pos"]) & (n["pos"] < stop)))
        texts = F.filter(F.transform(own, lambda n: normalize_space(node_text(tree, n))), lambda t: t != "")
        return F.when(start.isNotNull(), F.array_join(texts, "\n\n"))

    return let(start, lambda s: let(named, lambda m: body(s, m)))


def tag_text(tree: Column, tag: str, joint: str = "\n\n", skip: int = 0) -> Column:
    """Texts of all elements of a tag, joined; `skip` leaves out so many."""
    texts = F.filter(F.transform(select(tree, tag), lambda n: normalize_space(node_text(tree, n))), lambda x: x != "")
    return F.array_join(F.slice(texts, skip + 1, 1 << 20), joint)


def page_title(html: Column) -> Column:
    return normalize_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(df: DataFrame, html_col: str = "html") -> DataFrame:
    """One row for each different href of a page, in the order of first occurrence: other columns, pos, href."""
    return df.select(*(c for c in df.columns if c != html_col), F.posexplode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(r'href="([^"]+)"'), 1))).alias("pos", "href"))


def _without_dots(path: Column) -> Column:
    """A path with its `.` and `..` parts worked out; more `..` than there are folders stay at the top."""
    parts, last = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, p: F.when(p == ".", done).when(p == "..", up(done)).otherwise(F.concat(done, F.array(p)))
    kept = F.aggregate(F.slice(parts, 2, 1 << 20), F.array().cast("array<string>"), step)
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page, by the rules of relative references."""
    origin, path = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    plain, query = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(href.rlike("^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.split_part(base, F.lit("//"), F.lit(1)), href))
        .when(href == "", base).when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href)).when(href.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(plain), query)).otherwise(F.concat(origin, _without_dots(F.concat(folder, plain)), query))
    )


def link_tail(url: Column) -> Column:
    """The last part of a link's path."""
    return F.regexp_extract(url, r"([^/]*)$", 1)


def child_link(url: Column, root: Column, kind: str) -> Column:
    """A child of this kind directly under a code's root: `<root>_<kind>_...`."""
    return F.startswith(link_tail(url), F.concat(root, F.lit(f"_{kind}_")))


def deep_link(url: Column, root: Column, mark: str) -> Column:
    """A page of a code, at any depth, whose name has the mark."""
    tail = link_tail(url)
    return F.contains(tail, root) & F.contains(tail, F.lit(mark))


def numbered_link(url: Column, prefix: Column) -> Column:
    """A section of a flat code: `<prefix>_<digit...>`, which tells it from containers of the same prefix."""
    tail, mark = link_tail(url), F.concat(prefix, F.lit("_"))
    return F.startswith(tail, mark) & F.substr(tail, F.length(mark) + 1).rlike("^[0-9]")


def trim_index(text: Column) -> Column:
    """Cut at the first dotted-leader line (five or more of dot and white space within its first 80 characters) from the
    last section heading on."""
    before = F.regexp_extract(text, r"(?s)\A(.*(?:\A|\n))Sec\. [0-9A-Za-z\-]+\.", 1)
    there = text.rlike(r"(?m)^Sec\. [0-9A-Za-z\-]+\.")
    tail = F.substr(text, F.length(before) + 1)
    at = F.regexp_instr(tail, F.lit(LEADERS))
    return F.when(there & (at > 0), F.concat(F.regexp_replace(F.concat(before, F.left(tail, at - 1)), r"(?U)\s+\z", ""), F.lit("\n"))).otherwise(text)


def strip_scaffold(text: Column) -> Column:
    """Converted page text without its file title and page headings, runs of blank lines made one."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: ~x.rlike(PAGE_HEADING))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def class_overlap(classes: Column, *wanted: str) -> Column:
    """A node's class attribute holds any of the wanted classes."""
    return F.arrays_overlap(F.split(F.coalesce(classes, F.lit("")), r"\s+"), F.array(*map(F.lit, wanted)))


def strip_note(text: Column, pattern: str) -> Column:
    """Without the first match of a trailing note's pattern and all after it."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.regexp_replace(F.left(text, at - 1), r"\s+\z", "")).otherwise(text)


def slice_between(text: Column, start: str, end: str) -> Column:
    """From a marker up to another."""
    at = F.locate(start, text)
    rest = F.substr(text, at)
    stop = F.locate(end, rest)
    return F.when(at > 0, F.when(stop > 0, F.left(rest, stop - 1)).otherwise(rest))


def line_islands(df: DataFrame, key: str, text_col: str, is_heading: Column) -> DataFrame:
    """Lines grouped under the last heading line: key, island (0: before the first), pos, line, heading."""
    lines = df.select(key, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    order = W.partitionBy(key).orderBy("pos")
    return lines.withColumn("heading", is_heading).withColumn("island", F.sum(F.col("heading").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def longest_block(df: DataFrame, keys: list[str], length: Column, order: Column) -> DataFrame:
    """The longest row of each key, the first on a tie."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(length.desc(), order))).filter("__r = 1").drop("__r")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
