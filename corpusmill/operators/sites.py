"""Sections from pages by one rule a site: rules are data, the work is column functions over node trees.

SiteRule: a page is one section.  ElementRule: elements of a page begin its sections.  TextRule: headings in a page's text
begin its sections.  A pattern may hold {n}, which stands for the section's number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import normalize_space, section_title, trimmed
from .dom import TEXT, first, let, node_text, root, select, siblings_until
from .html import first_by, longest_block


@dataclass(frozen=True)
class SiteRule:
    key: str
    #: Containers, the first that a page has is taken; none: the whole page.
    body: tuple[str, ...] = ()
    #: Take the first container with text, not the first.
    filled: bool = False
    #: The container is the nearest such element around the first element whose text fits: selector, pattern, around.
    around: tuple[str, str, str] | None = None
    #: The first element inside the container whose text fits takes its place: selector, pattern.
    inner: tuple[str, str] | None = None
    #: Paragraphs of the container, joined by `joint`; none: its pieces of text are.
    parts: str | None = None
    joint: str = "\n"
    #: Paragraphs left out at the start; counted before or after those without text go.
    skip: int = 0
    skip_filled: bool = False
    keep_empty: bool = False
    #: Paragraphs before the first that fits are left out; of the others only `kept` ones stay.
    since: str | None = None
    kept: str | None = None
    #: Elements whose text is left out.
    drop: str | None = None
    #: Runs of white space become one space; no-break spaces become spaces.
    flat: bool = False
    plain: bool = False
    #: The body begins at this text, if the page has it.
    mark: str | None = None
    #: Patterns: taken off the head of the body; a note with all after it; a body that is no section.
    head: str | None = None
    note: str | None = None
    dead: str | None = None
    #: The title: first text of these elements that fits `where` ("body": of the body), `find`'s last group of it (or the whole, if
    #: `whole`), without what fits `cut`.
    title: str | None = None
    title_inside: bool = False
    title_after: str | None = None
    where: str | None = None
    find: str | None = None
    whole: bool = False
    cut: str | None = None


@dataclass(frozen=True)
class ElementRule:
    key: str
    start: str
    #: Pattern of the start's text, or selector and attribute below or at it, that gives the number.
    number: str | None = None
    number_in: tuple[str | None, str] | None = None
    inside: str | None = None
    #: "self": the start's own text; "beside": what stands beside it up to the next start; or a selector of the next such element.
    body: str = "self"
    beside: str | None = None
    with_start: bool = False
    pieces: bool = False
    joint: str = " "
    title: str | None = None
    title_next: bool = False
    cut: str | None = None
    note: str | None = None


@dataclass(frozen=True)
class TextRule:
    key: str
    heading: str
    title: str
    keep: str = "longest"
    between: tuple[str, str] | None = None
    drop: str | None = None
    note: str | None = None
    dead: str | None = None


#: How the sites mark bodies and titles.
SITE_RULES = (
    SiteRule("public_law", parts="section", joint="\n\n", flat=True, title="title"),
    SiteRule("va", ("section.body.editable",), title="h2", where="§", find=r"^§\s*[\w.:\-]+\s*\.?\s*(.*)", whole=True),
    SiteRule("oh", ("section.laws-body",), title="h1", where=r"\|", find=r"(?s)^[^|]*\|(.*)$"),
    SiteRule("mo", ("div.norm",), plain=True, title="div.norm span.bold", cut=r"^{n}\.\s*|—+\s*$"),
    SiteRule("me", ("div.MRSSection", "div.section-content"), plain=True, title="title", find=r"§\s*[0-9A-Za-z\-]+\s*:\s*(.+)$"),
    SiteRule("mn", ("div.section",), title="h1.shn", find=r"(?s)^\d+\.\w+\s+(.*)$", whole=True),
    SiteRule("vt", ("ul.statutes-detail",), title="b", title_inside=True, find=r"§\s*\d+\.\s*(.+)"),
    SiteRule("ak", ("div.statute",), joint=" ", dead=r"^\s*\[", title="b", title_inside=True, cut=r"^Sec\.\s*{n}\.\s*|\.+$"),
    SiteRule("wa", ("#contentWrapper > div",), filled=True, title="h2"),
    SiteRule("id", ("div.pgbrk",), inner=("div", r"^\d+-\d+\."), title="body", find=r"^\d+-\d+\.\s+(.+?\.)", cut=r"^\.+|\.+$"),
    SiteRule("la", ("#ctl00_PageBody_divLaw",), note=r"(?s)\n\s*(?:Amended by\s+)?Acts\s+\d{4}.*$", title="body", find=r"Art\.\s*\d+\.\s*([^\n]+)"),
    SiteRule("mt", ("div.section-content",), title="h1.section-section-title"),
    SiteRule("wv", ("#results-box .sec-head",), joint=" ", flat=True, title="body", find=r"§\s*{n}\.\s*(.+?)(?:\s*\([a-z]\)|$)"),
    SiteRule("ma", around=("p", r"^Section\s+\S+", "div.col-xs-12"), parts="p", joint="\n\n", title="h2", where="^Section.*:", find=r"(?s)^[^:]*:(.*)$"),
    SiteRule("mi", ("div.sectionWrapper",), parts="p", keep_empty=True, title="h1.h4", title_inside=True, find=r"(?s)^\S+\s+(.*)$", whole=True),
    SiteRule("nc", parts="p", joint="\n\n", skip=1, keep_empty=True, flat=True, plain=True, drop="a[name=HistoryNote]", title="span", title_after="a[name=GSDocumentHeader]", find=r"^§\s*[\w.\-]+\.\s*(.*)"),
    SiteRule("ne", ("div.statute",), parts="p.text-justify", joint="\n\n", title="h3", title_inside=True),
    SiteRule("ok", ("#oscn-content",), parts="p", joint="\n\n", skip=1, plain=True, title="title"),
    SiteRule("az", ("body",), parts="p", skip=1, skip_filled=True, title="title", find=r"(?s)^.*? - (.*)$"),
    SiteRule("hi", parts="p", joint="\n\n", since="^§", kept="p.RegularParagraphs, p.oneParagraph", flat=True, plain=True, title="p", where="^§", find=r"§\s*(?:[\d.\-]+)\s+(.+?\.)(?:\s|$)", cut=r"^\.+|\.+$"),
    SiteRule("ks", parts=".ksa_stat", joint=" ", keep_empty=True, title=".stat_caption"),
    SiteRule("ri", plain=True, mark="§ {n}", title="body", find=r"^([^\n]*)", cut=r"^§\s*{n}\.\s*|\.+$"),
    SiteRule("md", ("#StatuteText",), plain=True, drop=".btn-group, button", head=r"^Article\s*-\s*Family Law\s*"),
)

ELEMENT_RULES = (
    ElementRule("de", "div.Section", number_in=("div.SectionHead", "id"), title="div.SectionHead", cut=r"^§\s*{n}\.\s*|\.+\s*$"),
    ElementRule("in", "div.section[id]", number_in=(None, "id"), body="beside", joint="\n\n", title="#shortdescription"),
    ElementRule("sc", "span", number=r"SECTION\s+(20-3-\d+)", inside="#contentsection", body="beside", pieces=True, joint="", title="body", note=r"(?s)\nHISTORY:.*$"),
    ElementRule("nh", "h3", number=r"^Section\s+(458:[\w\-]+)", body="codesect", title="b", title_next=True, cut=r"^{n}\s*|[–\s.]+$"),
    ElementRule("wi", "div.qsatxt_1sect", number_in=("span.qsnum_sect", "text"), body="beside", beside="div[class^=qsatxt]", with_start=True, joint="\n\n", title="span.qstitle_sect"),
)

TEXT_RULES = (
    TextRule("il", r"\(750 ILCS 5/([0-9A-Za-z.\-]+)\)", r"Sec\.\s*[0-9A-Za-z.\-]+\.\s*\n?\s*([^.)\n]+)", keep="first"),
    TextRule("pa", r"(?m)^§\s*(3[13579]\d\d)\.\s+", r"^§\s*\d+(?:\.\d+)?\.\s+([^.]+)"),
    TextRule("nd", r"(?m)^\s*(14-05-\d+(?:\.\d+)?)\.\s+", r"^\s*14-05-\d+(?:\.\d+)?\.\s+([^.\n]+)", drop=r"(?m)^\s*Page No\.\s*\d+\s*$"),
    TextRule("nm", r"(?m)^(40-4-\d+(?:\.\d+)?)\.\s+(?=.+?\.)", r"^40-4-\d+(?:\.\d+)?\.\s+(.+?)\.", note=r"(?s)\n\s*ANNOTATIONS\b.*$"),
    TextRule("wy", r"(?m)^\s*(20-2-\d+)\.\s+", r"^\s*20-2-\d+\.\s+([^.\n]+)", between=("CHAPTER 2 - DISSOLUTION OF MARRIAGE", "CHAPTER 3"), dead=r"(?i)^[^\n]*(?:repealed|renumbered)"),
)


def _numbered(pattern: str, number: Column) -> Column:
    return F.replace(F.lit(pattern), F.lit("{n}"), F.concat(F.lit("\\Q"), F.coalesce(number, F.lit("")), F.lit("\\E")))


def _extract(text: Column, pattern: str, number: Column) -> Column:
    return F.call_function("regexp_extract", text, _numbered(pattern, number), F.lit(1))


def _without(text: Column, pattern: str, number: Column) -> Column:
    return F.call_function("regexp_replace", text, _numbered(pattern, number), F.lit(""))


def _plain(text: Column) -> Column:
    return F.translate(text, "\xa0", " ")


def _text(tree: Column, node: Column, joint: str, dropped: Column | None) -> Column:
    if dropped is None:
        return node_text(tree, node, joint)
    kept = lambda n, i: (i >= n["begin"]) & (i < n["end"]) & ~F.exists(dropped, lambda d: (d["begin"] <= i) & (i < d["end"]))
    return let(node, lambda n: F.array_join(F.filter(tree["pieces"], lambda p, i: kept(n, i)), joint))


def _container(rule: SiteRule, tree: Column) -> Column:
    """The element that holds a page's section, as its places."""
    places = lambda n: F.struct(*(n[c].alias(c) for c in ("pos", "last", "begin", "end")))
    if rule.around:
        selector, pattern, around = rule.around
        fits = first(F.filter(select(tree, selector), lambda n: node_text(tree, n, "").rlike(pattern)))
        above = lambda f: F.filter(select(tree, around), lambda n: (n["pos"] < f["pos"]) & (f["pos"] <= n["last"]))
        nearest = lambda f: F.coalesce(let(above(f), lambda a: F.element_at(F.when(F.size(a) > 0, a), -1)), F.get(tree["nodes"], f["parent"]))
        return let(let(fits, nearest), places)
    if not rule.body:
        return places(root(tree))
    found = [select(tree, s) for s in rule.body]
    if rule.filled:
        found = [F.filter(f, lambda n: n["begin"] < n["end"]) for f in found]
    node = F.coalesce(*map(first, found))
    if rule.inner:
        selector, pattern = rule.inner
        node = let(node, lambda outer: F.coalesce(first(F.filter(select(tree, selector, outer), lambda n: node_text(tree, n).rlike(pattern))), outer))
    return let(node, places)


def _paragraphs(rule: SiteRule, tree: Column, node: Column, dropped: Column | None) -> Column:
    clean = lambda t: normalize_space(t) if rule.flat else _plain(t) if rule.plain else t
    filled = lambda a: F.filter(a, lambda x: x["t"] != "")
    whole = not rule.body and not rule.around
    texts = F.transform(select(tree, rule.parts, None if whole else node), lambda n: F.struct(clean(_text(tree, n, " ", dropped)).alias("t"), n["pos"].alias("pos")))
    if rule.since:
        start = lambda a: F.array_min(F.transform(F.filter(a, lambda x: x["t"].rlike(rule.since)), lambda x: x["pos"]))
        texts = let(texts, lambda a: let(start(a), lambda at: F.filter(a, lambda x: x["pos"] >= at)))
    if rule.kept:
        fitting = lambda kept, texts: F.filter(texts, lambda x: F.array_contains(kept, x["pos"]))
        texts = fitting(F.transform(select(tree, rule.kept), lambda n: n["pos"]), texts)
    texts = filled(texts) if rule.skip_filled else texts
    texts = F.slice(texts, rule.skip + 1, 1 << 20) if rule.skip else texts
    texts = texts if rule.keep_empty or rule.skip_filled else filled(texts)
    return F.array_join(F.transform(texts, lambda x: x["t"]), rule.joint)


def _body(rule: SiteRule, tree: Column, node: Column, number: Column, dropped: Column | None = None) -> Column:
    if rule.drop and dropped is None:
        return let(select(tree, rule.drop), lambda found: _body(rule, tree, node, number, found))
    if rule.parts:
        return _paragraphs(rule, tree, node, dropped)
    body = _text(tree, node, rule.joint, dropped)
    body = _plain(body) if rule.plain else body
    body = normalize_space(body) if rule.flat else body
    if rule.mark:
        mark = F.replace(F.lit(rule.mark), F.lit("{n}"), F.coalesce(number, F.lit("")))
        body = let(body, lambda b: let(F.call_function("instr", b, mark), lambda at: F.when(at > 0, F.substr(b, at)).otherwise(b)))
    return body


def _title(rule: SiteRule, tree: Column, node: Column, body: Column, number: Column, page_title: Column) -> Column:
    if rule.title is None:
        return F.lit("")
    if rule.key == "public_law":
        return section_title(page_title)
    if rule.title == "body":
        text = body
    else:
        found = select(tree, rule.title, node if rule.title_inside else None)
        if rule.title_after:
            behind = lambda nodes, mark: F.filter(nodes, lambda n: n["pos"] > mark["pos"])
            found = behind(found, first(select(tree, rule.title_after)))
        texts = F.transform(found, lambda n: _plain(node_text(tree, n)))
        text = F.get(F.filter(texts, lambda t: t.rlike(f"(?U){rule.where}")) if rule.where else texts, F.lit(0))  # letters of any script
    if rule.find:
        got = lambda t: _extract(t, rule.find, number)
        text = let(text, lambda t: F.when(t.rlike(rule.find), got(t)).otherwise(t) if rule.whole else got(t))
    if rule.cut:
        text = _without(trimmed(text), rule.cut, number)
    return trimmed(F.coalesce(text, F.lit("")))


def _choice(key: Column, values: dict[str, Column]) -> Column:
    """The value of the first rule whose key fits; the others aren't evaluated."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def page_sections(pages: DataFrame, rules: tuple[SiteRule, ...] = SITE_RULES, key: str = "site", section: str = "section", tree: str = "tree") -> DataFrame:
    """One section a page: the other columns, title, body and status (`fetched`, or `failed` where the rule finds no text).

    Pages of a site without a rule, and pages that are no section by its rule, are left out.
    """
    t, n, k = F.col(tree), F.col(section), F.col(key)
    out = pages.filter(k.isin(*(r.key for r in rules)))
    out = out.withColumn("__node", _choice(k, {r.key: _container(r, t) for r in rules}))
    node = F.col("__node")
    out = out.withColumn("__body", F.when(node["pos"].isNotNull(), _choice(k, {r.key: _body(r, t, node, n) for r in rules})))
    page_title = node_text(t, first(select(t, "title")))
    out = out.withColumn("title", _choice(k, {r.key: _title(r, t, node, F.col("__body"), n, page_title) for r in rules}))
    for patterns, change in (({r.key: r.head for r in rules if r.head}, "head"), ({r.key: r.note for r in rules if r.note}, "note")):
        if patterns:
            out = out.withColumn("__body", F.coalesce(_choice(k, {x: F.regexp_replace("__body", p, "") for x, p in patterns.items()}), F.col("__body")))
    dead = _choice(k, {r.key: F.col("__body").rlike(r.dead) for r in rules if r.dead}) if any(r.dead for r in rules) else F.lit(False)
    out = out.filter(~F.coalesce(dead, F.lit(False))).withColumn("body", trimmed(F.coalesce("__body", F.lit("")))).drop("__node", "__body", tree)
    return out.withColumn("status", F.when(F.col("body") == "", "failed").otherwise("fetched"))


def _starts(rule: ElementRule, tree: Column) -> Column:
    """The elements that begin sections, with their numbers."""
    inside = None
    if rule.inside:
        span = lambda x: F.struct(*(x[c].alias(c) for c in ("pos", "last")))
        inside = let(first(select(tree, rule.inside)), lambda found: F.when(found.isNotNull(), span(found)).otherwise(span(root(tree))))

    def number(n: Column) -> Column:
        if rule.number:
            return F.regexp_extract(node_text(tree, n), rule.number, 1)
        selector, attribute = rule.number_in
        at = n if selector is None else first(select(tree, selector, n))
        return node_text(tree, at, "") if attribute == "text" else at[attribute]

    found = F.transform(select(tree, rule.start, inside), lambda n: F.struct(n.alias("n"), number(n).alias("number")))
    return F.filter(found, lambda s: F.coalesce(s["number"], F.lit("")) != "")


def element_sections(pages: DataFrame, rule: ElementRule, tree: str = "tree") -> DataFrame:
    """Rows for each section that a page's elements begin: the other columns, section, title, body; the first of a number."""
    t, others = F.col(tree), [c for c in pages.columns if c != tree]
    rows = pages.select(*others, tree, _starts(rule, t).alias("__starts")).select(*others, tree, "__starts", F.posexplode("__starts").alias("__at", "__s"))
    start, number = F.col("__s")["n"], F.col("__s")["number"]
    stops = F.transform(F.col("__starts"), lambda s: s["n"])
    if rule.body == "self":
        body = node_text(t, start)
    elif rule.body == "beside":
        near = siblings_until(t, start, stops)
        if rule.beside:
            wanted = F.transform(select(t, rule.beside), lambda n: n["pos"])
            near = F.filter(near, lambda n: F.array_contains(wanted, n["pos"]))
        elif not rule.pieces:
            near = F.filter(near, lambda n: n["tag"] != TEXT)
        texts = F.transform(near, lambda n: F.when(n["tag"] == "br", "\n").otherwise(node_text(t, n)) if rule.pieces else node_text(t, n))
        texts = F.concat(F.array(node_text(t, start)), texts) if rule.with_start else texts
        body = F.array_join(F.filter(texts, lambda x: x != ""), rule.joint)
    else:
        body = node_text(t, first(F.filter(select(t, rule.body), lambda n: n["pos"] > start["pos"])))
    if rule.pieces:
        body = trimmed(F.regexp_replace(body, r"\n{3,}", "\n\n"))
    if rule.note:
        body = F.regexp_replace(body, rule.note, "")
    body = normalize_space(body) if rule.body == "self" else trimmed(_plain(F.coalesce(body, F.lit(""))))
    if rule.title == "body":
        title = F.regexp_extract(body, r"^([^\n]*)", 1)
    elif rule.title_next:
        title = node_text(t, first(F.filter(select(t, rule.title), lambda n: n["pos"] > start["pos"])))
    else:
        title = node_text(t, first(select(t, rule.title, start)))
    title = trimmed(_plain(F.coalesce(title, F.lit(""))))
    if rule.cut:
        title = trimmed(_without(title, rule.cut, number))
    made = rows.select(*others, "__at", number.alias("section"), title.alias("title"), body.alias("body"))
    return first_by(made, [*others, "section"], "__at").drop("__at")


def text_sections(texts: DataFrame, rule: TextRule, text_col: str = "text") -> DataFrame:
    """Rows for each heading in a text: the other columns, section, title, body; the longest (or first) of a number."""
    others = [c for c in texts.columns if c != text_col]
    text = F.col(text_col)
    if rule.drop:
        text = F.regexp_replace(text, rule.drop, "")
    if rule.between:
        begin, end = rule.between
        at = F.locate(begin, text)
        rest = F.substr(text, at)
        stop = F.locate(end, rest, 2)
        text = F.when(at > 0, F.when(stop > 0, F.left(rest, stop - 1)).otherwise(rest)).otherwise(text)
    blocks = F.slice(F.split(F.regexp_replace(F.translate(text, "\x1e", " "), rule.heading, "\x1e$0"), "\x1e"), 2, 1 << 20)
    rows = texts.select(*others, F.posexplode(blocks).alias("__at", "__block"))
    body = trimmed(F.col("__block"))
    rows = rows.filter(~body.rlike(rule.dead)) if rule.dead else rows
    body = trimmed(F.regexp_replace(body, rule.note, "")) if rule.note else body
    made = rows.select(*others, "__at", F.regexp_extract(body, rule.heading, 1).alias("section"), trimmed(F.regexp_extract(body, rule.title, 1)).alias("title"), body.alias("body"))
    keys = [*others, "section"]
    return (longest_block(made, keys, F.length("body"), F.col("__at")) if rule.keep == "longest" else first_by(made, keys, "__at")).drop("__at")
