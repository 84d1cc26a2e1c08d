"""Node trees, selectors, rules of sites (a literal page for each group), and docket records."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dockets, dom, html, sites, sync
from corpusmill.plans import registry


def trees(spark, pages):
    return dom.page_trees(spark.createDataFrame(pages, "id int, html string"))


PAGE = """<html><body><div id="a" class="x y"><table class="t"><tr><td>1</td><td><a name=n href="/s-1">One <b>bold</b></a></td></tr></table>
<script>var p = "</p><p>";</script><a href="/s-2">Two</a><!-- c --> tail<br>more</div><p class="z">P1<p>P2 &amp; &lt;q></i></body></html>"""


@pytest.mark.parametrize(("selector", "texts"), [
    ("a[href*='s-']", ["One bold", "Two"]), ("table.t a[href^='/s']", ["One bold"]), ("div.x.y > a", ["Two"]), ("#a b, p.z", ["bold", "P1 P2 & <q>"]), ("a[href$=2]", ["Two"]),
    ("p", ["P1 P2 & <q>", "P2 & <q>"]), ("#a td>a[name]", ["One bold"]), ("div td b", ["bold"]), ("body > td", []), ("div.x *", None), ("h9", []),
])
def test_selectors(spark, selector, texts):
    t = trees(spark, [(1, PAGE)])
    got = t.select(F.transform(dom.select(t.tree, selector), lambda n: dom.node_text(t.tree, n)).alias("x")).head().x
    assert got == texts if texts is not None else len(got) == 9


def test_selector_that_is_none(spark):
    with pytest.raises(ValueError, match="not understood"):
        dom.select(F.lit(None), "a:first-child")


def test_empty_pages_and_text_by_places(spark):
    t = trees(spark, [(1, None), (2, ""), (3, "no tags")])
    got = {r.id: r for r in t.select("id", dom.node_text(t.tree, dom.root(t.tree)).alias("t"), F.size("tree.nodes").alias("n"), html.markdownish(t.tree).alias("m"), html.section_text(t.tree, F.lit("1")).alias("s")).collect()}
    assert [(got[k].t, got[k].n, got[k].m, got[k].s) for k in (1, 2, 3)] == [("", 0, "", None), ("", 0, "", None), ("no tags", 1, "", None)]


def test_unclosed_elements_hold_no_text_twice():
    tracemalloc.start()
    tree = dom.tree_of("<p>a paragraph of some words" * 4000 + "</b></i>" * 4000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree["pieces"]) == 4000 and tree["nodes"][0]["end"] == 4000 and peak < 40 << 20


def test_sections_between_anchors(spark):
    page = "<body><p>no</p><p>See <span id='x'>x</span> <a id='sec_46b-1A'></a> One.</p><div>not a paragraph</div><p> more\n text </p><p></p><div><span id='sec_2'>Two</span></div><p>after</p><h1>A</h1><h1>A</h1><li>A</li></body>"
    t = trees(spark, [(1, page)])
    got = t.select(html.section_text(t.tree, F.lit("46B-1A")).alias("none"), html.section_text(t.tree, F.lit("46b-1A")).alias("one"), html.section_text(t.tree, F.lit("2")).alias("two"), html.markdownish(t.tree).alias("m")).head()
    assert got.none is None and got.one == "See x One.\n\nmore text" and got.two is None
    assert got.m.endswith("after\n\n# A\n\n- A")


SECTIONS = [
    ("public_law", "1", "<title>N.Y. Law Section 1 – The  name (2026)</title><section>(a)  x</section><section> </section><section>(b)</section>", "The name", "(a) x\n\n(b)"),
    ("va", "20-1", "<h2>Chapter</h2><h2>§ 20-1. Of a thing.</h2><section class='body editable'><p>One</p><p>Two <b>x</b></p></section>", "Of a thing.", "One\nTwo\nx"),
    ("oh", "3105.01", "<h1>Section 3105.01 | Grounds</h1><section class='laws-body'>A</section>", "Grounds", "A"),
    ("mo", "452.1", "<div class='norm'><span class='bold'>452.1.\xa0A title. —</span> text\xa0here</div>", "A title.", "452.1. A title. —\ntext here"),
    ("me", "9", "<title>Title 19-A, §9: Names</title><div class='section-content'>second</div><div class='MRSSection x'>first</div>", "Names", "first"),
    ("mn", "518.1", "<h1 class='shn'>518.1 HEAD.</h1><div class='section'>b</div>", "HEAD.", "b"),
    ("vt", "1", "<b>other</b><ul class='statutes-detail'><b>§ 1. Name</b><li>x</li></ul>", "Name", "§ 1. Name\nx"),
    ("ak", "25.24.010", "<div class='statute'><b>Sec. 25.24.010. A name.</b> text</div>", "A name", "Sec. 25.24.010. A name. text"),
    ("ak", "25.24.020", "<div class='statute'>[Repealed]</div>", None, None),
    ("wa", "26.09.1", "<h2>Head</h2><div id='contentWrapper'><div> </div><div>body<div>in</div></div><div>late</div></div>", "Head", "body\nin"),
    ("id", "32-1", "<div class='pgbrk'><div>menu</div><div>32-1. A thing. It is.</div></div>", "A thing", "32-1. A thing. It is."),
    ("la", "1", "<div id='ctl00_PageBody_divLaw'><p>Art. 1. Things</p><p>text</p><p>Amended by Acts 1990, No. 1</p><p>x</p></div>", "Things", "Art. 1. Things\ntext"),
    ("mt", "40-1", "<h1 class='section-section-title'>T</h1><div class='section-content'>b</div>", "T", "b"),
    ("wv", "48-1-101", "<div id='results-box'><div class='sec-head'>§48-1-101.  Of it (a) text</div></div>", "Of it", "§48-1-101. Of it (a) text"),
    ("ma", "1", "<h2>Section 1</h2><h2>Section 1: Void</h2><p>menu</p><div class='a col-xs-12'><p>Section 1. x</p><div><p>y</p><p> </p></div></div><p>foot</p>", "Void", "Section 1. x\n\ny"),
    ("mi", "552.1", "<div class='sectionWrapper'><h1 class='h4'>552.1 Marriages; void</h1><p>a</p><p></p><p>b</p></div>", "Marriages; void", "a\n\nb"),
    ("nc", "50-1", "<a name='GSDocumentHeader'></a><p><span>§ 50-1.  A name.</span></p><p>text <a name='HistoryNote'>(1868)</a> more</p>", "A name.", "text more"),
    ("ne", "42-1", "<div class='statute'><h3>Terms</h3><p>42-1</p><p class='text-justify'>a</p><p class='text-justify'> </p><p class='text-justify'>b</p></div>", "Terms", "a\n\nb"),
    ("ok", "1", "<title>Title 43</title><div id='oscn-content'><p>menu</p><p>a\xa0b</p><p> </p><p>c</p></div>", "Title 43", "a b\n\nc"),
    ("az", "25-1", "<title>25-1 - Void - x</title><body><p> </p><p>25-1. Void</p><p>a</p><p>b</p></body>", "Void - x", "a\nb"),
    ("hi", "580-1", "<p>menu</p><p class='RegularParagraphs'>§580-1  Jurisdiction; hearing.  The  text.</p><p class='oneParagraph'>(a)</p><p class='XNotes'>note</p>", "Jurisdiction; hearing", "§580-1 Jurisdiction; hearing. The text.\n\n(a)"),
    ("ks", "23-1", "<span class='stat_caption'>Cap</span><p class='ksa_stat'>a</p><p class='x ksa_stat'>b</p>", "Cap", "a b"),
    ("ri", "15-5-1", "<p>menu § 9</p><p>§ 15-5-1. Of it.</p><p>text</p>", "Of it", "§ 15-5-1. Of it.\ntext"),
    ("md", "1-101", "<div id='StatuteText'><button>Next</button>Article - Family Law<div class='btn-group'>x</div><p>§1-101.</p>text</div>", "", "§1-101.\ntext"),
    ("va", "9", "<p>nothing here</p>", "", ""),
    ("zz", "9", "<p>no rule</p>", None, None),
]


def test_sites_with_a_section_a_page(spark):
    rows = [(k, site, n, page) for k, (site, n, page, *_) in enumerate(SECTIONS)]
    p = dom.page_trees(spark.createDataFrame(rows, "id int, site string, section string, html string"))
    got = {r.id: (r.title, r.body, r.status) for r in sites.page_sections(p).collect()}
    want = {k: (title, body, "fetched" if body else "failed") for k, (*_, title, body) in enumerate(SECTIONS) if body is not None}
    assert got == want
    assert {r.key for r in sites.SITE_RULES} <= {s[0] for s in SECTIONS}


ELEMENTS = {
    "de": ("<div class='Section'><div class='SectionHead' id='1501'>§ 1501. Words.</div><p>a  b</p></div><div class='Section'><div class='SectionHead'>none</div></div>", [("1501", "Words", "§ 1501. Words. a b")]),
    "in": ("<div class='section' id='31-15-1'><span id='shortdescription'>One</span></div><p>a</p><p></p><p>b</p><div class='section' id='31-15-2'>x</div><p>c</p>", [("31-15-1", "One", "a\n\nb"), ("31-15-2", "", "c")]),
    "sc": ("<p>SECTION 9</p><div id='contentsection'><span>SECTION 20-3-10.</span> Grounds.<br>text <i>more</i><br><br>HISTORY: 1962<span>SECTION 20-3-20.</span> Two</div>", [("20-3-10", "Grounds.", "Grounds.\ntextmore"), ("20-3-20", "Two", "Two")]),
    "nh": ("<h3>Section 458:1</h3><center><b>458:1 Void. –</b></center><codesect>a b</codesect><h3>Section 458:2</h3><b>458:2 X</b><codesect>c</codesect><h3>Section 458:1</h3><b>y</b><codesect>z</codesect>", [("458:1", "Void", "a b"), ("458:2", "X", "c")]),
    "wi": ("<div class='qsatxt_1sect'><span class='qsnum_sect'>767.1</span><span class='qstitle_sect'>T</span></div><div class='qsatxt_2'>(1)</div><div class='note'>n</div><div class='qsatxt_1sect'><span class='qsnum_sect'>767.2</span></div>", [("767.1", "T", "767.1 T\n\n(1)"), ("767.2", "", "767.2")]),
}


@pytest.mark.parametrize("rule", sites.ELEMENT_RULES, ids=lambda r: r.key)
def test_sites_whose_elements_begin_sections(spark, rule):
    page, want = ELEMENTS[rule.key]
    got = sites.element_sections(trees(spark, [(1, page), (2, None)]).drop("html"), rule).orderBy("section").collect()
    assert [(r.section, r.title, r.body) for r in got] == want


TEXTS = {
    "il": ("head (750 ILCS 5/101) Sec. 101. Short title.\nThis.\n(750 ILCS 5/102) (from x)\nSec. 102. Purposes; rules.) b\n(750 ILCS 5/101) again, longer than the first one was", [("101", "Short title", "(750 ILCS 5/101) Sec. 101. Short title.\nThis."), ("102", "Purposes; rules", "(750 ILCS 5/102) (from x)\nSec. 102. Purposes; rules.) b")]),
    "pa": ("§ 3101.  Short title.\n§ 3101.  Short title of part.\n\nBody.\n§ 3201.  Not odd\n§ 3101.1.  No.", [("3101", "Short title of part", "§ 3101.  Short title of part.\n\nBody.\n§ 3201.  Not odd\n§ 3101.1.  No.")]),
    "nd": ("14-05-01. What. 3\n14-05-01. What is it. Text.\nPage No. 4\nmore", [("14-05-01", "What is it", "14-05-01. What is it. Text.\n\nmore")]),
    "nm": ("40-4-1. Short title.\n40-4-7.3. Of it. Text\nANNOTATIONS\ncase notes 40-4-1. within a line", [("40-4-1", "Short title", "40-4-1. Short title."), ("40-4-7.3", "Of it", "40-4-7.3. Of it. Text")]),
    "wy": ("20-2-9. Contents\nCHAPTER 2 - DISSOLUTION OF MARRIAGE\n20-2-101. Void. Text\n20-2-102. Repealed by L. 1\nCHAPTER 3\n20-2-105. Other", [("20-2-101", "Void", "20-2-101. Void. Text")]),
}


@pytest.mark.parametrize("rule", sites.TEXT_RULES, ids=lambda r: r.key)
def test_sites_whose_headings_begin_sections(spark, rule):
    text, want = TEXTS[rule.key]
    got = sites.text_sections(spark.createDataFrame([(1, text), (2, None), (3, "no heading")], "id int, text string"), rule).orderBy("section").collect()
    assert [(r.section, r.title, r.body) for r in got] == want


def test_docket_record(spark):
    h, b = dockets.HEADER, dockets.BASIC
    page = f"""<span id="{h}lblCaseCaption">DOE,\xa0 JANE v. <b>ROE</b></span><span id="{h}lblDocketNo"><b>Docket No:</b> FBT-FA-1</span><span id="{h}lblCaseType"><b>Type:</b> F00</span>
    <span id="{h}lblFileDate"><b>File Date:</b></span><span id="{b}lblBasicLocation">civil</span><span id="{b}lblFABasicLocation"> BRIDGEPORT </span>
    <table id="{dockets.PARTIES}"><tr><th>x</th></tr><tr><td>P-01</td><td><table><tr><td><span id="a_lblPtyPartyName">JANE</span></td><td>y</td></tr></table></td></tr><tr><td> </td><td><span id="b_lblPtyPartyName">no role</span></td></tr></table>
    <table id="{dockets.ENTRIES}"><tr><th>No</th></tr><tr><td>101.00</td><td>1/2/2020</td><td>P</td><td><a id="c_hlnkDocument" href="/D.aspx?DocumentNo=7">COMPLAINT</a><span id="c_lblNotes">RESULT: granted</span></td></tr>
    <tr><td>102.00</td><td></td><td></td><td>sealed</td></tr><tr><td>&nbsp;</td><td></td><td>D</td><td><a id="d_hlnkDocument" href="D.aspx?DocumentNo=8&amp;x=1"> </a></td></tr><tr><td>1</td><td>2</td></tr></table>"""
    t = trees(spark, [(1, page), (2, "<title>Login</title>"), (3, None)])
    r = {x.id: x for x in t.select("id", dockets.docket_record(F.lit("9"), t.tree, F.lit("https://c.gov/a/b.aspx")).alias("r")).withColumn("there", dockets.has_record(F.col("r"))).collect()}
    one = r[1].r
    assert (one.case_caption, one.docket_no, one.case_type, one.filed_date, one.court_location) == ("DOE, JANE v.ROE", "FBT-FA-1", "F00", None, "BRIDGEPORT")
    assert [tuple(p) for p in one.parties] == [("P-01", "JANE")]
    assert [(e.order, e.entry_id, e.date, e.filed_by, e.description, e.documents[0].href, e.documents[0].docket_entry_id) for e in one.docket_entries] == [
        (1, "101.00", "1/2/2020", "P", "COMPLAINT — RESULT: granted", "https://c.gov/D.aspx?DocumentNo=7", "101.00"),
        (2, "8", None, "D", "document", "https://c.gov/a/D.aspx?DocumentNo=8&x=1", "8"),
    ]
    assert r[1].there and not r[2].there and not r[3].there and r[2].r.docket_entries == [] and r[3].r.parties == []


def test_last_path_of_a_link_within_its_case(spark):
    doc = lambda h, p, *a: (h, p, [(x, y) for x, y in a])
    dockets_ = [
        ("A", [([doc("h1", "z/1", ("h2", "z/2"))],), ([doc("h1", "a/1"), doc("h2", "", ("h1", None))],)]),
        ("B", [([doc("h1", "zz/9"), doc(None, "x")],), ([],), (None,)]),
    ]
    schema = "crn string, docket_entries array<struct<documents: array<struct<href: string, downloaded_path: string, attachments: array<struct<href: string, downloaded_path: string>>>>>>"
    links = spark.createDataFrame([("A", "h1"), ("A", "h2"), ("B", "h1"), ("B", "h2"), ("C", "h1")], "crn string, href string")
    got = {(r.crn, r.href): r.downloaded_path for r in sync.previous_downloads(links, spark.createDataFrame(dockets_, schema)).collect()}
    assert got == {("A", "h1"): "a/1", ("A", "h2"): "z/2", ("B", "h1"): "zz/9", ("B", "h2"): None, ("C", "h1"): None}


def test_last_path_of_lines_with_equal_numbers(spark, tmp_path):
    """Two lines of one number whose links clash: the attachment comes after both documents."""
    lines = [(5, 2, 1, 0), (5, 2, 1, 1), (5, 2, 1, 7), (4, 2, 2, 3), (4, 1, 2, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.crn, r.href): r.downloaded_path for r in registry.QUERIES["downloads_last_wins"](spark, str(tmp_path)).collect()}
    assert got == {(1, "doc/0"): "f/5/2", (1, "doc/1"): "g/5/2", (1, "doc/2"): "g/5/2", (2, "doc/3"): "f/4/2", (2, "doc/4"): "g/4/2", (2, "doc/2"): "f/4/1"}


def test_titles_in_letters_of_any_script_and_cut_quotes(spark, tmp_path):
    """A heading without an ASCII letter is a title; a reference that is cut inside a heading stays."""
    page = lambda k, site, h: (k, f"https://x.y/{site}/{k}", f"<title>t</title><body><article><h1>{h}</h1></article><div class=\"ad\">Ad.</div></body>")
    pages = [page(1, "fr", "Éç Éç"), page(2, "fr", "Ça va"), page(3, "en", "Token = &quot"), page(4, "en", "Say &quot;so&quot;."), page(5, "fr", "日本 語")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in registry.QUERIES["site_sections"](spark, str(tmp_path)).collect()}
    assert got == {1: "Éç", 2: "Ça", 3: "Token = &quot", 4: 'Say "so', 5: "日本"}


def test_words_of_a_text_are_found_once(spark):
    """Not once for each of its blocks: one place in the plan, in no block's function."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = registry.QUERIES["text_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("regexp_extract_all(") == 1


def test_what_lies_inside_an_element(spark):
    """below() is the element's own nodes, by their places; the rest of a page isn't looked at."""
    page = "<p id='a'><b>x</b></p><table><tr><td>1<i>2</i></td><td></td></tr></table><p>y</p>"
    t = trees(spark, [(1, page), (2, "")])
    inside = lambda s: F.transform(dom.below(t.tree, dom.first(dom.select(t.tree, s))), lambda n: n["tag"])
    got = {r.id: (r.a, r.b, r.c, r.d) for r in t.select("id", inside("table").alias("a"), inside("p").alias("b"), inside("b").alias("c"), F.size(dom.select(t.tree, "td", dom.first(dom.select(t.tree, "h1")))).alias("d")).collect()}
    assert got == {1: (["tr", "td", "#text", "i", "#text", "td"], ["b", "#text"], ["#text"], 0), 2: ([], [], [], 0)}
