"""A court's case page as one nested record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.exprs import cleaned, docket_description, entry_number, strip_label
from .dom import below, first, grid, let, node_text, select_text
from .html import resolve

#: The page's element ids.
HEADER = "Master1_ContentPlaceHolder1_CaseDetailHeader1_"
BASIC = "Master1_ContentPlaceHolder1_CaseDetailBasicInfo1_"
PARTIES = "Master1_ContentPlaceHolder1_CaseDetailParties1_gvParties"
ENTRIES = "Master1_ContentPlaceHolder1_CaseDetailDocuments1_gvDocuments"
#: Endings of the ids inside the rows of the two tables.
PARTY_NAME, DOCUMENT, EXTRAS = "lblPtyPartyName", "hlnkDocument", ("lblAddDesc", "lblNotes", "lblResult")


def parties(tree: Column) -> Column:
    """Role and name of each row of the parties table that has both."""
    named = F.transform(
        F.filter(grid(tree, f"#{PARTIES}"), lambda cells: F.size(cells) >= 2),
        lambda cells: F.struct(
            cleaned(node_text(tree, F.get(cells, F.lit(0)), "")).alias("role"), cleaned(select_text(tree, f"span[id$='{PARTY_NAME}']", "", F.get(cells, F.lit(1)))).alias("name")
        ),
    )
    return F.filter(named, lambda p: p["role"].isNotNull() & p["name"].isNotNull())


def entries(tree: Column, base_url: Column) -> Column:
    """Rows of the documents table that link a document, numbered from 1 in the order of the page."""
    link_in = lambda cell: first(F.filter(below(tree, cell), lambda n: (n["tag"] == "a") & n["id"].endswith(DOCUMENT)))
    rows = F.transform(F.filter(grid(tree, f"#{ENTRIES}"), lambda cells: F.size(cells) >= 4), lambda cells: F.struct(cells.alias("cells"), link_in(F.get(cells, F.lit(3))).alias("link")))
    rows = F.filter(rows, lambda r: r["link"].isNotNull())

    def entry(r: Column, at: Column) -> Column:
        label = F.coalesce(cleaned(node_text(tree, r["link"], "")), F.lit("document"))
        href = F.when(F.coalesce(r["link"]["href"], F.lit("")) != "", resolve(base_url, r["link"]["href"]))
        return let(F.struct(label.alias("label"), href.alias("href"), r.alias("row")), lambda x: filled(x["row"], at, x["label"], x["href"]))

    def filled(r: Column, at: Column, label: Column, href: Column) -> Column:
        cell = lambda k: cleaned(node_text(tree, F.get(r["cells"], F.lit(k)), ""))
        number = entry_number(cell(0), href)
        extras = [select_text(tree, f"span[id$='{x}']", "", F.get(r["cells"], F.lit(3))) for x in EXTRAS]
        document = F.struct(label.alias("label"), F.coalesce(href, F.lit("")).alias("href"), F.when(number != "", number).alias("docket_entry_id"))
        return F.struct(
            (at + 1).alias("order"), number.alias("entry_id"), cell(1).alias("date"), cell(2).alias("filed_by"), docket_description(label, *extras).alias("description"), F.array(document).alias("documents")
        )

    return F.transform(rows, entry)


def docket_record(crn: Column, tree: Column, base_url: Column) -> Column:
    """The record of a case page: captions and dates of its header, parties, docket entries with their documents.

    A page without these elements (a log-in page, an empty one) gives nulls and empty lists; has_record() tells it apart.
    """
    header = lambda x: select_text(tree, f"#{HEADER}{x}")
    basic = lambda x: cleaned(F.coalesce(select_text(tree, f"#{BASIC}lblFABasic{x}"), select_text(tree, f"#{BASIC}lblBasic{x}")))
    return F.struct(
        crn.alias("crn"), cleaned(header("lblCaseCaption")).alias("case_caption"), strip_label(header("lblDocketNo")).alias("docket_no"),
        F.coalesce(basic("CaseType"), strip_label(header("lblCaseType"))).alias("case_type"), strip_label(header("lblFileDate")).alias("filed_date"),
        strip_label(header("lblReturnDate")).alias("return_date"), basic("Location").alias("court_location"), parties(tree).alias("parties"), entries(tree, base_url).alias("docket_entries"),
    )


def has_record(record: Column) -> Column:
    """A page that was read has a caption, a number or an entry."""
    return record["case_caption"].isNotNull() | record["docket_no"].isNotNull() | (F.size(record["docket_entries"]) > 0)
