"""Column functions: identifiers, slugs, metadata cleanup, cost, predicates.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Chunking sizes, characters a token stands for, and page-text limits.
CHUNK_SIZE, CHUNK_OVERLAP = 1200, 200
CHARS_PER_TOKEN = 4
LEAST_PAGE_TEXT, LEAST_TEXT_LAYER = 30, 20

#: Metadata by file-name family; {x} is what the pattern captures.
FAMILIES = (
    ("statute", r"^cgs-([0-9a-z\-]+)$", "primary", "Conn. Gen. Stat. § {x}", "CGS § {x}", "Connecticut General Assembly"),
    ("practice_book", r"^pb-([0-9a-z\-]+)$", "court_rule", "Conn. Practice Book § {x}", "Practice Book § {x}", "Connecticut Judicial Branch"),
    ("case", r"^case-(.+)$", "primary", None, None, "Connecticut Appellate Courts"),
    ("court_form", r"^form-(.+)$", "court_published", "Conn. Judicial Branch Form {x}", None, "Connecticut Judicial Branch"),
    ("court_guide", r"^guide-(.+)$", "court_published", None, None, "Connecticut Judicial Branch"),
    ("law_library_guide", r"^(?:lawlib|research)-(.+)$", "secondary", None, None, "Connecticut Judicial Branch Law Libraries"),
)
JURISDICTION = "Connecticut"
#: Names of the state whose collection keeps its own name.
FIRST_STATE = ("ct", "connecticut", "ct-divorce")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


#: Fixed value: the characters that Unicode counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalize_space(c: Column) -> Column:
    """Runs of white space become one space."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def slugify(c: Column, fallback: str = "", most: int | None = None) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, most), "-+$", "") if most else slug
    return F.coalesce(null_if_empty(slug), F.lit(fallback))


def clean_slug(c: Column) -> Column:
    return F.trim(F.translate(c, "_-", "  "))


def clean_title(c: Column) -> Column:
    return F.initcap(clean_slug(c))


def clean_meta_value(c: Column) -> Column:
    return trimmed(F.regexp_replace(normalize_space(c), r"[. ]+$", ""))


def chunk_id(citation: Column, index: Column, text: Column) -> Column:
    """First 16 digits of the SHA-1 of citation, index and text, with zero bytes between."""
    return F.substring(F.sha1(F.concat(F.coalesce(citation, F.lit("")), F.lit("\0"), index.cast("string"), F.lit("\0"), text).cast("binary")), 1, 16)


def token_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / CHARS_PER_TOKEN))).cast("long")


def cost_usd(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price at rates for a million tokens, half-even to six places; null without a rate."""
    total = tokens_in.cast("decimal(20,0)") * rate_in + tokens_out.cast("decimal(20,0)") * rate_out
    return F.bround((total / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,12)"), 6).cast("decimal(18,6)")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def section_number(url: Column) -> Column:
    """What follows `_section_` in the last part of a URL, else what follows its last underscore."""
    tail = F.regexp_extract(url, r"([^/]*)$", 1)
    return F.when(tail.contains("_section_"), F.regexp_extract(tail, r"^.*?_section_(.*)$", 1)).otherwise(F.regexp_extract(tail, r"([^_]*)$", 1))


def section_title(title: Column) -> Column:
    """A page title after its first spaced dash (en, else em, else hyphen), without a year at its end."""
    t = normalize_space(title)
    after = t
    for dash in (" - ", " — ", " – "):  # the last one that is set wins
        after = F.when(t.contains(dash), F.regexp_extract(t, f"^.*?{dash}(.*)$", 1)).otherwise(after)
    return F.trim(F.regexp_replace(after, r"\s*\(\d{4}\)\s*$", ""))


def cleaned(c: Column) -> Column:
    """White space normalised; null if nothing is left."""
    return null_if_empty(normalize_space(c))


def strip_label(c: Column) -> Column:
    """`Label: value` as its value; null if nothing is left."""
    return null_if_empty(trimmed(F.regexp_replace(cleaned(c), r"^[^:]*:", "")))


def docket_description(label: Column, *extras: Column) -> Column:
    """The label (`document` if it is empty) and the extras that aren't empty, joined by dashes."""
    return F.concat_ws(" — ", F.coalesce(cleaned(label), F.lit("document")), *map(cleaned, extras))


def s3_bucket(uri: Column) -> Column:
    return null_if_empty(F.regexp_extract(uri, r"^s3://([^/]+)", 1))


def s3_prefix(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^s3://[^/]+/?(.*)$", 1)


def id_from_prefix(prefix: Column) -> Column:
    return slugify(F.element_at(F.split(F.regexp_replace(prefix, "/+$", ""), "/"), -1), "default")


def relative_path(key: Column, prefix: Column) -> Column:
    return F.regexp_replace(F.when(F.startswith(key, prefix), F.substr(key, F.length(prefix) + 1)).otherwise(key), "^/+", "")


def safe_filename(label: Column) -> Column:
    return F.coalesce(null_if_empty(F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")), F.lit("document"))


def safe_folder(path: Column) -> Column:
    """A path without empty or `.` parts; null if any part is `..`."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(~F.exists(parts, lambda p: F.trim(p) == ".."), F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~p.isin("", ".")), "/"))


def query_value(url: Column, name: str) -> Column:
    return null_if_empty(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))


def entry_number(number: Column, href: Column) -> Column:
    """A docket entry's number, else the DocumentNo of its link, else empty."""
    return F.coalesce(cleaned(number), null_if_empty(F.regexp_extract(href, r"DocumentNo=([^&]*)", 1)), F.lit(""))


def suggested_extension(disposition: Column) -> Column:
    """The suffix of the file name that a Content-Disposition header gives; null without one."""
    name = F.regexp_extract(disposition, r"""filename\*?=(?:UTF-8''|")?([^";]+)""", 1)
    return null_if_empty(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=[^.])(\.[^.\s]+)\s*$", 1))


def looks_like_pdf(head: Column, content_type: Column, disposition: Column) -> Column:
    return (F.substring(head, 1, 4) == F.lit(b"%PDF")) | F.coalesce(content_type, F.lit("")).contains("application/pdf") | F.lower(F.coalesce(disposition, F.lit(""))).contains(".pdf")


def needs_ocr(page_text: Column) -> Column:
    return F.length(F.trim(F.coalesce(page_text, F.lit("")))) < LEAST_PAGE_TEXT


def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(null_if_empty(F.trim(name)), F.split_part(email, F.lit("@"), F.lit(1)))


def collection_name(base: Column, model: Column) -> Column:
    return F.concat(base, F.lit("__"), slugify(model))


def state_collection(state: Column, model: Column, first: str = "ct-divorce") -> Column:
    """The collection of a state: of none or of an alias of the first one, that one's own name; else `<slug>-law`."""
    slug = slugify(state)
    base = F.when(state.isNull() | slug.isin(*FIRST_STATE), F.lit(first)).otherwise(F.concat(slug, F.lit("-law")))
    return collection_name(base, model)


def repealed(heading: Column) -> Column:
    return F.coalesce(heading.rlike("(?i)repealed|renumbered"), F.lit(False)) | F.coalesce(F.ltrim(heading).startswith("["), F.lit(False))


def document_link(href: Column) -> Column:
    dead = href.startswith("#") | F.lower(href).startswith("javascript:")
    return ~dead & F.lower(href).rlike(r"\.(pdf|docx?|tiff?)(\?|#|$)|document|download|attachment")


def natural_key(c: Column) -> Column:
    """Numeric parts of a name, as a sort key."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def path_metadata(path: Column, text: Column) -> dict[str, Column]:
    """Metadata of a source file by its name: the first family whose pattern fits, else a case file."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    first_line = null_if_empty(trimmed(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)\A\s*(\S[^\r\n]*)", 1)))
    out = {"source_type": F.lit("case_file"), "authority_level": F.lit("personal"), "citation": name, "title": name, "section": F.lit(None).cast("string"), "document_id": F.lit(None).cast("string"), "jurisdiction": F.lit(None).cast("string"), "issuing_body": F.lit(None).cast("string")}
    for kind, pattern, authority, citation, title, body in reversed(FAMILIES):
        x = F.regexp_extract(stem, pattern, 1)
        x = F.upper(x) if kind == "court_form" else x
        fill = lambda template, v=x: F.replace(F.lit(template), F.lit("{x}"), v)
        named = F.coalesce(first_line, F.initcap(F.translate(x, "-", " "))) if kind == "case" else clean_title(F.lower(x))
        values = {
            "source_type": F.lit(kind), "authority_level": F.lit(authority), "citation": fill(citation) if citation else named,
            "title": fill(title) if title else F.coalesce(first_line, x) if kind == "case" else clean_title(F.lower(x)),
            "section": x if kind in ("statute", "practice_book") else F.lit(None).cast("string"), "document_id": x if kind == "court_form" else F.lit(None).cast("string"),
            "jurisdiction": F.lit(JURISDICTION), "issuing_body": F.lit(body),
        }
        out = {k: F.when(stem.rlike(pattern), v).otherwise(out[k]) for k, v in values.items()}
    return out


def front_matter(raw: Column) -> Column:
    """Header fields as a map: trimmed, without quotes; blank, comment and colon-less lines skipped; last key wins."""
    lines = F.filter(F.transform(F.split(F.regexp_extract(raw, r"(?s)\A---\s*\n(.*?)\n---", 1), "\n"), trimmed), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    value = lambda x: F.regexp_replace(F.regexp_replace(trimmed(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), '^"+|"+$', ""), "^'+|'+$", "")
    pairs = F.transform(lines, lambda x: F.struct(trimmed(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body_after_front_matter(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)\A---\s*\n.*?\n---\s*\n?", "")


def front_matter_document(fields: dict[str, Column], text: Column) -> Column:
    """A header of the fields that aren't empty, then the trimmed text."""
    lines = F.filter(F.array(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items())), lambda x: x.isNotNull())
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), trimmed(text), F.lit("\n"))
