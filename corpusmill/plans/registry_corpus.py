"""More queries over the given tables: payloads, names and labels, scope, sync, walks, extraction, ingest.

Where an operator reads a form that the tables don't hold (a JSON payload, a header, a marker), the query writes that
form around the tables' own rows with Spark, over all of them, and applies the operator to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from ..operators import chunking, frontier, guard, html, ingest, rollups, scope, sync, usage
from ..sources import files as S
from .registry import query, table


def text_of(c: str):
    return F.coalesce(F.col(c), F.lit(""))


# --- payloads --------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, length(text) AS n_html, CASE doc_id % 4 WHEN 0 THEN 'Repealed ' || source WHEN 1 THEN ' [' || source || ']' ELSE source END AS heading, doc_id % 5 = 0 AS flagged,
  doc_id % 4 < 2 AS repealed FROM documents""")
def section_payloads(spark, sf_dir):
    k = F.col("doc_id") % 4
    heading = F.when(k == 0, F.concat(F.lit("Repealed "), "source")).when(k == 1, F.concat(F.lit(" ["), "source", F.lit("]"))).otherwise(F.col("source"))
    body = F.to_json(F.struct(F.col("text").alias("Html"), heading.alias("CatchLine"), (F.col("doc_id") % 5 == 0).alias("Repealed")))
    p = table(spark, sf_dir, "documents").select("doc_id", S.section_payload(body).alias("p"))
    return p.select("doc_id", F.length("p.Html").cast("long").alias("n_html"), F.col("p.CatchLine").alias("heading"), F.col("p.Repealed").alias("flagged"), X.repealed(F.col("p.CatchLine")).alias("repealed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS title, CASE WHEN doc_id % 3 > 0 THEN length(text) END AS n_content FROM documents")
def code_payloads(spark, sf_dir):
    row = F.struct(F.col("source").alias("title"), F.col("text").alias("content"))
    records = F.when(F.col("doc_id") % 3 > 0, F.array(row)).otherwise(F.array().cast("array<struct<title:string,content:string>>"))
    body = F.to_json(F.struct(F.struct(F.struct(records.alias("data")).alias("codesOfAlabama")).alias("data")))
    p = table(spark, sf_dir, "documents").select("doc_id", S.code_payload(body).alias("p"))
    return p.select("doc_id", F.col("p.title").alias("title"), F.length("p.content").cast("long").alias("n_content"))


@query("""SELECT doc_id, k AS place, CASE WHEN (doc_id + k) % 2 = 0 THEN '1 ' || lang || '; 2 ' || source ELSE 'In re ' || source END AS citation,
  CASE WHEN (doc_id + k) % 3 = 0 AND trim(text) <> '' THEN md5(text) ELSE md5('<p>' || doc_id || '</p>') END AS text_md5 FROM documents, (SELECT unnest([0, 1]) AS k)""")
def court_opinions(spark, sf_dir):
    def opinion(k: int):
        cites = F.when((F.col("doc_id") + k) % 2 == 0, F.array(F.concat(F.lit("1 "), "lang"), F.concat(F.lit("2 "), "source"))).otherwise(F.array().cast("array<string>"))
        plain = F.when((F.col("doc_id") + k) % 3 == 0, F.col("text")).otherwise(F.lit(" "))
        return F.struct(F.concat(F.lit("In re "), "source").alias("caseName"), cites.alias("citation"), plain.alias("plain_text"), F.concat(F.lit("<p>"), F.col("doc_id").cast("string"), F.lit("</p>")).alias("html"))

    body = F.to_json(F.struct(F.array(*map(opinion, range(3))).alias("results")))
    d = S.exploded_opinions(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "body", 2)
    return d.select("doc_id", "place", S.opinion_citation(F.col("opinion")).alias("citation"), F.md5(S.opinion_text(F.col("opinion")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, 'docs/' || lang || '/' || doc_id AS key, n_chars AS size FROM documents WHERE lang = 'en' AND NOT doc_id % 6 = 0")
def object_listing(spark, sf_dir):
    """Keys below a prefix; every sixth stands for a folder."""
    folder = F.col("doc_id") % 6 == 0
    key = F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(folder, F.concat(key, F.lit("/"))).otherwise(key).alias("key"), F.when(folder, 0).otherwise(F.col("n_chars")).alias("size"))
    return S.listing(d, "docs/en/")


@query("SELECT doc_id, md5(text) AS utf8_md5, length(text) + 2 AS n_bad, md5('é' || doc_id) AS latin_md5 FROM documents")
def decoded_texts(spark, sf_dir):
    """Bytes with a mark before and a bad byte at the end, and others in Latin-1."""
    raw = F.concat(F.lit(b"\xef\xbb\xbf"), F.col("text").cast("binary"))
    latin = F.concat(F.lit(b"\xe9"), F.col("doc_id").cast("string").cast("binary"))
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(
        "doc_id", F.md5(S.decoded(raw).cast("binary")).alias("utf8_md5"), F.length(S.decoded(F.concat(raw, F.lit(b"\xff.")))).cast("long").alias("n_bad"),
        F.md5(S.decoded(latin, F.lit("ISO-8859-1")).cast("binary")).alias("latin_md5"),
    )


# --- names and labels ------------------------------------------------------------------------------------------

_URL = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/', '') AS path"


@query(rf"""SELECT page_id, host AS bucket, path || '/' AS prefix, CASE WHEN s = '' THEN 'default' ELSE s END AS id, CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE path END AS below,
  regexp_replace(host || ' ' || page_id, '[^A-Za-z0-9._-]+', '_', 'g') AS filename, CASE WHEN page_id % 5 > 0 THEN 'a/' || regexp_replace(path, '/+$', '') END AS folder
FROM (SELECT *, trim(regexp_replace(lower(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT page_id, {_URL} FROM pages))""")
def object_names(spark, sf_dir):
    host, path = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.regexp_replace(X.url_path(F.col("url")), "^/", "")
    p = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path")).withColumn("uri", F.concat(F.lit("s3://"), "host", F.lit("/"), "path", F.lit("/")))
    folder = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("./a//"), "path")).otherwise(F.concat(F.lit("a/../"), "path"))
    return p.select(
        "page_id", X.s3_bucket(F.col("uri")).alias("bucket"), X.s3_prefix(F.col("uri")).alias("prefix"), X.id_from_prefix(X.s3_prefix(F.col("uri"))).alias("id"),
        X.relative_path(F.col("path"), F.lit("en/")).alias("below"), X.safe_filename(F.concat_ws(" ", "host", F.col("page_id").cast("string"))).alias("filename"), X.safe_folder(folder).alias("folder"),
    )


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' - ' || p_type ELSE p_type END AS title FROM part")
def section_titles(spark, sf_dir):
    """Page titles of four forms, with a year at the end; the part after the dash is wanted."""
    k = F.col("p_partkey") % 4
    left = F.lit("Sec. 9")
    title = F.when(k == 0, F.concat(left, F.lit(" – "), "p_name")).when(k == 1, F.concat(left, F.lit(" – "), "p_name", F.lit(" - "), "p_type")).when(k == 2, F.concat("p_name", F.lit(" — "), "p_type")).otherwise(F.concat("p_name", F.lit(" - "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.section_title(F.concat(F.lit("  "), title, F.lit("   (2021) "))).alias("title"))


@query("""SELECT p_partkey, p_name || ' ' || p_size AS slug, 'Part ' || p_size AS title, p_brand AS cleaned, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS value,
  CASE WHEN p_partkey % 2 = 0 THEN p_name || ' — ' || p_brand ELSE 'document' END AS description FROM part""")
def cleaned_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    even = F.col("p_partkey") % 2 == 0
    return p.select(
        "p_partkey", X.clean_slug(F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"))).alias("slug"), X.clean_title(F.concat(F.lit("part-"), F.col("p_size").cast("string"))).alias("title"),
        X.clean_meta_value(F.concat(F.lit(" \t"), "p_brand", F.lit(" . ."))).alias("cleaned"), X.strip_label(F.concat(F.lit("Case Type: "), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise(F.lit("")))).alias("value"),
        X.docket_description(F.when(even, F.concat(F.lit(" "), "p_name")), F.when(even, F.col("p_brand")), F.lit(" ")).alias("description"),
    )


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'n' || page_id WHEN 1 THEN CAST(page_id AS VARCHAR) ELSE '' END AS entry, CASE WHEN url LIKE '%?page=%' THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page,
  page_id % 4 = 0 OR page_id % 4 = 1 OR page_id % 4 = 2 AS pdf, CASE page_id % 4 WHEN 2 THEN '.PDF' WHEN 3 THEN '.docx' END AS ext, page_id % 2 = 0 AS link FROM pages""")
def link_values(spark, sf_dir):
    """Docket numbers with their fallback, query values, kinds of what was downloaded, and which links are documents."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    href = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("/Inquiry?x=1&DocumentNo="), F.col("page_id").cast("string"), F.lit("&y=2"))).otherwise(F.lit("/none"))
    number = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" n"), F.col("page_id").cast("string"))).otherwise(F.lit(" "))
    disposition = F.when(k == 2, F.lit('attachment; filename="Ruling.PDF"')).when(k == 3, F.lit("attachment; filename*=UTF-8''plea.v2.docx"))
    return p.select(
        "page_id", X.entry_number(number, href).alias("entry"), X.query_value(F.col("url"), "page").alias("page"),
        X.looks_like_pdf(F.when(k == 0, F.lit(b"%PDF-1.7")).otherwise(F.lit(b"<html>")), F.when(k == 1, F.lit("application/pdf; q=1")), disposition).alias("pdf"),
        X.suggested_extension(disposition).alias("ext"), X.document_link(F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/a.pdf"))).otherwise(F.concat(F.lit("#"), "url"))).alias("link"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ct-divorce' WHEN 1 THEN 'ct-divorce' WHEN 2 THEN 'ct-divorce' ELSE lower(c_mktsegment) || '-law' END || '__m-' || c_nationkey AS collection,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'u' || c_custkey END AS display FROM customer""")
def collection_names(spark, sf_dir):
    k = F.col("c_custkey") % 4
    state = F.when(k == 0, F.lit("Connecticut")).when(k == 1, F.lit("CT")).when(k == 3, F.col("c_mktsegment"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.lit("  "))
    email = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.state_collection(state, F.concat(F.lit("M:"), F.col("c_nationkey").cast("string"))).alias("collection"), X.display_name(name, email).alias("display"))


# --- scope -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size FROM part WHERE regexp_matches(p_partkey || '-' || p_size, '^(1[0-9]*-|2)') AND p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING max(p_size) > 40) AND p_size % 3 <> 1 AND p_size % 2 = 0")
def section_scope(spark, sf_dir):
    """Sections by patterns from their start, by the registry's list, by switched-on kinds and by the form of their slug."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("p_size") % 3 + 1).cast("int")))
    listed = p.groupBy("p_type").agg(F.max("p_size").alias("m")).filter("m > 40")
    slug = F.concat(F.lit("ors_"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.lit("chapter")))
    kept = scope.of_kinds(scope.allowed(p, listed, ["p_type"]), {"a": True, "b": False, "c": True})
    return kept.filter(scope.in_scope(F.concat_ws("-", "p_partkey", "p_size"), "1[0-9]*-", "2") & scope.is_section_link(slug, "ors")).select("p_partkey", "p_size")


def _registry(spark, sf_dir: str) -> DataFrame:
    """States made of the nations, with codes and courts from their suppliers; one row a nation."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("names"))  # a state has few codes and courts
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    codes = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.struct(x.alias("code_root"), F.concat(x, F.lit(" § {section}")).alias("citation_format"), F.lit("/laws/").alias("base_path")))
    courts = F.when(F.col("n_nationkey") % 2 == 0, F.col("names")).otherwise(F.array().cast("array<string>"))
    return n.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"), codes.alias("statutes"), F.coalesce(courts, F.array().cast("array<string>")).alias("courtlistener_courts"))


@query("SELECT 's' || n_nationkey AS slug, s_name AS code_root, s_name || ' § 9-1' AS citation, CASE WHEN n_nationkey % 2 = 0 THEN (SELECT count(*) FROM supplier t WHERE t.s_nationkey = n_nationkey) ELSE 0 END AS n_courts FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def registry_codes(spark, sf_dir):
    r = _registry(spark, sf_dir)
    courts = scope.state_courts(r).groupBy("slug").agg(F.count("court").alias("n_courts"))
    codes = S.state_codes(r).select("slug", "code_root", chunking.citation_of(F.col("citation_format"), F.lit("9-1")).alias("citation"))
    return codes.join(courts, "slug")


@query("SELECT c_custkey, 's' || n_nationkey AS slug FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 3 < 2")
def resolved_states(spark, sf_dir):
    """Requests by slug, by name, and unknown ones."""
    r = _registry(spark, sf_dir)
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    state = F.when(k == 0, F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))).when(k == 1, F.col("n_name")).otherwise(F.lit("nowhere"))
    return S.resolve_state(c.select("c_custkey", state.alias("state")), r).select("c_custkey", "slug")


# --- sync and roll-ups -----------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS sha256 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0)")
def unconverted_files(spark, sf_dir):
    f = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha256"))
    return sync.unconverted(f, f.filter("doc_id % 2 = 0").withColumn("output_exists", F.col("doc_id") % 3 != 0))


@query("SELECT event_id, CASE WHEN o_orderkey IS NULL THEN NULL ELSE o_orderkey END AS project_id FROM events LEFT JOIN orders ON o_orderkey = event_id AND o_custkey = user_id")
def project_attribution(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("project_id"), F.col("user_id").alias("user_sub"))
    return usage.attribute_projects(e, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_sub"))).select("event_id", "project_id")


@query("SELECT DISTINCT 'projects/' || o_orderkey || '/' || o_orderstatus AS key FROM orders WHERE o_custkey = 7 AND o_orderkey % 2 = 0")
def project_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    root = F.when(F.col("o_orderkey") % 2 == 0, F.lit("projects/")).otherwise(F.lit("other/projects/"))
    keys = o.select(F.concat(root, F.col("o_orderkey").cast("string"), F.lit("/"), "o_orderstatus").alias("key"))
    return usage.in_project(keys, o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_sub")), 7)


@query("SELECT user_id, CAST(sum(CASE WHEN event_id % 5 > 0 THEN floor(value) ELSE 0 END) AS BIGINT) AS input_tokens, CAST(count(*) FILTER (WHERE event_id % 5 > 0) AS BIGINT) AS output_tokens, bool_and(event_id % 5 = 0) AS tokens_estimated FROM events GROUP BY user_id")
def call_tokens(spark, sf_dir):
    known = F.col("event_id") % 5 > 0
    one = F.struct(F.when(known, F.floor("value").cast("long")).alias("input_tokens"), F.when(known, F.lit(1).cast("long")).alias("output_tokens"))
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", F.array(one).alias("usages"))
    summed = rollups.token_sums(calls)
    return summed.groupBy("user_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bool_and("tokens_estimated").alias("tokens_estimated"))


@query("SELECT event_id FROM events WHERE (event_id % 100) / 100.0 >= 0.75 AND (event_id % 7) / 7.0 >= 0.5")
def relevance_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100 / 100).alias("grounding"), (F.col("event_id") % 7 / 7).alias("relevance"))
    return guard.gate(e).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 1")
def ingest_targets(spark, sf_dir):
    """Cases to ingest: those whose last state differs in fingerprint or profile, nulls equal."""
    cases = table(spark, sf_dir, "documents").select("doc_id", F.lit("s3").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("profile"), F.col("lang").alias("collection"), F.col("n_chars").cast("string").alias("text_fingerprint"))
    old = cases.withColumns({"at": F.lit(1), "text_fingerprint": F.lit("x")})
    new = cases.filter("doc_id % 3 = 0").withColumns({"at": F.lit(2), "profile": F.when(F.col("doc_id") % 4 == 1, F.lit("other"))})
    states = sync.latest_states(old.unionByName(new).drop("doc_id"), "id", "at")
    return sync.needs_ingest(cases, states).select("doc_id")


_DOCKET = "(SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, role FROM conversations)"


def _docket(spark, sf_dir: str) -> DataFrame:
    """A docket of each conversation: an entry of each turn with one document and one attachment."""
    c = table(spark, sf_dir, "conversations")
    name = lambda kind: F.concat_ws("/", F.lit(kind), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    attachment = F.struct(name("a").alias("href"), F.when(F.col("turn") % 2 == 0, name("f")).alias("downloaded_path"))
    doc = F.struct(name("d").alias("href"), F.when(F.col("turn") % 3 == 0, name("g")).alias("downloaded_path"), F.array(attachment).alias("attachments"))
    entry = F.struct("turn", "role", "text", F.array(doc).alias("documents"))
    return c.groupBy(F.col("conv_id").alias("crn")).agg(F.sort_array(F.collect_list(entry)).alias("docket_entries"))  # a docket is one page's entries


@query("SELECT DISTINCT conv_id AS crn, kind || '/' || conv_id || '/' || turn AS href, CASE WHEN kind = 'a' AND turn % 2 = 0 THEN 'f/' || conv_id || '/' || turn WHEN kind = 'd' AND turn % 3 = 0 THEN 'g/' || conv_id || '/' || turn END AS downloaded_path FROM conversations, (SELECT unnest(['a', 'd']) AS kind)")
def previous_downloads(spark, sf_dir):
    docket = _docket(spark, sf_dir)
    return sync.previous_downloads(sync.flatten_docket(docket).select("crn", "href").distinct(), docket)


@query(f"SELECT conv_id AS crn, CAST(n AS INTEGER) AS \"order\", turn FROM {_DOCKET}")
def docket_order(spark, sf_dir):
    return sync.docket_order(_docket(spark, sf_dir)).select("crn", "order", "turn")


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 25")
def newest_capped(spark, sf_dir):
    """The first 25 of each language, longest (as newest) first; the cap is the feature."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", (-F.col("n_chars")).alias("age"))
    return sync.newest_first(rollups.capped(d, "lang", 25, "age", "doc_id"), "n_chars", "doc_id").drop("age")


@query("SELECT source, doc_id, chunk FROM (SELECT source, doc_id, n_chars % 3 AS chunk FROM documents) WHERE source <> 's2' AND NOT (doc_id % 5 = 0)")
def collection_upkeep(spark, sf_dir):
    """A stored table without one collection and without stale paths."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), "doc_id", (F.col("n_chars") % 3).alias("chunk"))
    return sync.prune(sync.drop_collection(d, "s2"), d.filter("doc_id % 5 = 0").select("collection", "doc_id"), ["collection", "doc_id"]).withColumnRenamed("collection", "source")


@query("SELECT source, CAST(count(*) AS BIGINT) AS deleted FROM documents WHERE doc_id % 5 = 0 AND source IS NOT NULL GROUP BY source")
def prune_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sync.matched_rows(d, d.filter("doc_id % 5 = 0"), ["source", "doc_id"])


@query("""SELECT source, '{"source":"' || source || '","counts":{' || string_agg('"' || lang || '":{"fetched":' || f || ',"failed":' || x || ',"total":' || n || '}', ',' ORDER BY lang) || '}}' AS manifest
FROM (SELECT source, lang, count(*) FILTER (WHERE doc_id % 4 > 0) AS f, count(*) FILTER (WHERE doc_id % 4 = 0) AS x, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source""")
def manifest_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("doc_id") % 4 > 0, "fetched").otherwise("failed").alias("status"))
    return sync.manifest_documents(d, "source", "lang", ["fetched", "failed"])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'skipped' WHEN doc_id % 4 = 1 THEN 'failed' ELSE 'written' END AS status, CASE WHEN doc_id % 4 > 1 THEN md5('---' || chr(10) || 'citation: ' || source || chr(10) || 'section: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || 'x' || text || 'x' || chr(10)) END AS document_md5 FROM documents")
def section_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("doc_id").cast("string").alias("slug"), F.concat(F.lit(" "), "source", F.lit(". ")).alias("citation"), F.lit(" . ").alias("title"), F.col("doc_id").cast("string").alias("section"), F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit(" x"), "text", F.lit("x\n"))).otherwise(F.lit("  ")).alias("body"))
    out = sync.section_records(rows, d.filter("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("slug")))
    return out.select("doc_id", "status", F.md5(F.col("document").cast("binary")).alias("document_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'docs' ELSE 'text' END AS root FROM documents WHERE doc_id % 4 > 0")
def preferred_roots(spark, sf_dir):
    """Converted text where there is any, else the raw documents; those with neither have nothing to ingest."""
    d = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 4 > 0")
    roots = d.withColumn("root", F.lit("docs")).unionByName(d.filter("doc_id % 3 > 0").withColumn("root", F.lit("text"))).unionByName(d.withColumn("root", F.lit("other")))
    return S.preferred_root(roots, ["text", "docs"], "doc_id")


# --- walks -----------------------------------------------------------------------------------------------------


@query("WITH m AS (SELECT max(p_partkey) AS m FROM part) SELECT 'sec_' || p_partkey AS node, CAST(p_partkey - 1 AS INTEGER) AS step FROM part, m WHERE p_partkey >= 1")
def successor_chain(spark, sf_dir):
    """Sections from the first one by their pointers to the next, as long as the name keeps its prefix."""
    p = table(spark, sf_dir, "part").filter("p_partkey >= 1")
    name = lambda c: F.concat(F.lit("sec_"), c.cast("string"))
    last = p.agg(F.max("p_partkey").alias("m"))
    pointers = p.join(F.broadcast(last), F.lit(True)).select(name(F.col("p_partkey")).alias("node"), F.when(F.col("p_partkey") < F.col("m"), name(F.col("p_partkey") + 1)).otherwise(F.lit("end")).alias("next"))
    return frontier.chain(pointers, "sec_1", "sec_").select("node", F.col("step").cast("int").alias("step"))


@query("SELECT DISTINCT 'part_' || o_custkey AS part, 'sec_' || o_orderkey AS section FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0")
def two_level_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part, section = F.concat(F.lit("part_"), F.col("o_custkey").cast("string")), F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("sec_")).otherwise(F.lit("note_")), F.col("o_orderkey").cast("string"))
    top = o.filter("o_custkey % 3 = 0").select(F.lit("index").alias("src"), part.alias("dst")).distinct()
    links = top.unionByName(o.select(part.alias("src"), section.alias("dst")))
    return frontier.two_levels(links, F.col("src") == "index", F.col("dst").startswith("part_"), F.col("dst").startswith("sec_"))


# --- extraction ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5('Sec. 1-' || doc_id || '. A.' || chr(10) || t || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Sec. 2-1. B.' || chr(10) ELSE '' END) AS cut_md5,
  md5(t || chr(10) || chr(10) || 'end') AS stripped_md5, 'from here ' || lang AS sliced, md5(t) AS note_md5, doc_id % 3 <> 1 AS overlap
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[.] ', '.', 'g') AS t FROM documents WHERE regexp_matches(text, '[a-z]')) """.replace("\\\\", "\\"))
def page_cleaning(spark, sf_dir):
    """An index behind the last section, page headings, a slice between markers, trailing notes, and node classes."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[a-z]"))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+", " "), r"[.] ", ".")
    even = F.col("doc_id") % 2 == 0
    book = F.concat(F.lit("Sec. 1-"), F.col("doc_id").cast("string"), F.lit(". A.\n"), t, F.lit("\n"), F.when(even, F.lit("Sec. 2-1. B.\n")).otherwise(F.lit("")), F.lit("1 . . . . . . .  1-3\nx . . . . . . 9\n"))
    scaffold = F.concat(F.lit("# /tmp/x.pdf\n\n## Page 1\n"), t, F.lit("\n\n\n\n## Page 2\nend\n"))
    marked = F.concat(F.lit("before START"), F.lit("from here "), "lang", F.lit("ENDafter"))
    cls = F.element_at(F.array(F.lit("a sec b"), F.lit("other"), F.lit("body")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(
        "doc_id", F.md5(html.trim_index(book).cast("binary")).alias("cut_md5"), F.md5(html.strip_scaffold(scaffold).cast("binary")).alias("stripped_md5"),
        F.substring(html.slice_between(marked, "START", "END"), 6, 1 << 20).alias("sliced"), F.md5(html.strip_note(F.concat(t, F.lit("\nHISTORY: 1962 Code")), r"(?m)^HISTORY: ").cast("binary")).alias("note_md5"),
        html.class_overlap(cls, "sec", "body").alias("overlap"),
    )


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/a/b' AS rooted, regexp_extract(url, '^([a-z]+:)', 1) || '//h/x' AS hosted, regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || 'c' AS relative, 'https://o/' || page_id AS absolute FROM pages""")
def resolved_links(spark, sf_dir):
    p, u = table(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", html.resolve(u, F.lit("/a/b")).alias("rooted"), html.resolve(u, F.lit("//h/x")).alias("hosted"), html.resolve(u, F.lit("c")).alias("relative"), html.resolve(u, F.concat(F.lit("https://o/"), F.col("page_id").cast("string"))).alias("absolute"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents WHERE regexp_matches(text, '[a-z]'))
SELECT doc_id, 1 AS block_no, 'Conn. Gen. Stat. § 1-' || doc_id AS citation, NULL AS subsection, md5('Sec. 1-' || doc_id || '. One.' || chr(10) || t) AS block_md5 FROM d
UNION ALL SELECT doc_id, 2, 'Conn. Gen. Stat. § 2-' || doc_id || '(a)', '(a)', md5('Sec. 2-' || doc_id || '. Two.' || chr(10) || chr(10) || '(a) ' || t) FROM d
UNION ALL SELECT doc_id, 3, 'Conn. Gen. Stat. § 2-' || doc_id || '(b)', '(b)', md5('Sec. 2-' || doc_id || '. Two.' || chr(10) || chr(10) || '(b) end') FROM d""".replace("\\\\", "\\"))
def section_blocks(spark, sf_dir):
    """Statutes of two sections, the second with subsections, made around every document's text."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[a-z]"))
    t, n = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "^ | $", ""), F.col("doc_id").cast("string")
    text = F.concat(F.lit("dropped\nSec. 1-"), n, F.lit(". One.\n"), t, F.lit("\nSec. 2-"), n, F.lit(". Two.\n(a) "), t, F.lit("\n(b) end\n"))
    null = F.lit(None).cast("string")
    files = d.select("doc_id", F.lit("statute").alias("source_type"), F.lit("Conn. Gen. Stat. § 1").alias("citation"), null.alias("title"), null.alias("section"), text.alias("text"))
    out = chunking.sections(files)
    place = F.when(F.col("section_no") == F.lit(0), 1).otherwise(F.when(F.col("subsection") == "(a)", 2).otherwise(3))
    return out.select("doc_id", place.alias("block_no"), "citation", "subsection", F.md5(F.col("block").cast("binary")).alias("block_md5"))


# --- ingest ----------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE 'notes-' || doc_id || '.txt' END AS citation, CASE WHEN doc_id % 2 = 0 THEN 'statute' ELSE 'case_file' END AS source_type,
  CASE WHEN doc_id % 2 = 0 THEN lang END AS jurisdiction, CASE WHEN doc_id % 2 = 0 THEN 'custody' END AS topic, md5(CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '' END || text) AS body_md5 FROM documents WHERE NOT starts_with(text, '---')""")
def front_matter_override(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("not startswith(text, '---')")
    n = F.col("doc_id").cast("string")
    header = F.concat(F.lit('---\n# note\ncitation: "Doc '), n, F.lit('"\nsource_type: statute\nunknown: x\ntopic: \'custody\'\njurisdiction: '), "lang", F.lit("\nstage\n---\n\n."))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(header, "text")).otherwise(F.col("text"))
    out = ingest.with_metadata(d.select(F.concat(F.lit("in/notes-"), n, F.lit(".txt")).alias("source_path"), raw.alias("text")))
    return out.select(F.regexp_extract("source_path", r"(\d+)", 1).cast("long").alias("doc_id"), "citation", "source_type", "jurisdiction", "topic", F.md5(F.col("text").cast("binary")).alias("body_md5"))


def _part_files(spark, sf_dir: str, where: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter(where)
    name = F.element_at(F.array(F.lit("case-"), F.lit("guide-"), F.lit("notes-")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).otherwise(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    files = p.select(F.concat(F.lit("parts/"), name, F.col("p_partkey").cast("string"), F.lit(".txt")).alias("source_path"), text.alias("text"))
    # the table is one small file, so one task would chunk and embed all; a stated number isn't merged again
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_path")


@query("""SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'case' WHEN p_partkey % 3 = 1 THEN 'court_guide' ELSE 'case_file' END AS source_type, CAST(count(*) AS BIGINT) AS n_files,
  CAST(count(*) FILTER (WHERE p_partkey % 10 > 0) AS BIGINT) AS n_chunks FROM part GROUP BY 1""")
def ingest_counts(spark, sf_dir):
    """A dry run over the parts as files: files and chunks by source type."""
    files = _part_files(spark, sf_dir, "true")
    return ingest.report(files, ingest.chunked(files))


@query("""SELECT 'parts/' || list_extract(['case-', 'guide-', 'notes-'], CAST(p_partkey % 3 + 1 AS INTEGER)) || p_partkey || '.txt' AS source_path, p_name || ' ' || p_partkey AS text, '' AS topic,
  CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'Connecticut' END AS jurisdiction, 0 AS chunk_index, 64 AS dimension FROM part WHERE p_partkey % 10 > 0""")
def ingest_upsert(spark, sf_dir):
    """Half of the parts are stored with old texts; then all are ingested, so every file's chunks are replaced."""
    from ..operators.retrieval import hashed_embedding

    old = _part_files(spark, sf_dir, "p_partkey % 2 = 0 and p_partkey % 10 > 0").withColumn("text", F.lit("old text"))
    stored = ingest.ingest(old, ingest.flat(ingest.chunked(old)).limit(0).withColumns({"collection": F.lit("c"), "embedding": F.lit(None).cast("array<float>")}), "c", hashed_embedding)
    out = ingest.ingest(_part_files(spark, sf_dir, "true"), stored, "c", hashed_embedding, 64)
    return out.select("source_path", "text", "topic", "jurisdiction", "chunk_index", F.size("embedding").alias("dimension"))
