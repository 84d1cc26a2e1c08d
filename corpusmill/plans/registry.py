"""The library's queries over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import exprs as X
from ..operators import chunking, dom, frontier, guard, html, retrieval, rollups, scope, sync, usage
from ..operators.scratch import written
from ..sources.files import prices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A small price list (per million tokens) and the window that the usage queries report.
PRICES = {"view": ("15", "75"), "click": ("3", "15"), "Purchase": ("0.80", "4.00"), "signup": ("0.02", "0")}
CHAT = ("view", "click", "purchase")
AS_OF, DAYS = dt.datetime(2024, 1, 31), 20
ROBOTS = ("/fr/", "/en/6", "/de/1")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- usage -----------------------------------------------------------------------------------------------------


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as metered usage: value and the JSON property are its tokens, event types its models."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_sub"), F.when(F.col("event_type").isin(*CHAT), "chat").otherwise("embedding").alias("kind"),
        F.col("event_type").alias("model"), F.floor("value").cast("long").alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"),
        F.lit("default").alias("mode"), F.col("ts").alias("created_at"),
    )
    return usage.recordable(usage.priced(e, prices(spark, PRICES)))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cognito_sub"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trailing(usage_events(spark, sf_dir), AS_OF, DAYS)


_USAGE = """
WITH r AS (SELECT * FROM (VALUES ('view', 1500, 7500), ('click', 300, 1500), ('purchase', 80, 400), ('signup', 2, 0)) t(model, ri, ro)),
e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_sub, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'chat' ELSE 'embedding' END AS kind, event_type AS model,
        CAST(floor(value) AS BIGINT) AS input_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens, ts AS created_at FROM events),
p AS (SELECT e.*, input_tokens + output_tokens AS total_tokens, CAST(round_even((input_tokens * ri + output_tokens * ro) / 100.0::DOUBLE, 0) / 1e6 AS DECIMAL(18, 6)) AS cost_usd FROM e LEFT JOIN r ON lower(e.model) = r.model),
q AS (SELECT * FROM p WHERE NOT (kind = 'chat' AND total_tokens = 0)),
u AS (SELECT q.*, CAST(created_at AS DATE) AS day, c.email FROM q LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS s, lower(c_name) || '@example.com' AS email FROM customer) c ON s = user_sub WHERE created_at >= TIMESTAMP '2024-01-11'),
"""
_SUMS = "CAST(count(*) FILTER (WHERE kind = 'chat') AS BIGINT) AS requests, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(18, 6)) AS cost_usd"


def _usage_sql(select: str, group: str = "") -> str:
    return _USAGE.rstrip().rstrip(",") + f"\nSELECT {select}{_SUMS} FROM u {group}"


@query(_usage_sql(""))
def usage_totals(spark, sf_dir):
    return usage.totals(recent(spark, sf_dir))


@query(_usage_sql("coalesce(email, user_sub, 'unknown') AS label, user_sub, ", "GROUP BY user_sub, email"))
def usage_by_user(spark, sf_dir):
    return usage.by_user(recent(spark, sf_dir), users(spark, sf_dir))


@query(_usage_sql("model AS label, ", "GROUP BY model"))
def usage_by_model(spark, sf_dir):
    return usage.by_model(recent(spark, sf_dir))


@query(_usage_sql("day, ", "GROUP BY day"))
def usage_daily(spark, sf_dir):
    return usage.daily(recent(spark, sf_dir))


@query(_usage_sql(
    "CASE grouping_id(user_sub, email, model, day) WHEN 15 THEN 'total' WHEN 3 THEN 'user' WHEN 13 THEN 'model' ELSE 'day' END AS breakdown, "
    "CASE grouping_id(user_sub, email, model, day) WHEN 15 THEN 'all' WHEN 3 THEN coalesce(email, user_sub, 'unknown') WHEN 13 THEN model ELSE CAST(day AS VARCHAR) END AS label, ",
    "GROUP BY GROUPING SETS ((), (user_sub, email), (model), (day))",
))
def usage_overview_gs(spark, sf_dir):
    return usage.overview(recent(spark, sf_dir), users(spark, sf_dir))


@query(_USAGE.rstrip().rstrip(",") + "\nSELECT id, model, total_tokens, cost_usd FROM q")
def price_events(spark, sf_dir):
    return usage_events(spark, sf_dir).select("id", "model", "total_tokens", "cost_usd")


# --- text, chunks ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))


_WINDOWS = "FROM (SELECT doc_id, source, text, unnest(range(1, greatest(length(text) - 200, 1) + 1, 1000)) AS s FROM documents WHERE text <> '')"


@query(f"SELECT doc_id, CAST((s - 1) // 1000 AS INTEGER) AS chunk_index, substr(text, s, 1200) AS chunk {_WINDOWS}")
def chunk_fixed_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text <> ''")
    return d.select("doc_id", F.posexplode(chunking.window_chunks(F.col("text"))).alias("chunk_index", "chunk"))


@query(f"SELECT doc_id, CAST((s - 1) // 1000 AS INTEGER) AS chunk_index, substr(sha1(concat(source, chr(0), (s - 1) // 1000, chr(0), substr(text, s, 1200))), 1, 16) AS id {_WINDOWS}")
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text <> ''")
    d = d.select("doc_id", "source", F.posexplode(chunking.window_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", X.chunk_id(F.col("source"), F.col("chunk_index"), F.col("chunk")).alias("id"))


#: Names of the documents as files: six families in turn, and one that is of none.
NAMES = ("cgs-46b-", "pb-25-", "case-", "form-jd-", "guide-", "lawlib-", "notes-")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    path = F.concat(F.lit("corpus/"), name, F.col("doc_id").cast("string"), F.lit(".txt"))
    d = table(spark, sf_dir, "documents").select(path.alias("source_path"), "text")
    return d.select("*", *(v.alias(k) for k, v in X.path_metadata(F.col("source_path"), F.col("text")).items()))


_NAME = "list_extract([" + ", ".join(f"'{n}'" for n in NAMES) + "], CAST(doc_id % 7 + 1 AS INTEGER))"
_PATH = f"'corpus/' || {_NAME} || doc_id || '.txt'"
_FIRST = r"nullif(regexp_replace(regexp_extract(text, '^\s*([^\s][^\r\n]*)', 1), '\s+$', ''), '')"


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunks(document_files(spark, sf_dir)).select("source_path", "chunk_index", "id", "citation", "text")


@query()
def chunk_counts(spark, sf_dir):
    files = document_files(spark, sf_dir)
    return chunking.chunk_counts(files, chunking.chunks(files))


def _by_family(*values: str) -> str:
    return "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"""SELECT {_PATH} AS source_path,
  {_by_family("'statute'", "'practice_book'", "'case'", "'court_form'", "'court_guide'", "'law_library_guide'", "'case_file'")} AS source_type,
  {_by_family("'primary'", "'court_rule'", "'primary'", "'court_published'", "'court_published'", "'secondary'", "'personal'")} AS authority_level,
  {_by_family("'Conn. Gen. Stat. § 46b-' || doc_id", "'Conn. Practice Book § 25-' || doc_id", f"coalesce({_FIRST}, CAST(doc_id AS VARCHAR))", "'Conn. Judicial Branch Form JD-' || doc_id", "CAST(doc_id AS VARCHAR)", "CAST(doc_id AS VARCHAR)", "'notes-' || doc_id || '.txt'")} AS citation,
  {_by_family("'CGS § 46b-' || doc_id", "'Practice Book § 25-' || doc_id", f"coalesce({_FIRST}, CAST(doc_id AS VARCHAR))", "'Jd ' || doc_id", "CAST(doc_id AS VARCHAR)", "CAST(doc_id AS VARCHAR)", "'notes-' || doc_id || '.txt'")} AS title,
  {_by_family("'46b-' || doc_id", "'25-' || doc_id", "NULL", "NULL", "NULL", "NULL", "NULL")} AS section, CASE WHEN doc_id % 7 = 3 THEN 'JD-' || doc_id END AS document_id,
  CASE WHEN doc_id % 7 < 6 THEN 'Connecticut' END AS jurisdiction FROM documents""")
def path_metadata(spark, sf_dir):
    return document_files(spark, sf_dir).select("source_path", "source_type", "authority_level", "citation", "title", "section", "document_id", "jurisdiction")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l)
SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM i GROUP BY doc_id, island
""")
def line_islands(spark, sf_dir):
    lines = html.line_islands(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text", F.length("line") < 60)
    return lines.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def dedupe_first(spark, sf_dir):
    return html.first_by(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def longest_per_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return html.longest_block(d, ["source"], F.col("n_chars"), F.col("doc_id"))


_PII = ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT) AS n_{k}" for k, p in guard.PII.items())


@query(f"SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, {_PII} FROM documents UNION ALL SELECT 'conversation', conv_id, turn, {_PII} FROM conversations")
def pii_mask_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    found = d.unionByName(c).select("kind", "id", "turn", guard.pii_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    counts = {k: v for k, v in guard.pii_counts(F.lit(None), F.col("spans")).items() if k != "n_card"}
    return found.select("kind", "id", "turn", *(v.alias(k) for k, v in counts.items()))


@query()
def pii_masked(spark, sf_dir):
    text, spans = F.col("text"), F.col("spans")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", guard.pii_spans(F.coalesce(text, F.lit(""))).alias("spans"))
    return d.select("doc_id", guard.pii_counts(text, spans)["n_card"].alias("n_card"), guard.mask_pii(text, spans).alias("text"))


@query("""
SELECT doc_id, toxic = 1 OR quality = 0 AS blocked, CASE WHEN quality = 0 THEN 'ungrounded:grounding' ELSE '' END || CASE WHEN quality = 0 AND toxic = 1 THEN ',' ELSE '' END || CASE WHEN toxic = 1 THEN 'INSULTS' ELSE '' END AS reasons
FROM labels JOIN documents USING (doc_id)
""")
def guardrail_verdict(spark, sf_dir):
    """Verdicts on assessments that are made from the labels: low quality as ungrounded, toxic as blocked content."""
    entry = lambda kind, hit: F.struct(F.lit(kind).alias("type"), F.when(hit, "BLOCKED").otherwise("NONE").alias("action"))
    part = F.struct(
        F.struct(F.array(entry("GROUNDING", F.col("quality") == 0)).alias("filters")).alias("contextualGroundingPolicy"),
        F.struct(F.array(entry("INSULTS", F.col("toxic") == 1)).alias("filters")).alias("contentPolicy"),
    )
    resp = F.to_json(F.struct(F.lit("GUARDRAIL_INTERVENED").alias("action"), F.array(part).alias("assessments")))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select(F.col("doc_id").alias("id"), F.lit("output").alias("side"), F.col("text").alias("original"), resp.alias("resp"))
    return guard.verdicts(rows).select(F.col("id").alias("doc_id"), "blocked", F.array_join("reasons", ",").alias("reasons"))


# --- retrieval -------------------------------------------------------------------------------------------------


def _search(spark: SparkSession, sf_dir: str, same: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieval.top_k(e.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), e, query_filter=same)


_TOP = """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
s AS (SELECT q.id AS query_id, e.id, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON {on} WHERE q.id % 50 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 6)
"""
_TOP_OUT = "SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM h"


@query(_TOP.format(on="true") + _TOP_OUT)
def vector_topk(spark, sf_dir):
    return _search(spark, sf_dir).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


@query(_TOP.format(on="q.label = e.label") + _TOP_OUT)
def vector_topk_filtered(spark, sf_dir):
    return _search(spark, sf_dir, "label").select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("citation"), F.col("lang").alias("source_type"), F.concat(F.lit("/"), "lang").alias("source_url"), "text")
    return _search(spark, sf_dir).join(d, "id")


@query(_TOP.format(on="true") + "SELECT query_id, citation, source_url, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT h.*, source AS citation, '/' || lang AS source_url FROM h JOIN documents ON id = doc_id) GROUP BY query_id, citation, source_url")
def sources_dedupe(spark, sf_dir):
    return retrieval.sources(_hits(spark, sf_dir)).select("query_id", "citation", "source_url", "rank")


@query(_TOP.format(on="true") + r"""SELECT q.query_id, coalesce(md5(string_agg('[' || rank || '] ' || source || '  (' || lang || ')' || chr(10) || 'URL: /' || lang || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank)),
  md5('No passages found in the corpus for that query.')) AS passages_md5, CAST(count(rank) AS BIGINT) AS n_hits
FROM (SELECT id AS query_id FROM e WHERE id % 50 = 0) q LEFT JOIN (h JOIN documents ON id = doc_id) ON q.query_id = h.query_id GROUP BY q.query_id""")
def context_pack(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return retrieval.context(_hits(spark, sf_dir), q).select("query_id", F.md5(F.col("passages").cast("binary")).alias("passages_md5"), "n_hits")


@query()
def embed_topk(spark, sf_dir):
    """Hashed embeddings of all documents, worked out once, then the nearest of every fiftieth document."""
    d = written(retrieval.embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), factory=lambda: retrieval.hashed_embedding).drop("text"), "vectors")
    return retrieval.top_k(d.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), d)


# --- sync ------------------------------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing and an earlier manifest that overlap in a part of their keys, over all documents."""
    d = table(spark, sf_dir, "documents")
    key = lambda n: F.concat(F.lit("docs/"), (F.col("doc_id") * n).cast("string"))
    now = d.select(key(3).alias("key"), F.col("lang").alias("etag"), F.col("n_chars").alias("size"))
    prior = d.select(key(2).alias("key"), F.col("lang").alias("etag"), F.col("n_chars").alias("size"), F.when(F.col("n_chars") % 17 != 0, key(2)).alias("downloaded_path"), (F.col("n_chars") % 13 != 0).alias("local_exists"))
    return now, prior


_SYNC = """
WITH n AS (SELECT 'docs/' || doc_id * 3 AS key, lang AS etag, n_chars AS size FROM documents),
p AS (SELECT 'docs/' || doc_id * 2 AS key, lang AS etag, n_chars AS size, n_chars % 17 <> 0 AS down, n_chars % 13 <> 0 AS here FROM documents),
c AS (SELECT coalesce(n.key, p.key) AS key, CASE WHEN n.key IS NULL THEN CASE WHEN down THEN 'deleted' ELSE 'ignored' END WHEN p.key IS NULL THEN 'new'
        WHEN n.etag IS NOT DISTINCT FROM p.etag AND here THEN 'skipped' ELSE 'changed' END AS status, n.etag AS ne, p.etag AS pe, n.size AS ns, p.size AS ps FROM n FULL JOIN p ON n.key = p.key),
r AS (SELECT key, status, CASE WHEN status = 'skipped' THEN pe ELSE coalesce(ne, pe) END AS etag, CASE WHEN status = 'skipped' THEN ps ELSE coalesce(ns, ps) END AS size FROM c)
"""
_STATUSES = ["new", "changed", "skipped", "deleted", "ignored"]


@query(_SYNC + "SELECT * FROM r")
def sync_classify(spark, sf_dir):
    return sync.classify(*_listing(spark, sf_dir))


@query(_SYNC + "SELECT etag, " + ", ".join(f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS n_{s}" for s in _STATUSES) + ", CAST(count(*) AS BIGINT) AS total FROM r GROUP BY etag")
def sync_counts(spark, sf_dir):
    return sync.status_counts(sync.classify(*_listing(spark, sf_dir)), "etag", _STATUSES)


@query(_SYNC + "SELECT key, size FROM p WHERE key NOT IN (SELECT key FROM n)")
def orphans(spark, sf_dir):
    now, prior = _listing(spark, sf_dir)
    return sync.orphans(prior, now, "key").select("key", "size")


@query(f"SELECT doc_id, CAST((s - 1) // 1000 AS INTEGER) AS chunk_index {_WINDOWS} WHERE doc_id IN (SELECT doc_id FROM labels)")
def stale_prune(spark, sf_dir):
    """Stored chunks without those whose document has no label any more."""
    stored = chunk_ids(spark, sf_dir)
    stale = sync.stale_paths(stored, table(spark, sf_dir, "labels"), "doc_id")
    return sync.prune(stored, stale, ["doc_id"]).select("doc_id", "chunk_index")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'todo' END AS status FROM documents")
def resume_targets(spark, sf_dir):
    return sync.resume(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return sync.upsert_latest(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("""
WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS sub, lower(c_name) || '@example.com' AS email, TIMESTAMP '2023-12-31' AS t FROM customer UNION ALL SELECT CAST(user_id AS VARCHAR), 'u' || user_id || '@example.com', ts FROM events)
SELECT sub, arg_max(email, t) AS email, min(t) AS created_at, max(t) AS last_seen_at, arg_max(email, t) IN (SELECT lower(s_name) || '@example.com' FROM supplier) AS is_admin FROM b GROUP BY sub
""")
def user_upsert(spark, sf_dir):
    at = F.lit("2023-12-31").cast("timestamp_ntz")
    old = users(spark, sf_dir).select(F.col("cognito_sub").alias("sub"), "email", at.alias("created_at"), at.alias("last_seen_at"))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sub"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), F.col("ts").alias("seen_at"))
    return sync.upsert_users(old, seen, table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("@example.com")).alias("email")))


# --- roll-ups --------------------------------------------------------------------------------------------------


@query("SELECT source, sha1(string_agg(lang || '/' || doc_id || ':' || n_chars || ':' || doc_id, chr(10) ORDER BY lang, CAST(doc_id AS VARCHAR))) AS fingerprint, CAST(count(*) AS BIGINT) AS n_files FROM documents GROUP BY source")
def fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"))
    return rollups.fingerprint(d, "source")


@query(r"""SELECT CASE WHEN contains(k, '/') THEN split_part(k, '/', 1) END AS folder, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(size) AS BIGINT) AS total_size
FROM (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/', '') AS k, length(html) AS size FROM pages) GROUP BY 1""")
def folder_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(X.url_path(F.col("url")), "^/", "").alias("key"), F.length("html").alias("size"))
    return rollups.folders(p, "")


@query(r"""SELECT conv_id, md5(string_agg('## Page ' || turn || CASE WHEN role = 'assistant' THEN ' (OCR)' ELSE '' END || chr(10) || chr(10) || CASE WHEN trim(coalesce(text, '')) = '' THEN '_(no text)_' ELSE trim(text) END, chr(10) || chr(10) ORDER BY turn)) AS markdown_md5,
  CAST(count(*) AS BIGINT) AS n_pages, bool_or(role = 'assistant') AS any_ocr, bool_or(length(trim(coalesce(text, ''))) < 30) AS needs_ocr, sum(length(trim(coalesce(text, '')))) >= 20 AS has_text_layer
FROM (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS c FROM conversations)) GROUP BY conv_id""")
def thread_assembly(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text", (F.col("role") == "assistant").alias("ocr_used"))
    out = rollups.assemble_pages(c, "conv_id")
    return out.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"), "n_pages", "any_ocr", "needs_ocr", "has_text_layer")


@query("SELECT o_orderkey, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM (SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS base, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def owner_unique_slug(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", X.slugify(F.col("o_orderpriority"), "project").alias("base"))
    return rollups.unique_slugs(o, "o_custkey", "base", "o_orderkey").select("o_orderkey", "slug")


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), p AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_suppkey NOT IN (SELECT c_custkey FROM gone)) AS BIGINT) AS n_user, CAST(count(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM p)) AS BIGINT) AS n_project FROM lineitem GROUP BY l_returnflag
""")
def cascade_delete(spark, sf_dir):
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sub"), "c_acctbal")
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_sub"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_sub"), F.col("l_orderkey").alias("project_id"), "l_returnflag")
    _, _, left = rollups.cascade_delete(u, projects, used, u.filter("c_acctbal < 0"))
    return left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("user_sub").alias("n_user"), F.count("project_id").alias("n_project"))


@query("SELECT p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT), p_partkey) AS INTEGER) AS rank FROM part")
def natural_sort_rank(spark, sf_dir):
    order = W.partitionBy("p_type").orderBy(X.natural_key(F.col("p_brand")), "p_partkey")
    return table(spark, sf_dir, "part").select("p_type", "p_partkey", F.row_number().over(order).alias("rank"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- pages -----------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""")
def html_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages")).select("page_id", "href")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query()
def html_markdown(spark, sf_dir):
    p = dom.page_trees(table(spark, sf_dir, "pages").select("page_id", "html"))
    return p.select("page_id", html.markdownish(F.col("tree")).alias("markdown"))


@query()
def html_sections(spark, sf_dir):
    """Bodies of paragraphs, by languages of the pages' paths: English ones without the first."""
    p = dom.page_trees(table(spark, sf_dir, "pages").select("page_id", F.split_part(X.url_path(F.col("url")), F.lit("/"), F.lit(2)).alias("state"), "html"))
    bodies = F.when(F.col("state") == "en", html.tag_text(F.col("tree"), "p", skip=1)).otherwise(html.tag_text(F.col("tree"), "p"))
    return p.select("page_id", "state", bodies.alias("body"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slugify(F.col("url")).alias("slug"))


@query(r"""SELECT page_id, CASE WHEN contains(t, '_section_') THEN regexp_extract(t, '^.*?_section_(.*)$', 1) ELSE regexp_extract(t, '([^_]*)$', 1) END AS section FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS t FROM pages)""")
def section_number(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.section_number(F.col("url")).alias("section"))


@query(r"""SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) WHERE NOT starts_with(path, '/fr/') AND NOT starts_with(path, '/en/6') AND NOT starts_with(path, '/de/1')""")
def robots_filter(spark, sf_dir):
    rules = spark.createDataFrame([(r,) for r in ROBOTS], "disallow string")
    return frontier.robots_allowed(table(spark, sf_dir, "pages").select("page_id", X.url_path(F.col("url")).alias("path")), rules)


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0), w AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON node = src) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def link_frontier(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    edges = part.filter("p_partkey > 0").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    return frontier.walk(edges, part.filter("p_partkey = 0").select(F.col("p_partkey").alias("node")))


# --- scope -----------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, tail FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS tail FROM pages)
WHERE starts_with(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/en/') OR TRY_CAST(regexp_extract(tail, '^([0-9]+)', 1) AS BIGINT) BETWEEN 100 AND 700""")
def scope_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.url_path(F.col("url")).alias("path"), F.regexp_extract("url", "([^/]*)$", 1).alias("tail"))
    return p.filter(scope.below(F.col("path"), "/en/") | scope.lead_between(F.col("tail"), 100, 700)).select("page_id", "tail")


@query("""SELECT doc_id, source, coalesce(topic, 'general') AS topic, coalesce(stage, 'any') AS stage
FROM documents LEFT JOIN (SELECT source, max(lang) AS topic, CASE WHEN count(*) % 2 = 0 THEN 'filing' END AS stage FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1 GROUP BY source) USING (source)""")
def curated_topics(spark, sf_dir):
    """Sources' topics from their labelled documents, as a curated table, with defaults for the others."""
    d = table(spark, sf_dir, "documents")
    marked = d.join(table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 1"), "doc_id")
    topics = marked.groupBy("source").agg(F.max("lang").alias("topic"), F.when(F.count(F.lit(1)) % 2 == 0, "filing").alias("stage"))
    return scope.curated(d.select("doc_id", "source"), topics, "source", {"topic": "general", "stage": "any"})


@query("""SELECT p_partkey, CASE WHEN length(n) < 5 THEN lpad(n, 5, '0') ELSE n END AS padded, '25-' || n AS titled,
  'HRS_' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS named
FROM (SELECT p_partkey, p_size, CAST(p_partkey AS VARCHAR) AS n FROM part)""")
def section_recode(spark, sf_dir):
    n, pair = F.col("p_partkey").cast("string"), F.concat_ws("-", F.col("p_partkey") % 1000, "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", scope.padded_number(n).alias("padded"), scope.title_number(n, "25").alias("titled"), scope.dotted_name(pair, "HRS").alias("named"))


from . import registry_corpus, registry_pages  # noqa: E402, F401  their queries register themselves
