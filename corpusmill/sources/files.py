"""Readers for text files, listings, manifests, registries and API payloads."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FETCH = "slug string, url string, kind string, metadata map<string,string>"
STATE = (
    "slug string, name string, public_law_subdomain string, fetcher string, official_handler string, statutes array<struct<code_root string, citation_format string, title string, "
    "issuing_body string, base_path string, layout string, section_prefix string, articles array<string>>>, "
    f"forms array<struct<{FETCH.replace(' string', ': string').replace('metadata map', 'metadata: map')}>>, practice_rules array<struct<{FETCH.replace(' string', ': string').replace('metadata map', 'metadata: map')}>>, courtlistener_courts array<string>"
)
S3_MANIFEST = "id string, bucket string, prefix string, last_pulled_at string, counts map<string,bigint>, objects array<struct<key string, downloaded_path string, size bigint, etag string, last_modified string, sha256 string, downloaded_at string>>"
PDF_MANIFEST = "documents array<struct<source_pdf string, source_sha256 string, markdown_path string, json_path string, page_count int, ocr_used boolean, converted_at string>>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, mtime, text of .txt and .md files (any case) below a folder, or of one file whatever its suffix."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower("path").rlike(r"\.(txt|md)$") | F.endswith("path", F.lit(path))
    return raw.filter(wanted).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), decoded(F.col("content")).alias("text"))


def decoded(content: Column, charset: Column | None = None) -> Column:
    """UTF-8 with bad bytes replaced and no byte-order mark, or Latin-1 where the registry says so."""
    utf8 = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿+", "")
    return utf8 if charset is None else F.when(charset == "ISO-8859-1", F.decode(content, "ISO-8859-1")).otherwise(utf8)


def listing(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Keys below a prefix without the empty objects that stand for folders."""
    return objects.filter(F.startswith("key", F.lit(prefix)) & ~(F.endswith("key", F.lit("/")) & (F.col("size") == 0)))


def manifest(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The exploded rows of a nested JSON manifest; a missing or broken file gives none."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        df = spark.createDataFrame([], schema)
    return df.select(F.explode(rows).alias("r")).select("r.*")


def states(spark: SparkSession, registry: dict) -> DataFrame:
    """The registry as a table, its key as slug."""
    empty = spark.createDataFrame([], STATE)
    known = {"fetcher": "public_law", "public_law_subdomain": "", "statutes": [], "forms": [], "practice_rules": [], "courtlistener_courts": []}
    code = {"base_path": "/laws/", "layout": "ny_article"}
    rows = []
    for slug, given in registry.items():
        row = {**known, **given, "slug": slug}
        row["statutes"] = [{**code, **s} for s in row["statutes"]]
        rows.append(tuple(row.get(n) for n in empty.columns))
    return spark.createDataFrame(rows, empty.schema)


def registry_file(spark: SparkSession, path: str) -> dict:
    """The `states` of a JSON or YAML registry file, in any store that Spark reads; none if the file names none.

    YAML is read by the reader that comes with Spark, plain data only.
    """
    text = spark.read.text(path, wholetext=True).head()[0]
    if not path.endswith(".json"):
        jvm = spark.sparkContext._jvm
        snake = jvm.org.yaml.snakeyaml
        data = snake.Yaml(snake.constructor.SafeConstructor(snake.LoaderOptions())).load(text)
        text = jvm.com.fasterxml.jackson.databind.ObjectMapper().writeValueAsString(data)
    return (json.loads(text) or {}).get("states") or {}


def state_codes(registry: DataFrame) -> DataFrame:
    return registry.select("slug", "name", F.explode_outer("statutes").alias("s")).select("slug", "name", "s.*")


def resolve_state(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with `slug`, found by slug or by name; null where unknown."""
    from ..functions.exprs import slugify

    alias = registry.select("slug", F.explode(F.array_distinct(F.array("slug", slugify(F.col("name"))))).alias("__a"))
    return requests.join(alias, slugify(F.col("state")) == F.col("__a"), "left").drop("__a")


def prices(spark: SparkSession, table: dict[str, tuple[str, str]]) -> DataFrame:
    rows = [(m.lower(), Decimal(str(a)), Decimal(str(b))) for m, (a, b) in table.items()]
    return spark.createDataFrame(rows, "model string, input_per_mtok decimal(10,4), output_per_mtok decimal(10,4)")


def section_payload(body: Column) -> Column:
    """Section JSON of an API: html, heading, repealed."""
    return F.from_json(body, "Html string, CatchLine string, Repealed boolean")


def code_payload(body: Column, root: str = "codesOfAlabama") -> Column:
    """First record of a GraphQL answer's list, null where any step is missing."""
    return F.get(F.from_json(body, f"data struct<{root}: struct<data: array<struct<title: string, content: string>>>>")["data"][root]["data"], 0)


def opinions(body: Column, most: int) -> Column:
    """The first `most` results of a court search, exploded by the caller."""
    return F.slice(F.from_json(body, "results array<struct<caseName: string, citation: array<string>, absolute_url: string, plain_text: string, html: string, html_lawbox: string, html_columbia: string, html_with_citations: string>>")["results"], 1, most)


def exploded_opinions(df: DataFrame, body: str, most: int) -> DataFrame:
    """One row for each of the first `most` results of each payload: other columns, place, opinion."""
    others = [c for c in df.columns if c != body]
    return df.select(*others, F.posexplode(opinions(F.col(body), most)).alias("place", "opinion"))


def preferred_root(files: DataFrame, roots: list[str], key: str = "id", root: str = "root") -> DataFrame:
    """Of each key, the files of the first of the roots that has any; a key with none has none."""
    place = F.array_position(F.array(*map(F.lit, roots)), F.col(root))
    first = files.filter(place > 0).groupBy(key).agg(F.min(place).alias("__first"))
    return files.join(first, key).filter(place == F.col("__first")).drop("__first")


def opinion_text(o: Column) -> Column:
    """Plain text, else the first of the HTML fields that isn't empty."""
    filled = lambda c: F.when(F.trim(o[c]) != "", o[c])
    return F.coalesce(*(filled(c) for c in ("plain_text", "html", "html_lawbox", "html_columbia", "html_with_citations")))


def opinion_citation(o: Column) -> Column:
    joined = F.array_join(o["citation"], "; ")
    return F.coalesce(F.when(joined != "", joined), o["caseName"])
