"""From files to stored chunks in one call: front matter over metadata from names, chunking, embedding, upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X
from . import chunking, retrieval, sync
from .scratch import written

#: The metadata that a chunk is stored with.
METADATA = ("source_type", "authority_level", "citation", "title", "section", "subsection", "date", "jurisdiction", "issuing_body", "topic", "stage", "document_id", "source_url", "source_path")


def with_metadata(files: DataFrame) -> DataFrame:
    """From (source_path, text): text without its front matter, and metadata by the file's name, where the front matter
    doesn't give it; keys that aren't metadata are ignored, a header without a value for a key doesn't count."""
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), "^\ufeff+", "")
    parsed = files.select("source_path", X.front_matter(raw).alias("__given"), X.body_after_front_matter(raw).alias("text"))
    inferred = parsed.withColumn("__by", F.struct(*(v.alias(k) for k, v in X.path_metadata(F.col("source_path"), F.col("text")).items())))
    names = inferred.schema["__by"].dataType.names
    value = lambda c: F.coalesce(F.element_at("__given", c), F.col(f"__by.{c}") if c in names else F.lit(None).cast("string"))
    return inferred.select("source_path", "text", *(value(c).alias(c) for c in METADATA if c not in ("source_path", "subsection")))


def chunked(files: DataFrame) -> DataFrame:
    """All chunks of with_metadata(): sectioned by the type that holds after the front matter."""
    return chunking.chunks(with_metadata(files))


def flat(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: id, text, chunk_index and all metadata, null as an empty string."""
    return chunks.select("id", "text", "chunk_index", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in METADATA))


def ingest(files: DataFrame, stored: DataFrame, collection: str, embedder: Callable, model_dim: int | None = None) -> DataFrame:
    """The stored table after the files' chunks are upserted into a collection: all chunks of a file are replaced.

    Chunks and embeddings are worked out once, to a written table: which files are replaced is read from that.
    """
    new = retrieval.embed(flat(chunked(files)).withColumn("collection", F.lit(collection)), embedder)
    if model_dim:
        new = retrieval.check_dimension(new, model_dim)
    return sync.replace_sources(stored, written(new, "chunks"))


def report(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """What an ingest does, without writing: files and chunks by source type, files without chunks under null."""
    per = chunking.chunk_counts(files, chunks)
    return per.groupBy(F.col("first_type").alias("source_type")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chunks").alias("n_chunks"))
