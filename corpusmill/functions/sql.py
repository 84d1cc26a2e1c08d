"""The library's functions under SQL: register(spark) makes them callable from spark.sql().

Scalar functions are SQL functions, which Catalyst writes into the plan; only the recursive splitter runs Python, as a table
function over Arrow batches, for use after LATERAL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

from .exprs import CHARS_PER_TOKEN, CHUNK_OVERLAP, CHUNK_SIZE

#: Name and arguments, result, body.
SCALARS = (
    ("slugify(s STRING)", "STRING", "coalesce(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', ''), '')"),
    ("normalize_space(s STRING)", "STRING", "regexp_replace(regexp_replace(s, '(?U)\\\\s+', ' '), '^ | $', '')"),
    ("token_estimate(s STRING)", "BIGINT", f"CASE WHEN length(coalesce(s, '')) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(s) / {CHARS_PER_TOKEN}) AS BIGINT)) END"),
    ("chunk_id(citation STRING, chunk_index INT, content STRING)", "STRING", "substring(sha1(CAST(concat(coalesce(citation, ''), char(0), CAST(chunk_index AS STRING), char(0), content) AS BINARY)), 1, 16)"),
    (
        "cost_usd(tokens_in BIGINT, tokens_out BIGINT, rate_in DECIMAL(10,4), rate_out DECIMAL(10,4))", "DECIMAL(18,6)",
        "CAST(bround(CAST((CAST(tokens_in AS DECIMAL(20,0)) * rate_in + CAST(tokens_out AS DECIMAL(20,0)) * rate_out) / CAST(1000000 AS DECIMAL(10,0)) AS DECIMAL(38,12)), 6) AS DECIMAL(18,6))",
    ),
    ("section_number(url STRING)", "STRING", "CASE WHEN contains(substring_index(url, '/', -1), '_section_') THEN regexp_extract(substring_index(url, '/', -1), '^.*?_section_(.*)$', 1) ELSE substring_index(substring_index(url, '/', -1), '_', -1) END"),
)


class SplitRecursive:
    """split_recursive(text[, size, overlap]): the pieces of a text, numbered; none for a null or blank one."""

    def eval(self, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, str]]:
        from ..operators.chunking import split_recursive

        if text and text.strip():
            yield from enumerate(split_recursive(text.strip(), size, overlap))


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; calling it again does no harm."""
    for name, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {result} RETURN {body}")
    spark.udtf.register("split_recursive", F.udtf(SplitRecursive, returnType="piece_no int, piece string", useArrow=True))


#: The chunks of a view of blocks (see sections()), in SQL.
CHUNKS = """
SELECT source_path, chunk_index, chunk_id(citation, chunk_index, piece) AS id, citation, piece AS text
FROM (SELECT source_path, citation, piece, CAST(row_number() OVER (PARTITION BY source_path ORDER BY section_no, subsection_no, piece_no) - 1 AS INT) AS chunk_index
      FROM {blocks}, LATERAL split_recursive(block))
"""
