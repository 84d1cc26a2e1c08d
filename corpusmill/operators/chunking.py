"""Sections, subsections and chunks with stable ids.

Splits at headings are regular expressions with posexplode; only the recursive splitter is a Python function, an
Arrow batch at a time.  The running index is counted along with it, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.exprs import CHUNK_OVERLAP, CHUNK_SIZE, chunk_id, trimmed

#: Heading patterns, separators from coarse to fine, source types that have sections.
SECTION, SUBSECTION = r"(?m)(?=^Sec\. [0-9A-Za-z\-]+\.)", r"(?m)(?=^\([a-z]\)\s)"
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTIONED = ("statute", "practice_book")
CITATIONS = {"statute": "Conn. Gen. Stat. § ", "practice_book": "Conn. Practice Book § "}


def citation_of(template: Column, section: Column) -> Column:
    """A citation template with its `{section}` filled in."""
    return F.replace(template, F.lit("{section}"), section)


def window_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Fixed windows of a text, as array: the splitter's result for text without separators."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substr(text, s, F.lit(size)))


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters: cut at the coarsest separator that occurs, finer ones only where needed;
    neighbours are joined up to size, and a piece begins with the tail of the last, of at most `overlap`."""
    at = next(k for k, s in enumerate(separators) if not s or s in text)
    mark, finer = separators[at], separators[at + 1 :]
    head, *rest = list(text) if not mark else text.split(mark)
    parts = [p for p in (head, *((mark + r) for r in rest)) if p]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    for p in parts:
        if len(p) >= size and finer:
            if held:
                close()
                held, length = [], 0
            out += split_recursive(p, size, overlap, finer)
            continue
        if held and length + len(p) > size:
            close()
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        close()
    return out


def numbered_pieces(blocks: DataFrame, text_col: str = "block", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """sections() plus `pieces`, the recursive splitter's array of each block (none for a null or blank one), and
    `before`, how many pieces the file's earlier blocks have.

    The blocks of a file come one after another out of sections(), which moves no rows, and the first has both
    numbers 0; so the count runs along in the task, and no text is shuffled for it.  Blocks in any other order are an error.
    """
    names = blocks.columns
    at, section, subsection = (names.index(c) for c in (text_col, "section_no", "subsection_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, earlier = batch.slice(lo, 256), []
                cut = [split_recursive(t.strip(), size, overlap) if t and t.strip() else [] for t in part.column(at).to_pylist()]
                for s, u, c in zip(part.column(section).to_pylist(), part.column(subsection).to_pylist(), cut, strict=True):
                    if (s, u) != (0, 0) and (last is None or (s, u) not in ((last[0], last[1] + 1), (last[0] + 1, 0))):
                        raise ValueError(f"block {s}.{u} of a file comes after {last}: its rows have been moved")
                    before, last = before if s or u else 0, (s, u)
                    earlier.append(before)
                    before += len(c)
                added = [pa.array(cut, pa.list_(pa.string())), pa.array(earlier, pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*names, "pieces", "before"])

    added = [T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("before", T.IntegerType())]
    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, *added]))


def sections(files: DataFrame) -> DataFrame:
    """From files with source_type, citation, title, text (and any other columns): one row for each block to chunk.

    Texts of sectioned types split at section headings (what stands before the first is dropped) and then at
    subsections, each led by its section's preamble.  One section keeps the document's citation; several cite
    themselves.  Others are one block.  Adds block, section_no, subsection_no, subsection.
    """
    has = F.col("source_type").isin(*SECTIONED) & F.col("text").rlike(r"(?m)^Sec\. [0-9A-Za-z\-]+\.")
    parts = F.filter(F.split("text", SECTION), lambda x: x.rlike(r"^Sec\. [0-9A-Za-z\-]+\.") & (trimmed(x) != ""))
    df = files.withColumn("__parts", F.when(has, parts).otherwise(F.array("text"))).withColumn("__has", has)
    df = df.select("*", (F.size("__parts") > 1).alias("__many"), F.posexplode("__parts").alias("section_no", "__text")).withColumn("__text", trimmed("__text"))
    number = F.regexp_extract("__text", r"^Sec\. ([0-9A-Za-z\-]+)\.", 1)
    several = F.col("__has") & F.col("__many")
    prefix = F.coalesce(*(F.when(F.col("source_type") == k, F.lit(v)) for k, v in CITATIONS.items()), F.lit(""))
    df = df.withColumns({
        "citation": F.when(several, F.concat(prefix, number)).otherwise(F.col("citation")),
        "title": F.when(several, trimmed(F.split_part("__text", F.lit("\n"), F.lit(1)))).otherwise(F.col("title")),
        "section": F.when(several, number).otherwise(F.col("section")),
    })
    subs = F.when(F.col("__has") & F.col("__text").rlike(r"(?m)^\([a-z]\)\s"), F.split("__text", SUBSECTION)).otherwise(F.array("__text"))
    df = df.withColumn("__subs", subs).withColumn("__first", F.get("__subs", 0))
    lead = (F.size("__subs") > 1) & ~F.col("__first").rlike(r"^\([a-z]\)\s")
    df = df.withColumn("__lead", F.when(lead, trimmed("__first"))).withColumn("__subs", F.when(lead, F.slice("__subs", 2, 1 << 20)).otherwise(F.col("__subs")))
    df = df.select("*", F.posexplode("__subs").alias("subsection_no", "__sub"))
    letter = F.when(F.col("__has") & F.col("__sub").rlike(r"^\([a-z]\)\s"), F.substring("__sub", 1, 3))
    df = df.withColumn("subsection", letter).withColumn("citation", F.concat("citation", F.coalesce("subsection", F.lit(""))))
    df = df.withColumn("block", trimmed(F.concat_ws("\n\n", F.when(F.col("__lead") != "", F.col("__lead")), trimmed("__sub"))))
    return df.drop(*(c for c in df.columns if c.startswith("__")), "text")


def chunks(files: DataFrame) -> DataFrame:
    """All chunks of the files: the blocks' pieces with a running index over the document and an id made of it.

    Each row of files is numbered on its own, repeated rows too.
    """
    piece = numbered_pieces(sections(files)).select("*", F.posexplode("pieces").alias("piece_no", "text"))
    piece = piece.withColumn("chunk_index", F.col("before") + F.col("piece_no"))
    piece = piece.drop("pieces", "block", "before", "section_no", "subsection_no", "piece_no")
    return piece.withColumn("id", chunk_id(F.col("citation"), F.col("chunk_index"), F.col("text")))


def chunk_counts(all_files: DataFrame, all_chunks: DataFrame, key: str = "source_path") -> DataFrame:
    """Chunks and first source type of each file, files without chunks included."""
    per = all_chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("source_type", "chunk_index").alias("first_type"))
    return all_files.select(key).join(per, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_chunks"), "first_type")
