"""Grouped summaries: fingerprints, folders, threads, unique slugs, cascades."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.exprs import LEAST_TEXT_LAYER, needs_ocr
from .scratch import written


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with `number`, from 0 in the given order within each key.  No task holds a key's rows: they are range-sorted, and
    each partition adds how many of the key the partitions before it have."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__part", F.shiftright("__at", 33)), "numbered")
    per = placed.groupBy(F.col(key).alias("__key"), "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__first"))
    ahead = F.sum("n").over(W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a key has a row a partition at most
    per = per.select("__key", F.col("__part").alias("__p"), "__first", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    there = placed.join(per, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return there.withColumn("number", F.col("__ahead") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__key", "__p", "__first", "__ahead")


#: Lines that go to their group's hash as one row.
LINES = 1000

_RUN = T.StructType([T.StructField("key", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
_DIGEST = T.StructType([T.StructField("key", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("n_files", T.LongType())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one key that stand together in a batch of (key, line) rows, LINES at most, joined; numbered in the partition."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        lines, lo, out = batch.column(1).to_pylist(), 0, []
        for key, same in groupby(batch.column(0).to_pylist()):
            end = lo + sum(1 for _ in same)
            for first in range(lo, end, LINES):
                held = lines[first : min(end, first + LINES)]
                out.append((key, part, at, len(held), "\n".join(held)))
                at += 1
            lo = end
        if out:
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], _RUN.names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fingerprint, n_files) of (key, n, text) rows that come by keys and in order; one key's hash is held at a time."""
    done: list[tuple[str | None, str, int]] = []
    now, digest, total = None, None, 0
    for batch in batches:
        for key, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or key != now:
                if digest is not None:
                    done.append((now, digest.hexdigest(), total))
                now, digest, total = key, hashlib.sha1(), 0
            digest.update((("\n" if total else "") + text).encode())
            total += n
    if digest is not None:
        done.append((now, digest.hexdigest(), total))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], _DIGEST.names)


def fingerprint(files: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """SHA-1 of the `path:size:mtime` lines of a group in path order (by parts).  One line a file, no content.  Null keys are
    one group.

    All lines are range-sorted and joined LINES at a time; a group's runs then stream past one hash, as SHA-1 is serial, so no
    row and no memory holds a group.  With `most`, a group of more files has the SHA-1 of the SHA-1s of each `most` lines in turn.
    """
    line = F.concat_ws(":", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
    lines = files.select(F.col(key).alias("key"), F.split("path", "/").alias("parts"), line.alias("line"))
    if most is None:
        spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = lines.withColumn("key", F.col("key").cast("string")).repartitionByRange(spread, "key", "parts", "line").sortWithinPartitions("key", "parts", "line")
        runs = order.select("key", "line").mapInArrow(_runs, _RUN).repartition("key").sortWithinPartitions("key", "part", "at")
        out = runs.select("key", "n", "text").mapInArrow(_digests, _DIGEST)
        return out.select(F.col("key").cast(lines.schema["key"].dataType).alias(key), "fingerprint", "n_files")
    sizes = written(lines.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n_files")), "sizes")
    sized = lambda some: lines.join(sizes.filter(some), F.col("key").eqNullSafe(F.col("k"))).drop("k")

    def digest(rows: DataFrame, *keys: str) -> DataFrame:
        held = F.sort_array(F.collect_list(F.struct("parts", "line")))
        return rows.groupBy(*keys).agg(F.sha1(F.array_join(F.transform(held, lambda r: r["line"]), "\n").cast("binary")).alias("fingerprint"))

    small = digest(sized(F.col("n_files") <= most), "key", "n_files")
    if sizes.filter(F.col("n_files") > most).isEmpty():
        return small.select(F.col("key").alias(key), "fingerprint", "n_files")
    blocks = digest(numbered(sized(F.col("n_files") > most), "key", ["parts", "line"]).withColumn("block", F.floor(F.col("number") / most)), "key", "n_files", "block")
    of_blocks = F.sort_array(F.collect_list(F.struct("block", "fingerprint")))
    large = blocks.groupBy("key", "n_files").agg(F.sha1(F.array_join(F.transform(of_blocks, lambda b: b["fingerprint"]), "\n").cast("binary")).alias("fingerprint"))
    return small.unionByName(large).select(F.col("key").alias(key), "fingerprint", "n_files")


def folders(files: DataFrame, prefix: str) -> DataFrame:
    """First segment below a prefix: files and bytes; files directly there under a null folder."""
    rest = F.substring("key", len(prefix) + 1, 1 << 30)
    folder = F.when(F.contains(rest, F.lit("/")), F.split_part(rest, F.lit("/"), F.lit(1)))
    return files.filter(F.startswith("key", F.lit(prefix))).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size"))


def assemble_pages(pages: DataFrame, key: str) -> DataFrame:
    """Document text of page rows (page, text, ocr_used), with page count and flags for recognition."""
    body = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("_(no text)_")).otherwise(F.trim("text"))
    block = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.when(F.col("ocr_used"), F.lit(" (OCR)")).otherwise(F.lit("")), F.lit("\n\n"), body)
    rows = F.sort_array(F.collect_list(F.struct("page", block.alias("block"))))
    size = F.sum(F.length(F.trim(F.coalesce("text", F.lit("")))))
    return pages.groupBy(key).agg(
        F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("markdown"), F.count(F.lit(1)).alias("n_pages"), F.bool_or("ocr_used").alias("any_ocr"),
        F.bool_or(needs_ocr(F.col("text"))).alias("needs_ocr"), (F.coalesce(size, F.lit(0)) >= LEAST_TEXT_LAYER).alias("has_text_layer"),
    )


def unique_slugs(rows: DataFrame, owner: str, base: str, *order: Column | str) -> DataFrame:
    """Slugs unique for each owner: base, base-2, base-3, ...; a suffixed slug that is someone's base is passed over."""
    nth = F.row_number().over(W.partitionBy(owner, base).orderBy(*order))
    bases = rows.select(owner, F.col(base).alias("__b")).distinct()
    # suffixes that another base of the same owner takes up already
    taken = bases.select(owner, F.regexp_extract("__b", r"^(.*)-(\d+)$", 1).alias(base), F.expr(r"try_cast(regexp_extract(__b, '^(.*)-([0-9]+)$', 2) as int)").alias("__t")).filter("__t >= 2")
    taken = taken.groupBy(owner, base).agg(F.array_sort(F.collect_set("__t")).alias("__taken"))
    n = F.col("__n")
    shift = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), n, lambda a, t: F.when((n > 1) & (t <= a), a + 1).otherwise(a))
    out = rows.withColumn("__n", nth).join(taken, [owner, base], "left").withColumn("__k", shift)
    return out.withColumn("slug", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("__k").cast("string")))).drop("__n", "__k", "__taken")


def cascade_delete(users: DataFrame, projects: DataFrame, usage: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users without those gone; their projects go too; usage stays with its user and project unset."""
    sub = gone.select(F.col("sub").alias("__g")).distinct()
    kept_projects = projects.join(sub, F.col("owner_sub") == F.col("__g"), "left_anti")
    left = kept_projects.select(F.col("id").alias("__p"))
    out = usage.join(sub, F.col("user_sub") == F.col("__g"), "left").join(left, F.col("project_id") == F.col("__p"), "left")
    out = out.withColumns({"user_sub": F.when(F.col("__g").isNull(), F.col("user_sub")), "project_id": F.col("__p")}).drop("__g", "__p")
    return users.join(sub, F.col("sub") == F.col("__g"), "left_anti"), kept_projects, out


def capped(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first `most` rows of each key (the limit is the feature)."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def token_sums(calls: DataFrame, usages: str = "usages") -> DataFrame:
    """Sums over an array of usage structs; estimated if none of them is known."""
    total = lambda c: F.aggregate(F.coalesce(usages, F.array()), F.lit(0).cast("long"), lambda a, u: a + F.coalesce(u[c], F.lit(0)))
    return calls.withColumns({"input_tokens": total("input_tokens"), "output_tokens": total("output_tokens"), "tokens_estimated": F.forall(F.coalesce(usages, F.array()), lambda u: u["input_tokens"].isNull() & u["output_tokens"].isNull())})
