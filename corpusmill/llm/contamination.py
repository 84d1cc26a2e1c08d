"""Operator 6: benchmark decontamination with suffix arrays of the training texts.

Words of the benchmark get numbers.  Each task numbers the words of its shard of documents (consecutive rows of
bounded size), sorts the shard's suffixes in full (prefix doubling; a suffix ends at the first word the benchmark doesn't
have) and binary-searches every suffix of every test item among them.  Suffixes that find their window are hits, and all its
places are read off the array: the longest verbatim matches are what such windows cover together.  Suffixes with the same
window are one class, so repeated text and items with common heads cost no more than other text.  There is no shuffle.
longest_matches() reports each test suffix's longest match, and its place, over all shards.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words, so what a task holds is bounded; with more
than one block the documents are scanned once for each block and the hits are merged by row.

Defined results: null or empty texts have no words and are clean; null items and items without words have no
windows; rows with a null item_id mark hits but are not listed; repeated item_ids count once; repeated documents
are judged alike; long texts are searched whole; empty tables work; other columns are not looked at, and
decontaminate() keeps all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import materialize, texts_of

WINDOW = 13
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 4 << 20

#: Word bytes are digits, lower-cased letters and all of non-ASCII; the rest is space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class TestItems:
    """A block of items as one array of word numbers, each item ended by a zero.  Short items are windows of their own."""

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        parts = [np.array([*(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)), 0], np.int64) for _, t in items]
        self.numbers = np.concatenate([np.zeros(0, np.int64), *parts])
        size = np.array([len(p) - 1 for p in parts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        self.start = np.flatnonzero(self.numbers)  # of every suffix
        self.item = np.repeat(np.arange(len(parts)), size)
        self.place = self.start - np.repeat(begin, size)
        self.left = np.repeat(size, size) - self.place
        self.width = np.minimum(window, np.repeat(size, size))
        self.shortest = int(self.width.min()) if len(self.width) else window
        #: The ids as strings, each once, sorted; and which of them an item has (-1: null).
        self.labels = sorted({str(i) for i in self.ids if i is not None})
        at = {label: k for k, label in enumerate(self.labels)}
        self.label = np.array([-1 if i is None else at[str(i)] for i in self.ids], np.int64)


def suffix_array(numbers: np.ndarray, shortest: int) -> np.ndarray:
    """Places of the known words in the order of what follows them up to the next zero; runs too short for any window are
    left out.  numbers: zeros for unknown words and for the ends of texts, and one at the end."""
    at, breaks = np.flatnonzero(numbers), np.flatnonzero(numbers == 0)
    end = np.searchsorted(breaks, at)
    run = breaks[end] - at
    begin = np.where(end > 0, breaks[end - 1] + 1, 0)
    long = breaks[end] - begin >= shortest
    at, run = at[long], run[long]
    if not len(at):
        return at
    rank, step = np.zeros(len(numbers), np.int64), 1
    rank[at] = numbers[at]
    while True:
        after = np.where(step < run, rank[np.minimum(at + step, len(numbers) - 1)], 0)
        keys, place = np.unique(rank[at] * (rank.max() + 1) + after, return_inverse=True)
        rank[at] = place + 1
        step *= 2
        if len(keys) == len(at) or step > run.max():
            return at[np.argsort(rank[at], kind="stable")]


def compare(numbers: np.ndarray, p: np.ndarray, tests: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of places: sign of the shard's suffix at p against the first limit words of the test's at q, and how
    many words they share."""
    sign, same = np.zeros(len(p), np.int8), np.zeros(len(p), np.int64)
    live = np.flatnonzero(limit > 0)
    k = 0
    while len(live):
        a, b = numbers[np.minimum(p[live] + k, len(numbers) - 1)], tests[q[live] + k]
        equal = (a == b) & (a > 0)
        sign[live[~equal]] = np.sign(a - b)[~equal]
        live = live[equal]
        same[live] += 1
        k += 1
        live = live[limit[live] > k]
    return sign, same


def bound(numbers: np.ndarray, order: np.ndarray, tests: np.ndarray, q: np.ndarray, limit: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of many test suffixes at once: how many of the shard's come before (right: or begin with) each."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order))
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        sign, _ = compare(numbers, order[mid], tests, q[live], limit[live])
        up = sign <= 0 if right else sign < 0
        lo[live[up]] = mid[up] + 1
        hi[live[~up]] = mid[~up]
        live = live[lo[live] < hi[live]]
    return lo


def longest(numbers: np.ndarray, order: np.ndarray, tests: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix: the length of its longest match in the shard, and a place of it."""
    at = bound(numbers, order, tests.numbers, tests.start, tests.left, False)
    best, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for near in (at - 1, at):  # what shares most words with a suffix stands next to it
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        _, same = compare(numbers, order[near[ok]], tests.numbers, tests.start[ok], tests.left[ok])
        more = same > best[ok]
        best[ok[more]], place[ok[more]] = same[more], order[near[ok[more]]]
    return best, place


class Shard:
    """Texts as one array of word numbers, each ended by a zero, with their suffix array."""

    def __init__(self, texts: list[bytes], tests: TestItems):
        get = tests.vocabulary.get
        words = [words_of(t) for t in texts]
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.numbers = np.zeros(int((self.size + 1).sum()), np.int64)
        for at, w in zip(self.begin.tolist(), words, strict=True):
            self.numbers[at : at + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        self.order = suffix_array(self.numbers, tests.shortest) if len(tests.start) else np.zeros(0, np.int64)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1


class Hits(NamedTuple):
    """What a shard's texts have of the test windows: word counts, hit runs of words by text, labels by text."""

    size: np.ndarray
    run_text: np.ndarray
    run_start: np.ndarray
    run_end: np.ndarray
    label_text: np.ndarray
    label: np.ndarray

    def ranges(self) -> list[list[list[int]]]:
        out: list[list[list[int]]] = [[] for _ in self.size]
        for t, a, b in zip(self.run_text.tolist(), self.run_start.tolist(), self.run_end.tolist(), strict=True):
            out[t].append([a, b])
        return out

    def items(self, labels: list[str]) -> pa.Array:
        ends = np.searchsorted(self.label_text, np.arange(len(self.size) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(labels, pa.string()).take(pa.array(self.label)))

    def hit_words(self) -> np.ndarray:
        return np.bincount(self.run_text, self.run_end - self.run_start, len(self.size)).astype(np.int64)


def scan(texts: list[bytes], tests: TestItems) -> Hits:
    """Every test suffix is searched for its window.  Suffixes with the same window have the same stretch of the suffix array:
    they are one class, whose places are marked once and whose items are listed once for each text."""
    shard = Shard(texts, tests)
    whole = np.flatnonzero(tests.left >= tests.width)  # a suffix shorter than its window has none
    lo, hi = (bound(shard.numbers, shard.order, tests.numbers, tests.start[whole], tests.width[whole], right) for right in (False, True))
    there = hi > lo
    lo, hi, hit = lo[there], hi[there], whole[there]
    classes, which = np.unique(np.stack([lo, hi, tests.width[hit]]), axis=1, return_inverse=True)
    which = which.ravel()
    of_class = np.split(tests.label[tests.item[hit[np.argsort(which, kind="stable")]]], np.cumsum(np.bincount(which, minlength=classes.shape[1]))[:-1]) if len(hit) else []
    edge = np.zeros(len(shard.numbers) + 1, np.int64)
    found: dict[int, list[np.ndarray]] = {}
    for (first, last, width), labels in zip(classes.T.tolist(), of_class, strict=True):
        places, labels = shard.order[first:last], np.unique(labels[labels >= 0])
        edge[places] += 1  # the places of a class are all different
        edge[places + width] -= 1
        for t in np.unique(shard.text_of(places)).tolist():
            found.setdefault(t, []).append(labels)
    covered = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    start, end = np.flatnonzero(np.diff(covered) > 0), np.flatnonzero(np.diff(covered) < 0)
    text = shard.text_of(start)
    labels = {t: np.unique(np.concatenate(x)) for t, x in sorted(found.items())}
    none = np.zeros(0, np.int64)
    label_text = np.repeat(np.array([*labels], np.int64), [len(x) for x in labels.values()])
    return Hits(shard.size, text, start - shard.begin[text], end - shard.begin[text], label_text, np.concatenate([none, *labels.values()]))


def shards_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about SHARD_BYTES of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SHARD_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestItems]:
    """The benchmark in blocks of a bounded number of words, streamed through the driver one at a time."""
    rows, n = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        rows.append((r.i, (r.t or "").encode()))
        n += len(rows[-1][1]) // 4
        if n >= block_words:
            yield TestItems(rows, window)
            rows, n = [], 0
    if rows:
        yield TestItems(rows, window)


def _block_count(benchmark: DataFrame, text_col: str, block_words: int) -> bool:
    """Whether one block holds the benchmark."""
    return (benchmark.agg(F.sum(F.octet_length(text_col))).head()[0] or 0) // 4 < block_words


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType())),
])


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each document: id, n_words, ranges (hit words, [start, end)), items (ids as strings, sorted)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType

    def one(source: DataFrame, tests: TestItems | None, schema: T.StructType, carried: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(tests or TestItems([], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for batch in shards_of(batches, 1):
                found = scan(texts_of(batch.column(1)), t)
                anonymous = [pa.array(found.size), pa.array(found.ranges(), pa.list_(pa.list_(pa.int32()))), found.items(t.labels)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in range(2, 2 + carried)), *anonymous], schema.names)

        return source.mapInArrow(run, schema)

    if _block_count(benchmark, item_text_col, block_words):
        tests = next(test_blocks(benchmark, item_col, item_text_col, window, 1 << 60), None)
        return one(docs, tests, T.StructType([T.StructField("id", id_type), *RESULT]), 0).withColumnRenamed("id", id_col)
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "contamination")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType()), *RESULT])
    parts = [materialize(one(docs, t, schema, 1), "contamination-block") for t in test_blocks(benchmark, item_col, item_text_col, window, block_words)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = F.sort_array(F.flatten(F.collect_list("ranges")))
    grouped = every.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), spans.alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = "aggregate(ranges, cast(array() as array<array<int>>), (a, r) -> case when size(a) > 0 and r[0] <= element_at(a, -1)[1] then concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(r[1], element_at(a, -1)[1])))) else concat(a, array(r)) end)"
    return grouped.select(F.col("id").alias(id_col), "n_words", F.expr(join).alias("ranges"), "items")


N_HIT = "aggregate(ranges, 0L, (a, r) -> a + r[1] - r[0])"


def longest_matches(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Of every test suffix that matches at least its window somewhere: item, item_place, length of the longest verbatim
    match over all documents, and the document and place (of least id and place) that hold it."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_place", T.IntegerType()), T.StructField("length", T.IntegerType()), docs.schema["id"], T.StructField("place", T.IntegerType())])

    def one(tests: TestItems) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for batch in shards_of(batches, 1):
                shard = Shard(texts_of(batch.column(1)), t)
                length, _ = longest(shard.numbers, shard.order, t)
                hit = np.flatnonzero(length >= t.width)
                sides = [bound(shard.numbers, shard.order, t.numbers, t.start[hit], length[hit], right) for right in (False, True)]
                classes, which = np.unique(np.stack([*sides, length[hit]]), axis=1, return_inverse=True)
                ids = batch.column(0).to_pylist()
                known = {x: k for k, x in enumerate(sorted({x for x in ids if x is not None}))}
                rank = np.array([known.get(x, -1) for x in ids], np.int64)  # nulls first
                least = np.zeros(classes.shape[1], np.int64)
                for k, (first, last, _) in enumerate(classes.T.tolist()):
                    places = shard.order[first:last]
                    docs = shard.text_of(places)
                    least[k] = places[np.lexsort((places - shard.begin[docs], rank[docs]))[0]]
                places = least[which.ravel()]
                docs = shard.text_of(places)
                names = [None if t.ids[i] is None else str(t.ids[i]) for i in t.item[hit].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(t.place[hit].astype(np.int32)), pa.array(length[hit].astype(np.int32)), batch.column(0).take(pa.array(docs)), pa.array((places - shard.begin[docs]).astype(np.int32))], schema.names)

        return docs.mapInArrow(run, schema)

    found = None
    for tests in test_blocks(benchmark, item_col, item_text_col, window, block_words):
        found = one(tests) if found is None else found.unionByName(one(tests))
    if found is None:
        found = documents.sparkSession.createDataFrame([], schema)
    best = found.groupBy("item", "item_place").agg(F.min(F.struct((-F.col("length")).alias("minus"), "id", "place")).alias("b"))
    return best.select(F.col("item").cast(items).alias(item_col), "item_place", (-F.col("b.minus")).alias("length"), F.col("b.id").alias(id_col), F.col("b.place").alias("place"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns kept, without those that are contaminated (hits of a twentieth of the words or more).

    In one pass while the benchmark fits one block; else by the general way and a join on a number of the written row.
    """
    spark = documents.sparkSession
    if not _block_count(benchmark, "text", block_words):
        row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
        numbered = materialize(documents.select(row.alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "decontaminate")
        found = find_contamination(numbered, benchmark, "row", "text", window=window, block_words=block_words)
        bad = found.filter(f"{N_HIT} > 0 and 20 * {N_HIT} >= n_words").select("row")
        return numbered.join(bad, "row", "left_anti").select("doc.*")
    shared = spark.sparkContext.broadcast(next(test_blocks(benchmark, "item_id", "text", window, 1 << 60), None) or TestItems([], window))
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards_of(batches, at):
            found = scan(texts_of(batch.column(at)), shared.value)
            n = found.hit_words()
            yield batch.filter(pa.array((n == 0) | (20 * n < found.size)))

    return documents.mapInArrow(run, documents.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: hits and items of every document."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.selectExpr("doc_id", "n_words", f"{N_HIT} as n_hit", "cast(size(items) as long) as n_items", "sha2(array_join(items, ','), 256) as items_sha256", f"{N_HIT} > 0 and 20 * {N_HIT} >= n_words as contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
