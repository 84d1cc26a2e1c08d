"""Operator 13: resampling documents toward a target distribution by hashed n-gram importance weights, bit-sliced.

1. Runs of one to three words are hashed to buckets by CRC-32.  The CRC of a run is put together from those of its words:
   a CRC is linear, so appending a word is a shift by its length (a table look-up) and an exclusive or.
2. Each task counts the buckets of all its texts and hands on one row a bucket; the sums of the corpus and of the target are
   so many rows as there are buckets, a constant, and give each bucket a whole-numbered gain.
3. A document's bucket counts become bit planes of as many bits as there are buckets (plane j holds bit j of each count);
   the gains become planes of their positive and of their negative parts.  AND, popcount and sums of powers of two
   give the exact weight.
4. Adding Gumbel noise that the seed and the id decide and taking the highest scores draws without replacement.  Ranks
   come from range-sorted numbers of ids and scores; no task and no driver sees them all.

Nothing but ids, counts and scores is shuffled.  A text is read twice and never leaves its task.

Defined results: null and empty texts, or such without words, have no features and weight 0; long texts are taken whole;
a null id counts as empty in the hash of the noise and comes first among equal scores; repeated rows score alike and
each takes a rank of its own; with an empty target every bucket's gain follows the corpus alone; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import inside, materialize, pieces, texts_of
from .sharding import global_numbers

BUCKETS = 10_000
GRAMS = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words of so many bytes or more are appended by zlib, one at a time.
LONG = 64

#: A-Z become a-z; digits, a-z and all bytes beyond ASCII stay; the rest separates words.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _shifts() -> np.ndarray:
    """[length, byte, value]: what each byte of a CRC adds to it when so many zero bytes are appended."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(POLYNOMIAL), step >> 1)
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(LONG):
        out[n + 1] = out[n] >> 8 ^ step[out[n] & 255]
    return out


_SHIFTS = _shifts()


def _shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs with size zero bytes appended, at most LONG of them."""
    return _SHIFTS[size, 0, crc & 255] ^ _SHIFTS[size, 1, crc >> 8 & 255] ^ _SHIFTS[size, 2, crc >> 16 & 255] ^ _SHIFTS[size, 3, crc >> 24]


def features(texts: list[bytes], grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to grams words, the text each is of, and the texts' word counts."""
    split = [t.translate(_AS_WORDS).split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for doc in split for w in doc]
    total, of = len(words), np.repeat(np.arange(len(split)), counts)
    run = np.fromiter(map(zlib.crc32, words), np.uint32, total)
    size = np.fromiter(map(len, words), np.int64, total)
    long, short = np.flatnonzero(size >= LONG), np.minimum(size, LONG - 1)
    tail = _shift(np.full(total, zlib.crc32(b" "), np.uint32), short) ^ run  # of the word with a space before it
    crcs, ofs = [run], [of]
    for k in range(2, grams + 1):
        m = max(0, total - k + 1)
        before, run = run, _shift(run[:m], short[k - 1 :] + 1) ^ tail[k - 1 :]
        for at in long[long >= k - 1].tolist():
            run[at - k + 1] = zlib.crc32(words[at], zlib.crc32(b" ", int(before[at - k + 1])))
        there = inside(counts, k, total)
        crcs.append(run[there])
        ofs.append(of[:m][there])
    return np.concatenate(crcs), np.concatenate(ofs), counts


def bit_planes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, planes, words of 64 bits) of rows of numbers from 0, and what a bit of each plane stands for."""
    bits = max(1, int(numbers.max(initial=0)).bit_length())
    sliced = np.packbits(numbers[:, None, :] >> np.arange(bits)[:, None] & 1, axis=-1)
    sliced = np.pad(sliced, ((0, 0), (0, 0), (0, -sliced.shape[-1] % 8)))
    return np.ascontiguousarray(sliced).view(np.uint64), 1 << np.arange(bits, dtype=np.int64)


def weigh(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sums of counts times gains for each row of counts, by popcounts of planes; exact in 64 bits."""
    (planes, worth), out = bit_planes(counts), np.zeros(len(counts), np.int64)
    for sign in (1, -1):
        parts, value = bit_planes(np.maximum(sign * gains, 0)[None, :])
        for k in range(len(worth)):
            some = np.flatnonzero(planes[:, k].any(axis=-1))
            common = np.bitwise_count(planes[some, k][:, None, :] & parts).sum(axis=-1, dtype=np.int64)
            out[some] += sign * worth[k] * (common @ value)
    return out


def bucket_sums(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> list[int]:
    """How many features of all texts are in each bucket: a list of so many numbers, whatever the size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches):
            total += np.bincount(features(texts_of(b.column(0)), grams)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = [0] * buckets
    for r in df.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s, t, n = sum(corpus), sum(target), len(corpus)
    return [floor(1000 * log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(corpus, target, strict=True)]


def importance_weights(df: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS) -> DataFrame:
    """One row for each row of df: id, n_words, n_features, weight."""
    buckets, gain = len(gains), np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 32):
            crc, of, words = features(texts_of(b.column(1)), grams)
            cells = of * buckets + (crc % np.uint32(buckets)).astype(np.int64)
            counts = np.bincount(cells, minlength=b.num_rows * buckets).reshape(b.num_rows, buckets)
            columns = [pa.array(words), pa.array(np.bincount(of, minlength=b.num_rows)), pa.array(weigh(counts, gain))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema.names)

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def importance_resample(
    documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row for each document: id, n_words, n_features, weight, score, rank (null unless drawn)."""
    gains = bucket_gains(bucket_sums(documents, text_col, buckets, grams), bucket_sums(target, text_col, buckets, grams))
    weights = importance_weights(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gains, "id", "text", grams)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = materialize(weights.withColumn("score", F.col("weight") + noise).withColumn("last", -F.col("score")), "scores")
    numbered, n = global_numbers(scored.filter(F.col("n_words") >= least_words), ["last", "id"])
    rank = F.when(F.col("row_number") < percent * n // 100, F.col("row_number") + 1)
    out = numbered.withColumn("rank", rank.cast("long")).drop("row_number").unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's weight and score toward the benchmark, and the rank of the drawn."""
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(documents, benchmark).drop("n_words")


ORACLE_SQL = r"""
WITH w AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, r, array_to_string(w[i : i + k - 1], ' ') AS f, count(*) AS n FROM (SELECT side, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bucket AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM f), crc),
sums AS (SELECT b, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END) AS t FROM f JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM sums),
weight AS (SELECT r, sum(n) AS n, sum(n * g) AS w FROM f JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(d.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(x.w, 0) AS BIGINT) AS weight,
    CAST(coalesce(x.w, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w d LEFT JOIN weight x USING (r) WHERE side = 'd'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS m FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * m // 100 THEN k END AS rank FROM numbered
"""
