"""Operator 5: substring deduplication by windows of words, with a count-min prefilter.

Documents are dealt to blocks by a hash; that is the one shuffle of texts in each of the three passes over them.
First pass: every block sketches its windows; the sketches merge by hash range, and each block learns which of its
windows are estimated to be repeated (estimates are never too low).  Second pass: blocks send only those, each
once, as 96-bit hashes to the task of their bucket, which counts them exactly and answers with one bit each.  Third
pass: blocks remove the words that repeated windows cover.

A hot passage reaches its bucket once from each block, however often it occurs.  Windows count as equal if 96 bits of
two hashes over 64-bit hashes of their words are equal.

Defined results: null and empty texts have no words; texts shorter than a window keep all words; long texts are
taken whole; repeated rows repeat all their windows and lose them; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import WordHashes, flat_words, inside, pack, pieces, texts_of, unpack, window_hashes, write_table
from .sketch import ANSWERED, ASKED, Sketch

WINDOW = 35
DEPTH, SPARE = 2, 3
BLOCK_BYTES = 8 << 20
BUCKET_WINDOWS = 2_000_000
#: Fixed odd bases of the two window hashes.
BASES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)

_MEMO = WordHashes()


def text_list(table: pa.Table) -> tuple[list[bytes], list[int]]:
    """The texts of a block in an order of their own, which doesn't depend on how rows came; and where each was."""
    texts = [t for b in pieces(iter(table.select(["text"]).to_batches())) for t in texts_of(b.column(0))]
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return [texts[k] for k in order], order


def windows_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Word hashes, word counts, places of the windows, and words of some texts end to end."""
    flat, counts, words = flat_words(_MEMO, texts)
    return flat, counts, np.flatnonzero(inside(counts, window, len(flat))), words


def different(flat: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two hashes of each different window at those places, in order, how often, and which is where."""
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int64))
    first = window_hashes(flat, window, BASES[0])[at]
    second = (window_hashes(flat, window, BASES[1])[at] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.append(True, (f[1:] != f[:-1]) | (s[1:] != s[:-1]))
    which = np.empty(len(f), np.int64)
    which[order] = np.cumsum(new) - 1
    return f[new], s[new], np.bincount(which, minlength=int(new.sum())), which


def judge(table: pa.Table) -> pa.Table:
    """Counts the windows of a bucket exactly: for each block that sent some, which of them occur twice or more."""
    firsts = [np.frombuffer(b, np.uint64) for b in table["first"].to_pylist()]
    sizes = [len(f) for f in firsts]
    first, second = np.concatenate(firsts), np.concatenate([np.frombuffer(b, np.uint32) for b in table["second"].to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(table["twice"].to_pylist(), sizes, strict=True)])
    order = np.lexsort((second, first))
    f, s, t = first[order], second[order], twice[order]
    same = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
    group = np.cumsum(np.append(True, ~same)) - 1
    repeated = (np.bincount(group) > 1) | (np.bincount(group, t) > 0)
    answer = np.empty(len(f), bool)
    answer[order] = repeated[group]
    bits = [np.packbits(x).tobytes() for x in np.split(answer, np.cumsum(sizes)[:-1])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary()), "n": pa.array(sizes, pa.int32())})


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of df: id, n_words, n_removed, and kept_text (the kept words, joined by one space)."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, total // BLOCK_BYTES + 1)
    buckets = max(2 * least, int(total // 6 // BUCKET_WINDOWS + 1))
    sketch = Sketch(total / 6, DEPTH, SPARE, 2 * least)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    by_block = docs.repartition(blocks, "block").groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        flat, _, at, _ = windows_of(text_list(table)[0], window)
        return sketch.ask(table["block"][0].as_py(), window_hashes(flat, window, BASES[0])[at] if len(at) else np.zeros(0, np.uint64))

    def bucket_cuts(first: np.ndarray) -> np.ndarray:
        edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)
        return np.searchsorted(first, edges)

    kinds = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("twice", pa.binary())])

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The windows estimated repeated, by bucket; their places in bucket -1."""
        if not table.num_rows:
            return kinds.empty_table()
        flat, _, at, _ = windows_of(text_list(table)[0], window)
        if not len(at):
            return kinds.empty_table()
        at = at[sketch.read(answers, window_hashes(flat, window, BASES[0])[at]) > 0]
        first, second, times, _ = different(flat, at, window)
        cuts, twice = bucket_cuts(first), times > 1
        rows = [(k, f.tobytes(), s.tobytes(), np.packbits(t).tobytes()) for k, (f, s, t) in enumerate(zip(np.split(first, cuts), np.split(second, cuts), np.split(twice, cuts), strict=True)) if len(f)]
        rows.append((-1, pack(at.astype(np.uint32)), b"", b""))
        block = table["block"][0].as_py()
        return pa.table([[r[0] for r in rows], [block] * len(rows), *([r[k] for r in rows] for k in (1, 2, 3))], schema=kinds)

    asked = by_block.applyInArrow(ask, ASKED)
    answered = asked.groupBy("range").applyInArrow(sketch.judge(lambda n: n > 1), ANSWERED)
    sent, _ = write_table(by_block.cogroup(answered.groupBy("block")).applyInArrow(send, "bucket int, block long, first binary, second binary, twice binary"), "windows")
    exact = sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(judge, "block long, bucket int, bits binary, n int")
    answers = exact.unionByName(sent.filter("bucket < 0").select("block", "bucket", F.col("first").alias("bits"), F.lit(0).alias("n")))
    schema = T.StructType([docs.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = table["id"]
        if not table.num_rows:
            return pa.table({f.name: pa.array([], k) for f, k in zip(schema, (ids.type, pa.int64(), pa.int64(), pa.string()), strict=True)})
        texts, order = text_list(table)
        flat, counts, words = flat_words(_MEMO, texts)
        edge = np.zeros(len(flat) + 1, np.int64)
        parts = dict(zip(answers["bucket"].to_pylist(), zip(answers["bits"].to_pylist(), answers["n"].to_pylist(), strict=True), strict=True))
        if -1 in parts:
            at = unpack(parts.pop(-1)[0], np.uint32).astype(np.int64)
            *_, which = different(flat, at, window)
            repeated = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, (b, n) in sorted(parts.items()))]).astype(bool)
            hit = at[repeated[which]]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
        kept = np.cumsum(edge[:-1]) == 0
        ends = np.cumsum(counts)
        running = np.append(0, np.cumsum(~kept))
        left = [b" ".join(w if k.all() else compress(w, k)).decode() for w, k in zip(words, np.split(kept, ends[:-1]), strict=True)]
        removed = running[ends] - running[ends - counts]
        return pa.table({"id": ids.take(pa.array(order)), "n_words": pa.array(counts), "n_removed": pa.array(removed), "kept_text": pa.array(left, pa.string())})

    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
    return out.withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and the digest of what is kept of every document."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (s)),
gone AS (SELECT r, list(p) AS ps FROM hit GROUP BY r),
kept AS (SELECT d.r, coalesce(string_agg(d.word, ' ' ORDER BY d.p), '') AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN hit h ON d.r = h.r AND d.p = h.p WHERE h.p IS NULL GROUP BY d.r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.r = gone.r LEFT JOIN kept ON d.r = kept.r
"""
