"""Operator 7: sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..n-1 in the order of (id, CRC-32, size, 64-bit hash of the text), which doesn't depend
on files or partitions: only these few numbers are range-partitioned and sorted, not the texts, and each
partition adds the count of all before it.  A keyed Feistel network over the smallest a x b grid that holds n
permutes the numbers; a result beyond n - 1 is permuted again (cycle walking).  Position p goes to shard
p mod shards, slot p div shards, so counts differ by one at most (law `rows`) and anyone who knows n and the
seed computes shard and slot of a row number, or the row number of a slot, without a table.

Defined results: null ids come first and null texts count as empty (size 1); rows that are equal in all four
numbers are alike, so which of them gets which of their places doesn't matter; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import materialize

SHARDS = 8
ROUNDS = 6
SEED = 20_240_607
#: Fixed values of the round function: a prime below 2**31 and two odd multipliers.
PRIME, MUL, STEP = 2_147_483_647, 1_103_515_245, 69_069


def _round(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    y = (x % PRIME * MUL + seed % PRIME + k * STEP) % PRIME
    return (y * y + x) % PRIME


def _once(x: np.ndarray, a: int, b: int, seed: int, back: bool) -> np.ndarray:
    left, right = x // b, x % b
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2:
            right = (right + sign * _round(left, k, seed)) % b
        else:
            left = (left + sign * _round(right, k, seed)) % a
    return left * b + right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, on an array of numbers."""
    if n <= 1:
        return x.copy()
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    out = _once(np.asarray(x, np.int64), a, b, seed, back)
    while (over := out >= n).any():  # ends: a permutation of the grid brings each number back below n
        out[over] = _once(out[over], a, b, seed, back)
    return out


def global_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with column row_number 0..n-1 in the order of the named columns, and n.  No task sees all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "row-numbers")
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row for each partition
    before, n = [], 0
    for r in counts:
        before.append((r.p, n))
        n += r["count"]
    starts = F.broadcast(spark.createDataFrame(before or [(0, 0)], "__p long, __before long"))
    numbered = ranged.join(starts, part == F.col("__p")).withColumn("row_number", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
    return numbered.drop("__at", "__p", "__before"), n


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    numbered, n = global_numbers(keys, ["id", "text_crc32", "size", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b["row_number"].to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([b["id"], b["size"], b["text_crc32"], b["row_number"], pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], schema.names)

    schema = T.StructType([
        numbered.schema["id"], *(T.StructField(c, T.LongType()) for c in ("size", "text_crc32", "row_number")), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()),
    ])
    return numbered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's shard and slot."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.selectExpr("doc_id", "size", "text_crc32", "'rows' as law", "shard", "slot", "cast(null as int) as grown_shard")


_F = "(((({x} % 2147483647) * 1103515245 + 20240607 + {k} * 69069) % 2147483647) * ((({x} % 2147483647) * 1103515245 + 20240607 + {k} * 69069) % 2147483647) + {x}) % 2147483647"


def _sql_once(x: str, src: str) -> str:
    """SQL of one pass of the network over column x of src, as nested selects."""
    q = f"SELECT *, {x} // b AS l0, {x} % b AS r0 FROM {src}"
    for k in range(ROUNDS):
        new = f"(r{k} + {_F.format(x=f'l{k}', k=k)}) % b AS r{k + 1}, l{k} AS l{k + 1}" if k % 2 else f"(l{k} + {_F.format(x=f'r{k}', k=k)}) % a AS l{k + 1}, r{k} AS r{k + 1}"
        q = f"SELECT *, {new} FROM ({q})"
    return f"SELECT r, n, a, b, size, c, doc_id, l{ROUNDS} * b + r{ROUNDS} AS y FROM ({q})"


ORACLE_SQL = f"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS c FROM bytes, crc),
m AS (SELECT CAST(count(*) AS BIGINT) AS n FROM documents),
g AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM m)),
num AS (SELECT CAST(row_number() OVER (ORDER BY doc_id, c, size) - 1 AS BIGINT) AS r, n, a, b, CAST(size AS BIGINT) AS size, c, doc_id FROM k, g),
walk AS ({_sql_once('r', 'num')}
  UNION ALL SELECT * FROM ({_sql_once('y', '(SELECT * FROM walk WHERE y >= n)')}))
SELECT doc_id, size, CAST(c AS BIGINT) AS text_crc32, 'rows' AS law, CAST(y % 8 AS INTEGER) AS shard, y // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE y < n
"""
