"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: white space is these six characters and nothing else.
SPACE = r"[\x20\x09-\x0D]"

ADD_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Fixed value: Spark's setting that removes the shuffle files of a query when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RECORDERS: list[list[str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder the cluster names; a temporary folder only on one machine where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage: write a table in the shared folder and read it again (survives lost executors).

    The shuffle files behind it go once it is written, so disk holds one step's shuffles at a time.
    """
    spark = df.sparkSession
    path, before = scratch(spark, tag), spark.conf.get(CLEAN_SHUFFLES, "false")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    for made in _RECORDERS:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """write_table() without the path."""
    return write_table(df, tag, partition_by)[0]


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables written meanwhile, for delete_tables() once nothing reads them any more."""
    made: list[str] = []
    _RECORDERS.append(made)
    try:
        yield made
    finally:
        _RECORDERS.remove(made)


def delete_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove superseded tables from the shared folder, by Hadoop's file systems, so any store that Spark writes to will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, *ADD_LOWER)


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, k1 and k2; maps, which can't be hashed, as JSON."""
    whole = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2")]


def count_words(text: Column) -> Column:
    """Number of words; null and empty texts have none.  No array of words survives the expression."""
    pieces = F.size(F.split(text, SPACE + "+"))
    edge = lambda pattern: F.when(text.rlike(pattern), 1).otherwise(0)
    n = pieces - edge("^" + SPACE) - edge(SPACE + r"\z")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(n).cast("long")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, to bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordHashes(dict):
    """64-bit hash of a word, kept while the words of a task repeat; forgets all beyond a size."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def flat_words(memo: WordHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Hashes of the words of several texts end to end, the word count of each text, and the words."""
    words = [t.split() for t in texts]  # bytes.split() cuts at exactly the six white-space characters
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((memo[w] for doc in words for w in doc), np.uint64, int(counts.sum()))
    return flat, counts, words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(flat: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of k values, by doubling; base is odd."""
    if len(flat) < k:
        return np.empty(0, np.uint64)
    power, done, width, out = flat, 0, 1, None
    while width <= k:
        if k & width:
            part = power[: len(flat) - k + 1] if out is None else power[done : done + len(flat) - k + 1]
            out = part if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part
            done += width
        if 2 * width <= k:
            power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2
    return mix64(out)


def inside(counts: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which runs of k values lie in one text."""
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(total)
    return (at + k <= ends)[: max(0, total - k + 1)]


def pack(a: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences."""
    return zlib.compress(np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(b: bytes, dtype: type) -> np.ndarray:
    raw, size = np.frombuffer(zlib.decompress(b), np.uint8), np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel(), dtype=dtype)
