"""Exact filtered vector search for batches of questions, context assembly and source lists."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .scratch import written

#: Passages for a question, and what is said where there is none.
TOP = 6
NO_HITS = "No passages found in the corpus for that query."
#: Numbers in a block of vectors, scores worked out at once, and rows that are worth a block.
BLOCK_NUMBERS, SCORES, LEAST_ROWS = 1 << 22, 1 << 21, 1000

#: From texts to vectors.
Model = Callable[[list[str]], list[list[float]]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def check_dimension(vectors: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Fails where a vector has another length."""
    return vectors.withColumn(col, F.when(F.size(col) == dim, F.col(col)).otherwise(F.raise_error(F.lit(f"vectors of {dim} numbers are expected"))))


def _extent(vectors: DataFrame) -> tuple[int, int]:
    """How many vectors there are, and their one length (0 if there are none)."""
    n, low, high = vectors.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).head()
    if low != high:
        raise ValueError(f"vectors have lengths from {low} to {high}")
    return n, high or 0


def _best(scores: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest of each column of s @ q.T, rows first on a tie; -inf in scores is no score.
    Column by column.

    scores is that product, whose last digits depend on the blocks' shapes; what it can't tell apart is summed again from the
    first number on, so that a pair of vectors has one score in any block and equal vectors are a tie.
    """
    there = scores > -np.inf
    if len(scores) > k:
        unsure = 4 * s.shape[1] * 2.0**-53 * np.linalg.norm(s, axis=1).max() * np.linalg.norm(q, axis=1)
        there &= scores >= np.partition(scores, -k, axis=0)[-k] - unsure
    row, column = np.nonzero(there)
    score = np.zeros(len(row))
    for x, y in zip(s.T, q.T, strict=True):
        score += x[row] * y[column]
    order = np.lexsort((row, -score, column))
    row, column, score = row[order], column[order], score[order]
    kept = np.arange(len(column)) - np.searchsorted(column, column) < k
    return row[kept], column[kept], score[kept]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP, query_filter: str | None = None) -> DataFrame:
    """query_id, id, score, rank of the k nearest of each query by dot product, ties by id.

    Queries(query_id, embedding[, query_filter]) and vectors(id, embedding[, query_filter]) are cut into blocks of about
    BLOCK_NUMBERS numbers by hashes; a task multiplies one block of each and keeps k of its rows a query, and one
    window takes the best of those.  The plan is the same for any number of either; the driver sees counts only.
    With query_filter, a query sees only vectors whose column of that name equals its own (null: all).  Ids are integers
    or strings; a null vector is near nothing; vectors of several lengths are an error; queries of equal id (or null
    ids) are ranked together.
    """
    narrow = lambda df, key: df.select(key, "embedding", (F.col(query_filter) if query_filter else F.lit(None)).cast("string").alias("f")).filter("embedding is not null")
    asked, stored = narrow(queries, "query_id"), narrow(vectors, "id")
    (n_asked, dim), (n_stored, other) = _extent(asked), _extent(stored)
    if dim and other and dim != other:
        raise ValueError(f"queries have {dim} numbers, vectors {other}")
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda n, least: max(least, -(-n * max(dim, 1) // BLOCK_NUMBERS))
    left, right = blocks(n_asked, 1), blocks(n_stored, min(spread, -(-n_stored // LEAST_ROWS)) or 1)
    schema = T.StructType([asked.schema["query_id"], stored.schema["id"], T.StructField("score", T.DoubleType())])

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key, "embedding"), F.lit(n)).cast("int")  # as every(): both sides are dealt by hashes of one type

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.withColumn("a", block("query_id", left)).withColumn("b", every(right)).groupBy("a", "b")
    b = stored.withColumn("b", block("id", right)).withColumn("a", every(left)).groupBy("a", "b")

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        names = pa.schema([("query_id", asked.schema.field("query_id").type), ("id", stored.schema.field("id").type), ("score", pa.float64())])
        if not asked.num_rows or not stored.num_rows:
            return names.empty_table()
        stored = stored.sort_by("id")
        q, wanted = numbers(asked["embedding"]), np.array(asked["f"].to_pylist(), object)
        found: list[tuple] = []
        step = max(1, SCORES // len(q))
        for at in range(0, stored.num_rows, step):
            part = stored.slice(at, step)
            s = numbers(part["embedding"])
            scores = s @ q.T
            if query_filter:
                there = np.array(part["f"].to_pylist(), object)
                scores[(there[:, None] != wanted[None, :]) & np.array([f is not None for f in wanted])[None, :]] = -np.inf
            row, column, score = _best(scores, s, q, k)
            found.append((row + at, column, score))
        row, column, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((row, -score, column))
        row, column, score = row[order], column[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(column, column) < k
        return pa.table([asked["query_id"].take(pa.array(column[kept])), stored["id"].take(pa.array(row[kept])), pa.array(score[kept])], schema=names)

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return a.cogroup(b).applyInArrow(search, schema).withColumn("rank", rank).filter(F.col("rank") <= k)


def context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: the passages as text, and the grounding text; a fixed message without hits.

    hits(query_id, rank, citation, source_type, source_url, text).
    """
    cite, kind = F.coalesce(F.when(F.col("citation") != "", F.col("citation")), F.lit("(uncited)")), F.coalesce(F.when(F.col("source_type") != "", F.col("source_type")), F.lit("?"))
    link = F.when(F.coalesce("source_url", F.lit("")) != "", F.concat(F.lit("\nURL: "), F.col("source_url"))).otherwise(F.lit(""))
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cite, F.lit("  ("), kind, F.lit(")"), link, F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct("rank", passage.alias("p"), F.concat(cite, F.lit("\n"), F.col("text")).alias("g"))))
    packed = hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["p"]), "\n---\n").alias("passages"), F.array_join(F.transform(rows, lambda r: r["g"]), "\n\n").alias("grounding"), F.count(F.lit(1)).alias("n_hits"))
    return queries.select("query_id").join(packed, "query_id", "left").select("query_id", F.coalesce("passages", F.lit(NO_HITS)).alias("passages"), F.coalesce("grounding", F.lit("")).alias("grounding"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def sources(hits: DataFrame) -> DataFrame:
    """Different (citation, url) of each query, in the order of retrieval."""
    first = W.partitionBy("query_id", "citation", "source_url").orderBy("rank")
    return hits.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def retrieve(questions: DataFrame, stored: DataFrame, model: Model, dim: int, k: int = TOP, filter_col: str | None = None) -> DataFrame:
    """From questions (query_id, question[, filter_col]) to passages in one call: embed (once, to a written table), search, assemble.

    stored(id, embedding, text, citation, source_type, source_url); its vectors must have dim numbers.
    """
    asked = written(embed(questions.withColumnRenamed("question", "text"), model).drop("text"), "questions")
    near = top_k(asked, check_dimension(stored, dim), k, filter_col)
    return context(near.join(stored.drop("embedding"), "id"), questions)


#: The model of each embed() call in this Python worker; one at a time.
_MODELS: dict[str, Model] = {}


def _model(name: str, factory: Callable[[], Model]) -> Model:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = factory()
    return _MODELS[name]


def embed(df: DataFrame, model: Model | None = None, text_col: str = "text", factory: Callable[[], Model] | None = None) -> DataFrame:
    """df with `embedding`, a batch of texts at a time, null as an empty text.

    model: a function from texts to vectors, sent along with the task.  factory: makes such a function where it is needed,
    once in each Python worker whatever the number of its tasks and batches, for models that are dear to load.
    """
    if (model is None) == (factory is None):
        raise ValueError("give a model or a factory")
    at, names, name = df.columns.index(text_col), df.columns, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors_of = model or _model(name, factory)
        for batch in batches:
            vectors = vectors_of([t or "" for t in batch.column(at).to_pylist()])
            ends = np.cumsum([0, *(len(v) for v in vectors)], dtype=np.int32)
            numbers = np.concatenate([np.empty(0), *(np.asarray(v, np.float64) for v in vectors)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers))], [*names, "embedding"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def embed_hashed(df: DataFrame, dim: int = 64, text_col: str = "text") -> DataFrame:
    """df with `embedding` without a model and without Python: hashed counts of words, of unit length (zero for no words)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), lambda w: w != "")
    counted = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__counts").transform(df.withColumn("__words", words))
    unit = Normalizer(p=2.0, inputCol="__counts", outputCol="__unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__words", "__counts", "__unit")


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Offline stand-in for a model: signed hashed words, of unit length."""
    import zlib

    out = np.zeros((len(texts), dim))
    for row, t in zip(out, texts, strict=True):
        for w in t.lower().encode().split():
            h = zlib.crc32(w)
            row[h % dim] += 1 if h >> 31 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()
