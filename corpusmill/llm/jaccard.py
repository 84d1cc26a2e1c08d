"""Operator 8: exact Jaccard join on word shingles as a blocked sparse product of documents by n-grams.

1. Documents are dealt to blocks by a hash.  A sketch over hash ranges tells each block in how many documents its
   shingles occur, never too few.  A document whose repeated shingles are fewer than the threshold's share of its
   size can't be linked (a size-derived bound) and drops out; most do.
2. Documents with equal sets become one class, named by a 128-bit digest.  Inside the block its shingles are ranked from
   rare to frequent, and only the rarest few, which two linked classes must have one of in common (another
   size-derived bound), are looked up.
3. Classes are cut into blocks of about BLOCK_CLASSES by their most frequent such shingle.  Each pair of blocks
   with a shingle in common is one small task: the product of the two incidence matrices accumulates the overlap
   counts, pairs below the bound are discarded, and a spanning forest of the links and each class's number of
   links leave the task, so no task emits all pairs of a group.
4. Components come from alternating star contraction, distributed, with a written table between rounds.

Groups of copies are one class each, whatever their size; a large group of near copies is spread over block pairs.
Shingles are compared by 64-bit hashes: two different ones in the same pair of documents are equal with probability 2**-64.

Defined results: null and empty texts, or such without words, have no shingles and no links; fewer words than a
shingle form one shingle; long texts are taken whole; repeated rows are copies; null ids never name a component
unless all its ids are null; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import WordHashes, delete_tables, flat_words, materialize, mix64, pieces, texts_of, window_hashes, write_table
from .sketch import ANSWERED, ASKED, Sketch

SHINGLE = 4
PERCENT = 85
BLOCK_BYTES = 8 << 20
BLOCK_CLASSES = 500
COLUMNS = 2048
SPARE = 5
BASE = 0x9E3779B97F4A7C15

_MEMO = WordHashes()


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    flat, counts, _ = flat_words(_MEMO, [t.lower() for t in texts])  # bytes.lower() changes A-Z only
    runs = window_hashes(flat, k, BASE)
    ends, out = np.cumsum(counts), []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(runs[end - n : end - k + 1]))
        elif n:
            h = np.uint64(n)
            for x in flat[end - n : end]:
                h = mix64(np.array([h ^ x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(table: pa.Table, k: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The sets of a block's documents and their digests; none for an empty set."""
    sets = [s for b in pieces(iter(table.select(["text"]).to_batches())) for s in shingle_sets(texts_of(b.column(0)), k)]
    return sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def frequency(totals: np.ndarray) -> np.ndarray:
    """0 for shingles of one document, else a number that grows with the logarithm of how many."""
    return np.where(totals > 1, 2 * np.log2(np.maximum(totals, 1)), 0)


def block_product(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of left, rows of right) by products of incidence blocks, columns shared by two rows only."""
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(at, minlength=len(tokens)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, (first, first + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], at[lo:hi] - first] = 1
        overlap += part[left] @ part[right].T
    o, union = overlap.astype(np.int64), sizes[left][:, None] + sizes[right][None, :]
    return np.nonzero(100 * o >= percent * (union - o))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what all the links connect."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def components(edges: DataFrame) -> DataFrame:
    """From links (x, y): each node with the least node of its component (node, root).  Alternating stars.

    The least neighbours are written before they are joined, so Spark can split the rows of a hub.
    """
    spark, last = edges.sparkSession, None
    edges, path = write_table(edges.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least, p1 = write_table(both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x")), "least")
        large, p2 = write_table(both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "stars")
        least, p3 = write_table(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        small = large.join(least, "x").filter("y != m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y"))
        edges, p4 = write_table(small.unionByName(least.select("x", F.col("m").alias("y"))).filter("x != y").distinct(), "links")
        delete_tables(spark, (path, p1, p2, p3))
        path = p4
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).head()
        if state == last:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        last = state


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, n_links (documents it is linked with directly),
    text_hash, and is_first (the id and text are those of least id and hash of the component)."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, total // BLOCK_BYTES + 1)
    sketch = Sketch(total / 6, 1, SPARE, 2 * parts)
    by_block = docs.withColumn("block", F.pmod(F.xxhash64("id", "text_hash"), F.lit(blocks))).repartition(blocks, "block").groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        sets, names = sets_of(table, k)
        seen: dict[bytes | None, int] = {}
        few = []  # a set counts twice at most, however many copies a block holds
        for s, c in zip(sets, names, strict=True):
            seen[c] = seen.get(c, 0) + 1
            if seen[c] <= 2:
                few.append(s)
        return sketch.ask(table["block"][0].as_py(), np.concatenate([np.zeros(0, np.uint64), *few]))

    schema = T.StructType([
        docs.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()),
        T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType())),
    ])

    def survive(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Every document, with a class if it may be linked; the first of a class in the block brings its shingles."""
        sets, names = sets_of(table, k)
        codes = sketch.read(answers, np.concatenate([np.zeros(0, np.uint64), *sets]))
        seen: set[bytes] = set()
        at, classes, tokens, prefixes = 0, [], [], []
        for s, c in zip(sets, names, strict=True):
            code = codes[at : at + len(s)]
            at += len(s)
            hit = code > 0
            common = int(hit.sum())
            linked = common > 0 and 100 * common >= percent * len(s)
            classes.append(c if linked else None)
            if not linked or c in seen:
                tokens.append(None), prefixes.append(None)
                continue
            seen.add(c)
            kept = s[hit]
            rare = kept[np.lexsort((kept, code[hit]))][: common + 1 + (-percent * len(s)) // 100]
            tokens.append(kept.view(np.int64)), prefixes.append(rare.view(np.int64))
        longs = pa.list_(pa.int64())
        return pa.table([table["id"], table["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(tokens, longs), pa.array(prefixes, longs)], names=schema.names)

    answered = by_block.applyInArrow(ask, ASKED).groupBy("range").applyInArrow(sketch.judge(frequency), ANSWERED)
    rows = materialize(by_block.cogroup(answered.groupBy("block")).applyInArrow(survive, schema), "shingles")
    some = rows.filter("class is not null")
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "text_hash"))
    key = F.element_at("prefix", -1)
    classes = materialize(some.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), least.alias("least"), F.first("n").alias("n"), F.first("prefix", True).alias("prefix")), "classes")
    per_key = materialize(classes.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("members")), "keys")
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / BLOCK_CLASSES))
    placed = classes.select("class", "prefix", key.alias("key")).join(per_key, "key").select("class", F.explode("prefix").alias("token"), F.xxhash64("key", salt).alias("block"))
    placed = materialize(placed, "blocks")
    spots = placed.groupBy("token", "block").agg(F.count(F.lit(1)).alias("m"))
    a, b = spots.select("token", F.col("block").alias("a"), F.col("m").alias("am")), spots.select("token", F.col("block").alias("b"), F.col("m").alias("bm"))
    block_pairs = materialize(a.join(b, "token").filter("a < b or a = b and am > 1").select("token", "a", "b"), "block-pairs")
    side = lambda c: block_pairs.join(placed.withColumnRenamed("block", c), ["token", c]).select("a", "b", "class", F.lit(c).alias("side"))
    members = side("a").unionByName(side("b")).distinct()
    sets = some.filter("tokens is not null").groupBy("class").agg(F.first("tokens").alias("tokens"))
    filled = members.join(classes.select("class", "n", "copies").join(sets, "class"), "class")

    def link(table: pa.Table) -> pa.Table:
        where = {"a": {}, "b": {}}
        names, n, copies, sets, index = [], [], [], [], {}
        for c, m, w, t, s in zip(table["class"].to_pylist(), table["n"].to_pylist(), table["copies"].to_pylist(), table["tokens"], table["side"].to_pylist(), strict=True):
            if c not in index:
                index[c] = len(names)
                names.append(c), n.append(m), copies.append(w)
                sets.append(t.values.to_numpy(zero_copy_only=False))
            where[s][index[c]] = True
        left, right = (np.array(sorted(where[s]), np.int64) for s in ("a", "b"))
        x, y = block_product(sets, np.array(n), left, right, percent)
        x, y = left[x], right[y]
        if table["a"][0] == table["b"][0]:
            x, y = x[x < y], y[x < y]
        weight = np.array(copies)
        degree = np.bincount(x, weight[y], len(names)) + np.bincount(y, weight[x], len(names))
        tree, linked = forest(x, y, len(names)), np.flatnonzero(degree)
        return pa.table({
            "x": pa.array([names[p] for p, _ in tree] + [names[p] for p in linked], pa.binary()),
            "y": pa.array([names[q] for _, q in tree] + [None] * len(linked), pa.binary()),
            "degree": pa.array([0] * len(tree) + degree[linked].astype(np.int64).tolist(), pa.int64()),
        })

    links = materialize(filled.groupBy("a", "b").applyInArrow(link, "x binary, y binary, degree long"), "links")
    roots = components(links.filter("y is not null").select("x", "y"))
    degrees = links.groupBy("x").agg(F.sum("degree").alias("degree")).withColumnRenamed("x", "class")
    known = classes.drop("prefix", "n").join(roots.withColumnRenamed("node", "class"), "class", "left").join(degrees, "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = materialize(known.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    known = known.join(firsts, "root").select("class", "first", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    there = some.select("id", "text_hash", "n", "class").join(materialize(known, "components"), "class")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    out = there.select("id", "n", F.col("first.id").alias("component_id"), "n_links", "text_hash", is_first.alias("is_first")).unionByName(
        rows.filter("class is null").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "text_hash", F.lit(True).alias("is_first"))
    )
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links", "text_hash", "is_first")


def keep_one(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns kept, with one of each component: that of the least id and text hash; of rows with
    equal id and text one stays.  The rows ride in a struct, so columns of any name are left as they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    gone = materialize(jaccard_components(documents, id_col, text_col, k, percent).filter("not is_first").select(F.xxhash64(id_col, "text_hash").alias("h1"), F.xxhash64("text_hash", id_col).alias("h2")).distinct(), "gone")
    keyed = documents.select(row.alias("doc"), F.xxhash64(id_col, text_hash).alias("h1"), F.xxhash64(text_hash, F.col(id_col)).alias("h2"))
    return keyed.join(gone, ["h1", "h2"], "left_anti").dropDuplicates(["h1", "h2"]).select("doc.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's set size and component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "is_first")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id, CAST((SELECT count(*) FROM l WHERE l.x = d.doc_id) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""
