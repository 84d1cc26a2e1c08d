"""Operator 11: near-duplicate documents by min-max hashing of word shingles.

1. One pass over the texts gives each document's shingle set, its 128-bit digest (documents with equal sets are one class
   from here on) and a signature: under each permutation both the least and the greatest value are kept, so half as
   many hashes are computed as by minima alone.  PAIRS permutations make a band; each band is one 64-bit key.
2. Classes that share a key are candidates.  Keys with the same classes are one bucket.  The least class of a bucket is its
   pivot; each other class is compared with it on full sets, in the JVM.
3. What is linked so far is joined to components.  A bucket whose other classes aren't all in one component goes on.  Classes whose
   buckets lead to the same least pivot are a family; families are cut into blocks of about BLOCK_CLASSES (from those of
   several blocks, classes that share too few shingles with all others together drop out).  The pairs of a block are
   compared on full sets by a product of incidence matrices, components are joined again, and then only classes outside
   their bucket's largest component are compared with the components that they share a bucket with.  So a large group of near copies, once joined, isn't compared pair by pair.

Every pair of classes with a key in common is thus compared or already joined; a linked pair has none in common with
probability of at most (1 - 0.85**6)**50, 6e-11.  Links are confirmed on full sets; shingles are compared by 64-bit hashes.

Defined results: null and empty texts, or such without words, have no shingles and are linked with nothing; fewer
words than a shingle form one shingle; long texts are taken whole; repeated rows are copies; null ids never name a component
unless all its ids are null; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import materialize, mix64, pieces, texts_of
from .jaccard import block_product, components, forest, sets_of, shingle_sets

SHINGLE = 3
PERCENT = 85
BANDS = 50
#: Permutations a band; each gives two values.
PAIRS = 3
BLOCK_CLASSES = 500
#: Fixed odd multipliers.
STEP, LOW, HIGH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def band_keys(sets: list[np.ndarray], bands: int = BANDS, pairs: int = PAIRS) -> np.ndarray:
    """(sets, bands): the key of each band of each set, none of which is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    odd = mix64(np.arange(1, bands * pairs + 1, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * pairs, (band + 1) * pairs):
            h = flat * odd[k]  # with the next two lines a permutation of all 64-bit numbers
            h ^= h >> np.uint64(32)
            h *= np.uint64(STEP)
            key = mix64(key + np.minimum.reduceat(h, starts) * np.uint64(LOW)) + np.maximum.reduceat(h, starts) * np.uint64(HIGH)
        out[:, band] = mix64(key)
    return out


def _alike(a: str, b: str, percent: int) -> str:
    """SQL: two sizes allow so high a similarity."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _families(spots: DataFrame) -> DataFrame:
    """class, home, members: classes whose buckets lead to the same least pivot are a family, home, of so many."""
    home = materialize(spots.groupBy("class").agg(F.min("pivot").alias("home")), "homes")
    return home.join(home.groupBy("home").agg(F.count(F.lit(1)).alias("members")), "home").select("class", "home", "members")


def _placed(families: DataFrame) -> DataFrame:
    """The block of each class: families are cut into blocks of about BLOCK_CLASSES."""
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / BLOCK_CLASSES))
    return families.select("class", F.xxhash64("home", salt).alias("block"))


def _inside_blocks(spots: DataFrame) -> DataFrame:
    """Groups for _multiply(): each block with itself."""
    blocks = spots.join(_placed(_families(spots)), "class")
    mixed = blocks.groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key", "block")
    found = blocks.join(mixed, ["key", "block"]).select(F.col("block").alias("a"), F.lit(0).alias("b"), "class").distinct()
    return found.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))


def _beside_the_main(spots: DataFrame) -> DataFrame:
    """Groups for _multiply(): classes outside their bucket's main component, in blocks, with all classes of the components that
    they share a bucket with, in parts."""
    mains = spots.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"))
    odd = materialize(spots.join(mains, "key").filter("comp != main").select("key", "class"), "odd")
    of_odd = materialize(_families(spots).drop("members").join(odd.select("class").distinct(), "class"), "families")
    blocks = materialize(_placed(of_odd.join(of_odd.groupBy("home").agg(F.count(F.lit(1)).alias("members")), "home")), "blocks")
    near = odd.join(blocks, "class").select(F.col("block").alias("a"), "key").distinct().join(spots.select("key", "comp").distinct(), "key").select("a", "comp").distinct()
    others = materialize(near.join(spots.select("class", "comp").distinct(), "comp").select("a", "class"), "others")
    parts = others.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("parts"))
    right = others.join(parts, "a").select("a", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("b"), "class", F.lit("b").alias("side"))
    left = blocks.withColumnRenamed("block", "a").join(parts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"), "class", F.lit("a").alias("side"))
    return left.unionByName(right)


def _multiply(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between the two sides of each group; groups: a, b, class, side."""

    def link(table: pa.Table) -> pa.Table:
        names, index, sets, rows = [], {}, [], {"a": [], "b": []}
        for c, t, s in zip(table["class"].to_pylist(), table["tokens"], table["side"].to_pylist(), strict=True):
            if c not in index:
                index[c] = len(names)
                names.append(c), sets.append(t.values.to_numpy(zero_copy_only=False))
            rows[s].append(index[c])
        left, right = (np.array(sorted(rows[s]), np.int64) for s in "ab")
        x, y = block_product(sets, np.array([len(s) for s in sets]), left, right, percent) if len(left) and len(right) else (left[:0], left[:0])
        tree = forest(left[x], right[y], len(names))
        return pa.table({"x": pa.array([names[p] for p, _ in tree], pa.binary()), "y": pa.array([names[q] for _, q in tree], pa.binary())})

    return materialize(groups.join(sets, "class").groupBy("a", "b").applyInArrow(link, "x binary, y binary"), "links")


def _may_link(spots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Without the classes of families of several blocks that share too few shingles with all other classes of their buckets."""
    large = _families(spots).filter(F.col("members") > BLOCK_CLASSES).select("class")
    keys = spots.join(large, "class").select("key").distinct()
    some = sets.join(spots.join(keys, "key").select("class").distinct(), "class").withColumn("short", F.xxhash64("class"))
    alone = some.select("short", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("short").alias("short")).filter("m = 1").groupBy("short").agg(F.count(F.lit(1)).alias("alone"))
    n = F.size("tokens")
    never = some.join(large, "class", "left_semi").join(alone, "short").filter(100 * (n - F.col("alone")) < percent * n).select("class")
    return spots.join(never, "class", "left_anti")


def _mixed(spots: DataFrame) -> DataFrame:
    """Of the spots, those in buckets with more than one component."""
    keys = spots.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    return materialize(spots.join(keys, "key"), "open")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, kept (the id is its component's), text_hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = T.StructType([
        docs.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every document with its class; the first of a class in the task brings the keys."""
        seen: set[bytes] = set()
        for b in pieces(batches):
            sets, names = sets_of(pa.Table.from_batches([b]), k)
            new = [i for i, c in enumerate(names) if c is not None and not (c in seen or seen.add(c))]
            bands: list = [None] * len(sets)
            if new:
                for i, row in zip(new, band_keys([sets[i] for i in new]).view(np.int64), strict=True):
                    bands[i] = row
            columns = [b["id"], b["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = materialize(docs.mapInArrow(sign, schema), "signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "text_hash")).alias("least")
    classes = materialize(rows.filter("class is not null").groupBy("class").agg(least, F.first("n").alias("n"), F.first("bands", True).alias("bands")), "classes")

    spots = classes.select("class", "n", F.explode("bands").alias("key"))
    in_key = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("class")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("h2"), F.min(F.struct("class", "n")).alias("pivot")]
    buckets = spots.groupBy("key").agg(*in_key).filter("m > 1").groupBy("m", "h1", "h2").agg(F.min("key").alias("key"), F.first("pivot").alias("pivot"))
    members = materialize(spots.join(materialize(buckets.select("key", "pivot"), "buckets"), "key"), "members")

    #: The sets of all classes in buckets, from the text of each one's first document.
    whose = lambda id_, hash_: [F.xxhash64(id_, hash_).alias("h1"), F.xxhash64(hash_, id_).alias("h2")]
    wanted = members.select("class").distinct().join(classes, "class").select("class", *whose("least.id", "least.text_hash"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in pieces(batches):
            names = b["class"].to_pylist()
            b = b.take(pa.array([i for i, c in enumerate(names) if not (c in seen or seen.add(c))], pa.int64()))
            tokens = [s.view(np.int64) for s in shingle_sets(texts_of(b["text"]), k)]
            yield pa.RecordBatch.from_arrays([b["class"], pa.array(tokens, pa.list_(pa.int64()))], ["class", "tokens"])

    found = docs.select("text", *whose("id", "text_hash")).join(wanted, ["h1", "h2"]).select("class", "text").mapInArrow(shingle, "class binary, tokens array<long>")
    sets = materialize(found.groupBy("class").agg(F.first("tokens").alias("tokens")), "sets")

    pairs = members.filter("class != pivot.class").select(F.col("pivot.class").alias("x"), F.col("pivot.n").alias("xn"), F.col("class").alias("y"), F.col("n").alias("yn")).distinct()
    both = pairs.filter(_alike("xn", "yn", percent)).join(sets.select(F.col("class").alias("y"), F.col("tokens").alias("ys")), "y").join(sets.select(F.col("class").alias("x"), F.col("tokens").alias("xs")), "x")
    common = F.size(F.array_intersect("xs", "ys"))
    links = materialize(both.filter(100 * common >= percent * (F.col("xn") + F.col("yn") - common)).select("x", "y"), "links")
    comp_of = members.select("class").distinct().withColumn("comp", F.col("class"))

    def joined(comp_of: DataFrame, links: DataFrame) -> DataFrame:
        """class, comp with the components that links connect made one."""
        of = lambda c: comp_of.select(F.col("class").alias(c), F.col("comp").alias(f"{c}c"))
        roots = components(links.join(of("x"), "x").join(of("y"), "y").select(F.col("xc").alias("x"), F.col("yc").alias("y")))
        return materialize(comp_of.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("class", F.coalesce("root", "comp").alias("comp")), "components")

    comp_of = joined(comp_of, links)
    #: What the pivots leave: the other classes of buckets in which such are in different components.
    spots = _mixed(members.filter("class != pivot.class").select("key", "class", F.col("pivot.class").alias("pivot")).join(comp_of, "class"))
    if not spots.isEmpty():
        spots = _mixed(_may_link(spots, sets, percent))
    for groups in (_inside_blocks, _beside_the_main):
        if spots.isEmpty():
            break
        more = _multiply(groups(spots), sets, percent)
        if not more.isEmpty():
            comp_of = joined(comp_of, more)
            spots = _mixed(spots.drop("comp").join(comp_of, "class"))

    known = classes.select("class", "least").join(comp_of.withColumnRenamed("comp", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    firsts = materialize(known.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    known = materialize(known.join(firsts, "root").select("class", F.col("first.id").alias("component_id")), "components")
    keep = ["id", "n", "component_id", "text_hash"]
    out = rows.filter("class is not null").join(known, "class").select(keep).unionByName(rows.filter("class is null").withColumn("component_id", F.col("id")).select(keep))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's set size and component, and whether it stays."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.x
"""
