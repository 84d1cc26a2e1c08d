"""Operator 9: mixing sources to target weights by a time-varying curriculum.  DataFrame functions only.

Targets: all sources share the words of the whole corpus by weight; a source stops at three times its own words
and the rest shares what is left (water filling, solved in closed form by running sums over the sources in ranges).

Which documents: those of a source stand in a hashed order; laid end to end and repeated, the cumulative token
demand of the source takes each that ends within its target, and one more whose size is nearest to the rest, so
only whole documents are taken, the sum is near the target, and no document is taken more than three times.
Running sums are made in two levels, over hash buckets and inside them, so that no task holds a whole source.

When: source s asks for words at the rate g(t) = 1 + tilt * (2t - 1) of training time t in [0, 1]; tilt is
drawn from its weight, so heavy sources rise and light ones fall.  Its integral G(t) = t + tilt * (t*t - t) is
inverted at the copy's share of the source's demand, which gives the training position, and documents are
range-sorted by position.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its
own, last in order; equal rows may be taken a different number of times, by the same rule in every run; empty
tables work; extra columns are kept by mix() and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import count_words, materialize, row_keys

#: The repeating weights, and how often a source may be seen.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
STEEPEST = 0.5
BUCKET_ROWS = 1_000
SEED = 7


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, size): source, source_size, n, weight, target, tilt.  One row for each source.

    Sources are numbered and summed in ranges, so no task holds all of them: their places and the sums before them
    are made of one row for each range (a bounded number) and a window inside it.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = running(s, ["source"], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    s = s.withColumn("weight", weight).withColumn("cap", MOST_REPEATS * F.col("source_size").cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = materialize(running(s, ["ratio", "source"], {"caps_before": F.col("cap"), "weight_before": F.col("weight")}), "mix-levels")
    total, weights, mean = s.agg(F.sum("source_size").cast("double"), F.sum("weight"), F.avg("weight")).head()
    # the level if exactly the sources before this one stop at their caps; the first that isn't above its own cap holds
    s = s.withColumn("level", (F.lit(total) - F.col("caps_before")) / (F.lit(weights) - F.col("weight_before")))
    held = s.agg(F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("ratio", (-F.col("level")).alias("minus"))))["minus"]).head()[0]  # of equal ratios the first has the largest level
    s = s.withColumn("target", F.least("cap", F.lit(-held if held else 0.0) * F.col("weight")))
    tilt = F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), (F.col("weight") - F.lit(mean)) / F.lit(float(max(WEIGHTS)))))
    return s.select("source", "source_size", "n", "weight", "target", tilt.alias("tilt"))


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before this one in that order (nulls last)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = materialize(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    each = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"__{k}") for k, v in sums.items()))
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    each = each.select("__part", *(F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in sums))  # one row for each range
    inside = W.partitionBy("__part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    out = out.join(F.broadcast(each), "__part")
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", *(f"__{k}" for k in sums))


def order_hash(doc_id: Column, text_hash: Column) -> Column:
    """A number below 2**60 that puts the documents of a source in a random but repeatable order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), doc_id.cast("string"), text_hash).cast("binary")), 1, 15), 16, 10).cast("long")


def invert_demand(share: Column, tilt: Column) -> Column:
    """t with t + tilt * (t*t - t) = share."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(2 * share / (1 - tilt + root))


def plan_mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: list[Column] | None = None) -> DataFrame:
    """One row for each document: key (id, text_hash, k1, k2), size, source, source_size, target, copies, taken, start, tilt.

    start: words of the source before the document in its order; the k-th copy begins at start + k * source_size.
    """
    keys = keys or [F.lit(0).cast("long").alias(c) for c in ("k1", "k2")]
    narrow = documents.select(*keys, F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_hash"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"))
    narrow = materialize(narrow.withColumn("h", order_hash(F.col("id"), F.col("text_hash"))), "mix-sizes")
    sources = materialize(source_targets(narrow), "mix-sources")
    # rows of about BUCKET_ROWS each, whatever the source; the bucket is a prefix of the hash, so buckets keep its order
    bucket = F.floor(F.col("h") / float(2**60) * F.ceil(F.col("n") / BUCKET_ROWS))
    rows = narrow.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "n", "target", "tilt").withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    inner = W.partitionBy("source", "bucket").orderBy("h", "id", "text_hash", "k1", "k2").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb"))).withColumn("start", F.col("ahead") + F.col("inside"))
    # copies that end within the target: passes k with start + size + k * source_size <= target
    whole = F.floor((F.col("target") - F.col("start") - F.col("size")) / F.col("source_size")) + 1
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(MOST_REPEATS), whole))).otherwise(0).cast("int")
    placed = materialize(placed.withColumn("copies", copies).drop("ahead", "inside", "bs", "bb", "bucket", "n"), "mix-places")
    # one more document of each source: the one nearest to what is still missing, if that brings the sum nearer
    got = placed.groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("got")).select(F.col("source").alias("gs"), (F.col("t") - F.col("got")).alias("missing"))
    left = placed.filter((F.col("copies") < MOST_REPEATS) & (F.col("size") > 0)).join(got, F.col("source").eqNullSafe(F.col("gs")))
    off = F.abs(F.col("missing") - F.col("size"))
    last = left.filter(off < F.col("missing")).groupBy("gs").agg(F.min(F.struct(off.alias("off"), "copies", "h", "id", "text_hash", "k1", "k2", "start")).alias("last"))
    last = last.select(F.col("gs").alias("ls"), *(F.col(f"last.{c}").alias(f"l_{c}") for c in ("h", "id", "text_hash", "start")))
    chosen = F.col("l_h").isNotNull()
    same = F.col("source").eqNullSafe(F.col("ls")) & (F.col("h") == F.col("l_h")) & F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_text_hash")) & (F.col("start") == F.col("l_start"))
    out = placed.join(last, same, "left").withColumn("copies", F.col("copies") + F.when(chosen, 1).otherwise(0))
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop("h", "ls", "l_h", "l_id", "l_text_hash", "l_start")


def positions(plan: DataFrame) -> DataFrame:
    """Each copy of each taken document with its training position in [0, 1]."""
    copy = plan.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    middle = F.col("start") + F.col("copy") * F.col("source_size") + F.col("size") / 2
    share = F.least(F.lit(1.0), middle / F.col("target"))
    return copy.withColumn("position", invert_demand(share, F.col("tilt")))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training stream: documents, all columns kept, once for each copy taken, range-sorted by position.

    Rows ride in a struct, so columns of any name are left as they are.  Rows equal in all columns are alike: one stands
    for all, and the places of each are joined to it.
    """
    keys = row_keys(documents)
    plan = positions(plan_mix(documents, id_col, text_col, source_col, keys)).select("k1", "k2", "position")
    docs = documents.select(*keys, F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc")).dropDuplicates(["k1", "k2"])
    stream = materialize(plan, "mix-positions").join(docs, ["k1", "k2"])
    return stream.repartitionByRange("position", "k1", "k2").sortWithinPartitions("position", "k1", "k2").select("doc.*")


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: how much of every document the mix takes, and when it is first seen (null: never)."""
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.when(F.col("copies") > 0, invert_demand(F.least(F.lit(1.0), (F.col("start") + F.col("size") / 2) / F.col("target")), F.col("tilt")))
    out = plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round(first, 9).alias("first_position"))
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS x, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', '7', CAST(doc_id AS VARCHAR), x)), 1, 15) AS BIGINT) AS h FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
k AS (SELECT (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level DESC LIMIT 1) AS held),
t AS (SELECT source, source_size, least(cap, coalesce(held, 0) * weight) AS target, greatest(-0.5, least(0.5, (weight - avg(weight) OVER ()) / 5.0)) AS tilt FROM l, k),
p AS (SELECT h.*, source_size, target, tilt, coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY h, doc_id, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(3, CAST(floor((target - start - size) / source_size) + 1 AS INTEGER))) ELSE 0 END AS copies FROM p),
m AS (SELECT source AS ms, max(target) - sum(size * copies) AS missing FROM c GROUP BY source),
r AS (SELECT doc_id, start, source, row_number() OVER (PARTITION BY source ORDER BY abs(missing - size), copies, h, doc_id, x, start) AS rk
      FROM c JOIN m ON source IS NOT DISTINCT FROM ms WHERE copies < 3 AND size > 0 AND abs(missing - size) < missing),
f AS (SELECT c.*, copies + CASE WHEN r.rk IS NULL THEN 0 ELSE 1 END AS n FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND c.start = r.start AND c.source IS NOT DISTINCT FROM r.source AND r.rk = 1),
q AS (SELECT *, least(1.0, (start + size / 2.0::DOUBLE) / target) AS share FROM f)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken,
  CASE WHEN n > 0 THEN round(CASE WHEN abs(tilt) < 1e-9 THEN share ELSE 2 * share / (1 - tilt + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)) END, 9) END AS first_position
FROM q
"""
