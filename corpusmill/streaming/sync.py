"""A chunk store that follows a source by itself: each arriving listing is classified, upserted and pruned, once.

Layout of a store: `data/batch=<n>/collection=<c>` holds the rows that collection c has from batch n on, `log/batch=<n>`, written
last, says which collections that batch settled and with what counts.  A collection's rows are those of its newest batch
in the log.  So a batch that fails midway leaves no trace in what readers see, one that is run again writes the same, and
one that is in the log already isn't applied again, also after later ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import classify, status_counts

#: Columns of a listing; `listed_at` tells listings of a collection apart, the latest of a batch holds.
LISTING = "collection string, source_path string, etag string, size long, listed_at timestamp, text string"
STATUSES = ["new", "changed", "skipped", "deleted"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def log(spark: SparkSession, store: str) -> DataFrame:
    """batch, collection, n_rows and counts by status of every batch applied."""
    schema = "collection string, n_rows long, " + ", ".join(f"n_{s} long" for s in STATUSES) + ", total long, batch long"
    return spark.read.schema(schema).parquet(f"{store}/log") if _exists(spark, f"{store}/log") else spark.createDataFrame([], schema)


def current(spark: SparkSession, store: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows (schema, collection) of every collection as its newest batch left them; before: as it was ahead of that batch."""
    known = log(spark, store)
    known = known if before is None else known.filter(F.col("batch") < before)
    newest = known.groupBy("collection").agg(F.max_by(F.struct("batch", "n_rows"), "batch").alias("x")).select("collection", "x.batch", "x.n_rows").filter("n_rows > 0")
    names = f"{schema}, batch long, collection string"
    data = spark.read.schema(names).parquet(f"{store}/data") if _exists(spark, f"{store}/data") else spark.createDataFrame([], names)
    return data.join(newest.select("batch", "collection"), ["batch", "collection"], "left_semi").drop("batch")


def latest_listing(listings: DataFrame) -> DataFrame:
    """Each collection's latest listing; of rows for one path one stays.  A row without a path says that a listing is empty."""
    newest = listings.groupBy("collection").agg(F.max("listed_at").alias("listed_at"))
    there = listings.join(newest, ["collection", "listed_at"])
    return there.withColumn("__r", F.row_number().over(W.partitionBy("collection", "source_path").orderBy("etag", "size", "text"))).filter("__r = 1").drop("__r")


def apply_listing(listings: DataFrame, batch: int, store: str, chunk: Callable[[DataFrame], DataFrame], schema: str) -> None:
    """Bring the collections that a batch lists in step with it.

    chunk: from new and changed files (collection, source_path, etag, text) to rows of `schema` (which has source_path and
    etag) with collection.  Rows of unchanged files stay, those of changed and vanished files go.
    """
    spark = listings.sparkSession
    if _exists(spark, f"{store}/log/batch={batch}"):
        return
    listing = latest_listing(listings)
    stored = current(spark, store, schema, batch).join(listing.select("collection").distinct(), "collection", "left_semi")
    key = F.struct("collection", "source_path").alias("key")
    has = stored.select(key, "etag").distinct().select("key", "etag", F.lit(None).cast("long").alias("size"), F.col("key.source_path").alias("downloaded_path"), F.lit(True).alias("local_exists"))
    status = classify(listing.filter("source_path is not null").select(key, "etag", "size"), has).select("key.collection", "key.source_path", "status")
    named = ["collection", "source_path"]
    kept = stored.join(status.filter("status = 'skipped'"), named, "left_semi")
    files = listing.join(status.filter("status in ('new', 'changed')"), named, "left_semi").select("collection", "source_path", "etag", "text")
    columns = [*(c.split()[0] for c in schema.split(", ")), "collection"]
    rows = kept.select(columns).unionByName(chunk(files).select(columns))
    rows.write.mode("overwrite").partitionBy("collection").parquet(f"{store}/data/batch={batch}")
    made = spark.read.schema(f"{schema}, collection string").parquet(f"{store}/data/batch={batch}").groupBy("collection").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = listing.select("collection").distinct().join(status_counts(status, "collection", STATUSES), "collection", "left").join(made, "collection", "left").fillna(0)
    counts.select("collection", "n_rows", *(f"n_{s}" for s in STATUSES), "total").write.mode("overwrite").parquet(f"{store}/log/batch={batch}")


def follow(stream: DataFrame, store: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], schema: str, every: str | None = None) -> StreamingQuery:
    """Apply arriving listings to a store: at an interval, or once to all there are.

    Batches never overlap, missed ones are taken together, and one that fails is tried again when the query next starts.
    """
    writer = stream.writeStream.foreachBatch(lambda df, batch: apply_listing(df, batch, store, chunk, schema)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def remove_superseded(spark: SparkSession, store: str) -> list[str]:
    """Delete rows that no reader sees any more, emptied collections' included; returns the folders removed.

    One folder a collection and batch; only these names come to the driver.
    """
    known = log(spark, store)
    newest = known.groupBy("collection").agg(F.max("batch").alias("newest"))
    old = known.join(newest, "collection").filter("batch < newest or n_rows = 0").select("batch", "collection").collect()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    gone = []
    for r in old:
        path = jvm.org.apache.hadoop.fs.Path(f"{store}/data/batch={r.batch}/collection={escape(r.collection) if r.collection is not None else '__HIVE_DEFAULT_PARTITION__'}")
        if path.getFileSystem(conf).delete(path, True):
            gone.append(str(path))
    return gone
