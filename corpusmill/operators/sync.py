"""Keeping a table in step with a changing source: diff, skip, upsert, prune, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def classify(listing: DataFrame, prior: DataFrame) -> DataFrame:
    """key, status, etag, size of the full outer join of a listing and the last manifest.

    skipped: same tag and the local copy is there (carries the prior record); new, changed: to fetch;
    deleted: gone from the source and once downloaded; ignored: gone and never downloaded.
    listing(key, etag, size), prior(key, etag, size, downloaded_path, local_exists).
    """
    n, p = listing.alias("n"), prior.alias("p")
    same = F.col("n.etag").eqNullSafe(F.col("p.etag")) & F.coalesce(F.col("p.local_exists"), F.lit(False))
    status = (
        F.when(F.col("n.key").isNull(), F.when(F.coalesce(F.col("p.downloaded_path"), F.lit("")) != "", "deleted").otherwise("ignored"))
        .when(F.col("p.key").isNull(), "new").when(same, "skipped").otherwise("changed")
    )
    pick = lambda c: F.when(status == "skipped", F.col(f"p.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"p.{c}"))).alias(c)
    return n.join(p, F.col("n.key") == F.col("p.key"), "full_outer").select(F.coalesce("n.key", "p.key").alias("key"), status.alias("status"), pick("etag"), pick("size"))


def status_counts(records: DataFrame, kind: str, statuses: list[str]) -> DataFrame:
    """kind by status, with a total."""
    return records.groupBy(kind).agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses), F.count(F.lit(1)).alias("total"))


def unconverted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content the last manifest doesn't hold with its output still there; equal new files all stay."""
    return files.join(manifest.filter("output_exists").select("sha256"), "sha256", "left_anti")


def orphans(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return manifest.join(files.select(key), key, "left_anti")


def stale_paths(stored: DataFrame, existing: DataFrame, key: str = "source_path") -> DataFrame:
    return stored.select(key).distinct().join(existing.select(key), key, "left_anti")


def prune(stored: DataFrame, stale: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(stale.select(*keys).distinct(), keys, "left_anti")


def resume(targets: DataFrame, done: DataFrame, key: str = "slug") -> DataFrame:
    """Targets with status `skipped` where they are done already, else `todo`."""
    known = done.select(F.col(key).alias("__k")).distinct()
    return targets.join(known, F.col(key) == F.col("__k"), "left").withColumn("status", F.when(F.col("__k").isNotNull(), "skipped").otherwise("todo")).drop("__k")


def section_status(sections: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Skip what exists, then fail what is empty, else write."""
    known = existing.select(F.col("slug").alias("__k")).distinct()
    skip = F.lit(False) if force else F.col("__k").isNotNull()
    status = F.when(skip, "skipped").when(F.trim(F.coalesce("body", F.lit(""))) == "", "failed").otherwise("written")
    return sections.join(known, F.col("slug") == F.col("__k"), "left").withColumn("status", status).drop("__k")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: Column | str, *ties: str) -> DataFrame:
    """The latest row of each key of both tables."""
    order = [F.col(version).desc() if isinstance(version, str) else version.desc(), *(F.col(t).desc() for t in ties)]
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def replace_sources(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of re-chunked files replaced, so none of a changed file stays behind."""
    keys = ["collection", "source_path"]
    return prune(stored, new, keys).unionByName(new, allowMissingColumns=True)


def write_touched(df: DataFrame, path: str, partition: str = "collection") -> None:
    """Overwrite only the partitions that df holds; write to a path other than the one df reads."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def drop_collection(stored: DataFrame, collection: str) -> DataFrame:
    """All but one collection."""
    return stored.filter(~F.col("collection").eqNullSafe(F.lit(collection)))


def delete_collection(spark: SparkSession, path: str, collection: str, partition: str = "collection") -> bool:
    """Remove a collection's partition from a table that is partitioned by it; False if there was none."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(collection)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def matched_rows(stored: DataFrame, stale: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows prune() takes away, by the first key."""
    return stored.join(stale.select(*keys).distinct(), keys, "left_semi").groupBy(keys[0]).agg(F.count(F.lit(1)).alias("deleted"))


def manifest_documents(records: DataFrame, key: str, kind: str, statuses: list[str]) -> DataFrame:
    """One JSON document a key: the counts of each kind by status, with a total."""
    counted = status_counts(records.withColumn("__kk", F.struct(key, kind)), "__kk", statuses).select(F.col(f"__kk.{key}").alias(key), F.col(f"__kk.{kind}").alias("kind"), *(F.col(f"n_{s}").alias(s) for s in statuses), "total")
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", F.struct(*statuses, "total").alias("n")))))  # a key has few kinds
    return counted.groupBy(key).agg(counts.alias("counts")).select(key, F.to_json(F.struct(F.col(key), "counts")).alias("manifest"))


def latest_states(states: DataFrame, key: str, at: str) -> DataFrame:
    """The last state of each key; what fails to parse has none.  append_state() adds one."""
    return states.groupBy(key).agg(F.max_by(F.struct(*(c for c in states.columns if c != key)), F.col(at)).alias("s")).select(key, "s.*")


def append_state(done: DataFrame, path: str, dry_run: bool = False) -> None:
    """A state for each case ingested, once; none on a dry run."""
    if not dry_run:
        done.write.mode("append").parquet(path)


def upsert_users(old: DataFrame, seen: DataFrame, admins: DataFrame) -> DataFrame:
    """Earliest creation, latest everything else; the flag follows the allow-list at each sight."""
    both = old.select("sub", "email", "created_at", "last_seen_at").unionByName(seen.select("sub", "email", F.col("seen_at").alias("created_at"), F.col("seen_at").alias("last_seen_at")))
    users = both.groupBy("sub").agg(F.max_by("email", "last_seen_at").alias("email"), F.min("created_at").alias("created_at"), F.max("last_seen_at").alias("last_seen_at"))
    listed = admins.select(F.lower(F.trim("email")).alias("__a")).distinct()
    return users.join(listed, F.lower(F.trim("email")) == F.col("__a"), "left").withColumn("is_admin", F.col("__a").isNotNull()).drop("__a")


def needs_ingest(cases: DataFrame, state: DataFrame, refresh: bool = False, dry_run: bool = False) -> DataFrame:
    """Cases whose fingerprint, collection, profile, source or id differ from the state; all on refresh or a dry run."""
    if refresh or dry_run:
        return cases
    keys = ["source", "id", "profile", "collection", "text_fingerprint"]
    s = state.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cases.join(s, condition, "left_anti")


def flatten_docket(docket: DataFrame, *order: str) -> DataFrame:
    """crn, href, downloaded_path and place (entry, document, attachment; a document stands before its attachments) of the
    documents and attachments of nested docket entries.  A case's entries may come in several rows; order then names the
    columns that place these, and begins the place."""
    docs = docket.select("crn", *order, F.posexplode("docket_entries").alias("e", "entry")).select("crn", *order, "e", F.posexplode("entry.documents").alias("d", "doc"))
    one = docs.select("crn", "doc.href", "doc.downloaded_path", F.struct(*order, "e", "d", F.lit(-1).alias("a")).alias("place"))
    two = docs.select("crn", *order, "e", "d", F.posexplode("doc.attachments").alias("a", "att")).select("crn", "att.href", "att.downloaded_path", F.struct(*order, "e", "d", "a").alias("place"))
    return one.unionByName(two).filter("href is not null")


def previous_downloads(links: DataFrame, docket: DataFrame, *order: str) -> DataFrame:
    """Links (crn, href) with the path that the same case's earlier manifest has for their href; of several places with a
    path the last one wins."""
    known = flatten_docket(docket, *order).filter(F.coalesce("downloaded_path", F.lit("")) != "").groupBy("crn", "href").agg(F.max_by("downloaded_path", "place").alias("downloaded_path"))
    return links.join(known, ["crn", "href"], "left")


def docket_order(docket: DataFrame) -> DataFrame:
    """Entries with their place in the docket, from 1."""
    return docket.select("crn", F.posexplode("docket_entries").alias("__p", "entry")).select("crn", (F.col("__p") + 1).alias("order"), "entry.*")


def newest_first(rows: DataFrame, at: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(at), *ties)


def section_records(sections: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """section_status() with the record of each section: cleaned citation and title, and the document to write."""
    from ..functions.exprs import clean_meta_value, front_matter_document

    out = section_status(sections, existing, force).withColumns({c: clean_meta_value(F.col(c)) for c in ("citation", "title")})
    fields = {c: F.col(c) for c in ("citation", "title", "section", "jurisdiction", "source_url") if c in out.columns}
    return out.withColumn("document", F.when(F.col("status") == "written", front_matter_document(fields, F.col("body"))))
