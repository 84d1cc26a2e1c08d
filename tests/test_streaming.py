"""Streams: a store that follows listings, deduplication by id, usage appended by day."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import sync, usage
from corpusmill.streaming import sync as follow
from corpusmill.streaming.usage import event_files, once_each, store_by_day

SCHEMA = "source_path string, etag string, chunk_index int, chunk string"


def chunk(files):
    return files.select("collection", "source_path", "etag", F.posexplode(F.split("text", "/")).alias("chunk_index", "chunk"))


def put(folder, name, at, *rows):
    """A listing file: rows (collection, path, etag, text)."""
    lines = [json.dumps({"collection": c, "source_path": p, "etag": e, "size": 1, "listed_at": f"2024-01-01T00:00:{at:02d}Z", "text": t}) for c, p, e, t in rows]
    (folder / f"{name}.json").write_text("\n".join(lines))


def seen(spark, store):
    return sorted((r.collection, r.source_path, r.etag, r.chunk_index, r.chunk) for r in follow.current(spark, store, SCHEMA).collect())


def counts(spark, store, batch):
    return {r.collection: (r.n_rows, r.n_new, r.n_changed, r.n_skipped, r.n_deleted) for r in follow.log(spark, store).filter(F.col("batch") == batch).collect()}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def run(spark, place):
    stream = spark.readStream.schema(follow.LISTING).option("maxFilesPerTrigger", 10).json(str(place / "in"))
    follow.follow(stream, str(place / "store"), str(place / "checkpoint"), chunk, SCHEMA).awaitTermination()
    return seen(spark, str(place / "store"))


def test_store_follows_listings(spark, place):
    store = str(place / "store")
    put(place / "in", "1", 1, ("a b/c", "x", "1", "one/two"), ("a b/c", "y", "1", "three"), ("k", "z", "1", "four"))
    first = [("a b/c", "x", "1", 0, "one"), ("a b/c", "x", "1", 1, "two"), ("a b/c", "y", "1", 0, "three"), ("k", "z", "1", 0, "four")]
    assert run(spark, place) == first and counts(spark, store, 0) == {"a b/c": (3, 2, 0, 0, 0), "k": (1, 1, 0, 0, 0)}
    # two listings of one collection arrive together: the later one holds; x is changed to fewer chunks, y gone, w new; k isn't listed
    put(place / "in", "2", 2, ("a b/c", "v", "9", "never seen"))
    put(place / "in", "3", 3, ("a b/c", "x", "2", "ONE"), ("a b/c", "w", "1", "five"), ("a b/c", "w", "1", "five"))
    second = [("a b/c", "w", "1", 0, "five"), ("a b/c", "x", "2", 0, "ONE"), ("k", "z", "1", 0, "four")]
    assert run(spark, place) == second and counts(spark, store, 1) == {"a b/c": (2, 1, 1, 0, 1)}
    # the same listing again, and an empty one
    put(place / "in", "4", 4, ("a b/c", "x", "2", "ignored"), ("a b/c", "w", "1", "ignored"), ("k", None, None, None))
    third = second[:2]
    assert run(spark, place) == third and counts(spark, store, 2) == {"a b/c": (2, 0, 0, 2, 0), "k": (0, 0, 0, 0, 1)}
    assert run(spark, place) == third
    gone = follow.remove_superseded(spark, store)
    assert len(gone) == 3 and seen(spark, store) == third and follow.remove_superseded(spark, store) == []


def test_a_batch_run_again_changes_nothing(spark, place):
    store, at = str(place / "store"), dt.datetime(2024, 1, 1)
    listing = lambda *rows: spark.createDataFrame([(c, p, e, 1, at, t) for c, p, e, t in rows], follow.LISTING)
    one, two = listing(("a", "x", "1", "one"), ("a", "y", "1", "two")), listing(("a", "x", "2", "ONE"))
    follow.apply_listing(one, 0, store, chunk, SCHEMA)
    after_one = seen(spark, store)
    follow.apply_listing(one, 0, store, chunk, SCHEMA)
    assert seen(spark, store) == after_one

    def fails(files):
        return chunk(files).withColumn("chunk", F.raise_error(F.lit("broken")).cast("string"))

    with pytest.raises(Exception, match="broken"):
        follow.apply_listing(two, 1, store, fails, SCHEMA)
    assert seen(spark, store) == after_one
    follow.apply_listing(two, 1, store, chunk, SCHEMA)
    after_two = seen(spark, store)
    assert after_two == [("a", "x", "2", 0, "ONE")]
    follow.apply_listing(one, 0, store, chunk, SCHEMA)
    follow.apply_listing(two, 1, store, chunk, SCHEMA)
    assert seen(spark, store) == after_two


def test_each_id_once_within_the_watermark(spark, tmp_path):
    schema, at = "id string, created_at timestamp, x int", dt.datetime(2024, 1, 1, 12)
    for k, rows in enumerate([[("a", at, 1), ("a", at, 2), ("b", at, 3)], [("a", at + dt.timedelta(minutes=5), 4), ("c", at + dt.timedelta(hours=9), 5)], [("c", at + dt.timedelta(hours=9), 6), ("d", at + dt.timedelta(hours=9), 7)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = once_each(stream).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("once").collect()
    assert sorted(r.id for r in got) == ["a", "b", "c", "d"] and {r.x for r in got if r.id == "c"} <= {5, 6}


def test_usage_is_added_by_day(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1 + k % 3, 23), k) for k in range(9)]
    events = spark.createDataFrame(rows, "id int, created_at timestamp, n int")
    table = str(tmp_path / "usage")
    usage.append_by_day(events.filter("id < 5"), table)
    usage.append_by_day(events.filter("id >= 5"), table)
    stored = spark.read.parquet(table)
    recent = usage.trailing(stored, dt.datetime(2024, 1, 4), 1).filter(F.col("day") >= dt.date(2024, 1, 3))
    assert stored.count() == 9 and sorted(r.id for r in recent.collect()) == [2, 5, 8]
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().toString()
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        store_by_day(event_files(spark, str(tmp_path / "in"), "id int, created_at timestamp, n int"), str(tmp_path / "streamed"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "streamed")).groupBy("day").count().orderBy("day").collect()[0]["count"] == 3


def test_a_dropped_collection_leaves_no_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    sync.write_touched(spark.createDataFrame([("a/b c", 1), ("d", 2)], "collection string, x int"), path)
    assert sync.delete_collection(spark, path, "a/b c") and not sync.delete_collection(spark, path, "a/b c")
    assert [r.collection for r in spark.read.parquet(path).collect()] == ["d"] and len(list((tmp_path / "t").glob("collection=*"))) == 1
