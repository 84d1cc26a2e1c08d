"""A training-data pipeline of five stages over `documents`: quality, near duplicates, contamination, mixing, shards.

Each stage is written as Parquet in the shared folder and read again as the next one's documents, so a lost
executor costs the stage that runs.  Classified as part of the subpackage corpusmill.llm.

A stage's working tables are needed until its result is written; the stage after it, which reads that result, removes
them.  So whoever calls the functions of STAGES writes a stage's result before calling the next, as run() does.

All stages: an empty table gives an empty table with the same columns, and columns of any name are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import delete_tables, recorded, write_table
from corpusmill.llm.contamination import decontaminate
from corpusmill.llm.jaccard import keep_one
from corpusmill.llm.mixture import mix
from corpusmill.llm.quality import filter_quality
from corpusmill.llm.sharding import shard

#: Working tables of the last call of a stage, by the stage's name.
_TABLES: dict[str, list[str]] = {}


def _stage(name: str, after: str | None, spark: SparkSession, work: Callable[[], DataFrame], keeps: bool = False) -> DataFrame:
    if after:
        delete_tables(spark, _TABLES.pop(after, []))
    with recorded() as made:
        out = work()
    if not keeps:
        _TABLES[name] = made
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps.

    Null and empty texts have no words, fail the base rule and go; long texts are judged whole; equal rows are
    judged alike; nulls in other columns don't matter.
    """
    return _stage("quality_rules", None, spark, lambda: filter_quality(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that of least id.

    Documents without words are nobody's copies, and each stays; of equal rows (id and text) one stays; null ids come
    after all others; among equal ids the text of least hash stays; long texts are compared whole.
    """
    return _stage("near_duplicates", "quality_rules", spark, lambda: keep_one(docs, k=5, percent=80))


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark.

    Null and empty texts are clean; null items and items without words have no windows; an empty benchmark leaves all;
    long texts are searched whole; equal rows are judged alike.
    """
    return _stage("benchmark_contamination", "near_duplicates", spark, lambda: decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: each document as often as the mix takes it, in the order of training.

    Documents without words are never taken; a null source is a source of its own; of equal rows each is taken by
    the rule for its place, rows that differ in other columns included; reruns agree.
    """
    return _stage("source_mix", "benchmark_contamination", spark, lambda: mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the stream.

    Null ids come first in the numbering, null texts count as empty; equal rows share out their places between them.
    """
    return _stage("shards", "source_mix", spark, lambda: shard(docs), keeps=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_contamination", benchmark_contamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Model fitting by expectation-maximisation can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            delete_tables(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
