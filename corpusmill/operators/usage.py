"""Usage metering: priced events and their breakdowns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import cost_usd

#: Bounds of the trailing window in days.
LEAST_DAYS, MOST_DAYS = 1, 365


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events with total_tokens and cost_usd (null without a price); model names match in any case.

    The price is fixed here, when events are written.  The price table is small; Spark broadcasts it by its size.
    """
    p = prices.select(F.lower("model").alias("__m"), "input_per_mtok", "output_per_mtok")
    out = events.join(p, F.lower("model") == F.col("__m"), "left").withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return out.withColumn("cost_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_mtok"), F.col("output_per_mtok"))).drop("__m", "input_per_mtok", "output_per_mtok")


def recordable(events: DataFrame) -> DataFrame:
    """Without chat events of no tokens; the mode is kept for chat only."""
    empty_chat = (F.col("kind") == "chat") & (F.col("total_tokens") == 0)
    return events.filter(~F.coalesce(empty_chat, F.lit(False))).withColumn("mode", F.when(F.col("kind") == "chat", F.col("mode")))


def append_by_day(events: DataFrame, path: str, ts: str = "created_at") -> None:
    """Add metered events to a table partitioned by day, so that trailing windows read their days only."""
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def trailing(events: DataFrame, as_of: dt.datetime, days: int, ts: str = "created_at") -> DataFrame:
    days = max(LEAST_DAYS, min(days, MOST_DAYS))
    since = as_of - dt.timedelta(days=days)
    return events.filter(F.col(ts) >= F.lit(since.isoformat(sep=" ")).cast(events.schema[ts].dataType))


def measures() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return [F.count_if(F.col("kind") == "chat").alias("requests"), *map(total, ("input_tokens", "output_tokens", "total_tokens")), F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(18,6)").alias("cost_usd")]


def labelled(events: DataFrame, users: DataFrame) -> DataFrame:
    """With the user's e-mail; the dimension has one row a user."""
    return events.join(users.select(F.col("cognito_sub").alias("user_sub"), "email"), "user_sub", "left")


def overview(events: DataFrame, users: DataFrame) -> DataFrame:
    """All four breakdowns in one scan by grouping sets: breakdown, label, measures."""
    e = labelled(events, users).withColumn("day", F.to_date("created_at"))
    grouped = e.groupingSets([[], ["user_sub", "email"], ["model"], ["day"]], "user_sub", "email", "model", "day").agg(F.grouping_id().alias("g"), *measures())
    kind = F.when(F.col("g") == 15, "total").when(F.col("g") == 3, "user").when(F.col("g") == 13, "model").otherwise("day")
    label = F.when(F.col("g") == 15, F.lit("all")).when(F.col("g") == 3, F.coalesce("email", "user_sub", F.lit("unknown"))).when(F.col("g") == 13, F.col("model")).otherwise(F.col("day").cast("string"))
    return grouped.select(kind.alias("breakdown"), label.alias("label"), *(c for c in ("requests", "input_tokens", "output_tokens", "total_tokens", "cost_usd")))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(*measures())


def by_user(events: DataFrame, users: DataFrame) -> DataFrame:
    """By user and e-mail, labelled afterwards, so two users of one address stay two rows."""
    return labelled(events, users).groupBy("user_sub", "email").agg(*measures()).select(F.coalesce("email", "user_sub", F.lit("unknown")).alias("label"), "*").drop("email").orderBy(F.desc("cost_usd"), "label", "user_sub")


def by_model(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("model").alias("label")).agg(*measures()).orderBy(F.desc("cost_usd"), "label")


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("created_at").alias("day")).agg(*measures()).orderBy("day")


def in_project(keys: DataFrame, projects: DataFrame, user: str) -> DataFrame:
    """Keys that lie below `projects/<id>/` of a project that the user owns."""
    owned = projects.filter(F.col("owner_sub") == user).select(F.concat(F.lit("projects/"), F.col("id").cast("string")).alias("__p")).distinct()
    return keys.withColumn("__p", F.regexp_extract("key", r"^(projects/[^/]+)/", 1)).join(owned, "__p", "left_semi").drop("__p")


def attribute_projects(events: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id only where the user owns that project."""
    owned = projects.select(F.col("id").alias("__p"), F.col("owner_sub").alias("__o"))
    out = events.join(owned, (F.col("project_id") == F.col("__p")) & (F.col("user_sub") == F.col("__o")), "left")
    return out.withColumn("project_id", F.col("__p")).drop("__p", "__o")
