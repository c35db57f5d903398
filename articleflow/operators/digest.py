"""Daily digest and summaries of snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.metadata import (
    merge_summaries,
    parse_metadata,
    pick_summary,
    summaries,
)
from articleflow.operators.entries import EntryQuery, scan_entries
from articleflow.operators.ordering import top_per_group
from articleflow.operators.sizing import attach

# Fixed value: entries shown besides the must-read ones.
OTHERS_SHOWN = 20


def chosen_summaries(snapshots: DataFrame) -> DataFrame:
    """Summary of every entry: the newest version that has one. Only the short text is shuffled."""
    picked = snapshots.select(
        "entry_id", "version", pick_summary(parse_metadata(F.col("metadata"))).alias("summary")
    ).where("summary IS NOT NULL")
    return picked.groupBy("entry_id").agg(F.max_by("summary", "version").alias("summary"))


def daily_digest(
    entries: DataFrame,
    config: DataFrame,
    snapshots: DataFrame,
    as_of: datetime,
    others: int | None = OTHERS_SHOWN,
) -> DataFrame:
    """Unread entries of the day: all of must-read feeds, the newest ``others`` of the rest."""
    q = EntryQuery(status="unread", time_filter="today")
    today = scan_entries(entries, q, as_of=as_of)
    must = config.where("priority = 1").select("feed_id", F.lit(True).alias("must_read"))
    today = attach(today, must, "feed_id").withColumn(
        "must_read", F.coalesce("must_read", F.lit(False))
    )
    order = [F.desc("published_at"), F.col("entry_id")]
    rest = today.where("NOT must_read").orderBy(*order)
    if others is not None:
        rest = rest.limit(others)
    shown = today.where("must_read").unionByName(rest)
    return (
        shown.join(chosen_summaries(snapshots), "entry_id", "left")
        .withColumn("summary", F.coalesce("summary", F.lit("")))
        .orderBy(F.desc("must_read"), *order)
    )


def store_summary(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots with generated summaries merged into the metadata of the summarised version.

    ``new``: entry_id, version, summaries map<string,string>. New texts win, other keys stay. Several
    new rows of one version are merged first; of two texts under one key the greater stays.
    """
    texts = new.select("entry_id", "version", F.explode_outer("summaries").alias("key", "text"))
    texts = texts.groupBy("entry_id", "version", "key").agg(F.max("text").alias("text"))
    pairs = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "text")))
    new = texts.groupBy("entry_id", "version").agg(F.map_from_entries(pairs).alias("summaries"))
    meta = parse_metadata(F.col("metadata"))
    joined = snapshots.join(
        new.select("entry_id", "version", F.col("summaries").alias("_new")),
        ["entry_id", "version"],
        "left",
    )
    merged = F.to_json(
        F.struct(
            meta["summary"].alias("summary"),
            merge_summaries(meta["summaries"], F.col("_new")).alias("summaries"),
        )
    )
    return joined.withColumn(
        "metadata", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("metadata"))
    ).drop("_new")


def summaries_of(snapshots: DataFrame, prompts: DataFrame) -> DataFrame:
    """Summaries of the newest versions, one row per prompt, with the prompt's name."""
    latest = top_per_group(
        snapshots.select("entry_id", "version", "metadata"), ["entry_id"], [F.desc("version")], 1
    )
    rows = latest.select(
        "entry_id", F.explode(summaries(parse_metadata(F.col("metadata")))).alias("prompt_id", "summary")
    )
    named = attach(rows, prompts.select(F.col("id").alias("prompt_id"), "name"), "prompt_id")
    return named.withColumn("name", F.coalesce("name", "prompt_id"))


def title_line(as_of: Column) -> Column:
    return F.date_format(as_of, "EEEE, MMMM dd, yyyy")
