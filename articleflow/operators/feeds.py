"""Feed overview, health, categories, settings and address history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions import feedtext as ft
from articleflow.functions.text import (
    author_slug,
    author_title,
    seconds_between,
    text_or_empty,
)
from articleflow.operators.entries import DEFAULT_PRIORITY, unread_per_feed
from articleflow.operators.sizing import attach
from articleflow.session import cut_lineage


def overview(feeds: DataFrame, config: DataFrame, entries: DataFrame) -> DataFrame:
    """Feeds with settings, unread count and latest entry, must-read feeds first.

    Both entry measures come from one aggregation; all joins are between tables with one row per
    feed, so Spark's own size-based choice of join is right.
    """
    measures = entries.groupBy("feed_id").agg(
        F.count_if(F.col("status") == "unread").alias("unread"),
        F.max("published_at").alias("latest"),
    )
    settings = config.select("feed_id", "fetch_full_content", "priority")
    return (
        feeds.join(settings, "feed_id", "left")
        .join(measures, "feed_id", "left")
        .withColumns(
            {
                "fetch_full_content": F.coalesce("fetch_full_content", F.lit(False)),
                "priority": F.coalesce("priority", F.lit(DEFAULT_PRIORITY)),
                "unread": F.coalesce("unread", F.lit(0)),
            }
        )
        .orderBy("priority", F.desc_nulls_last("latest"), "feed_id")
    )


def search_feeds(feeds: DataFrame, text: str) -> DataFrame:
    """Feeds whose row text holds the query, ignoring case."""
    row = F.concat_ws(" ", "title", "feed_url", "site_url")
    return feeds.where(F.contains(F.lower(row), F.lit(text.lower())))


def category_rollup(categories: DataFrame, feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Unread sum and number of feeds per category, empty categories included."""
    per_feed = feeds.select("feed_id", "category_id").join(
        unread_per_feed(entries), "feed_id", "left"
    )
    sums = per_feed.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("feeds"), F.sum(F.coalesce("unread", F.lit(0))).alias("unread")
    )
    return categories.join(sums, "category_id", "left").select(
        "category_id",
        "title",
        F.coalesce("feeds", F.lit(0)).alias("feeds"),
        F.coalesce("unread", F.lit(0)).alias("unread"),
    )


def category_feeds(categories: DataFrame, feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per category and feed with its unread count; empty categories have a null feed."""
    per_feed = feeds.select("feed_id", "category_id", F.col("title").alias("feed_title")).join(
        unread_per_feed(entries), "feed_id", "left"
    )
    return (
        categories.join(per_feed, "category_id", "left")
        .withColumn("unread", F.coalesce("unread", F.lit(0)))
        .orderBy("category_id", F.lower("feed_title"), "feed_id")
    )


def with_health(feeds: DataFrame, as_of: Column) -> DataFrame:
    """Health flags and bucket of every feed; a projection."""
    checked = F.col("checked_at")
    if dict(feeds.dtypes)["checked_at"] == "string":
        checked = F.try_to_timestamp(checked)
    message = text_or_empty(F.col("parsing_error_message"))
    flags = feeds.withColumns(
        {
            "checked_ago": seconds_between(as_of, checked),
            "error_count": F.coalesce("parsing_error_count", F.lit(0)),
            "has_error": message != "",
            "is_paused": F.coalesce("disabled", F.lit(False)),
        }
    )
    stale = F.coalesce(F.col("checked_ago") > ft.STALE_SECONDS, F.lit(False))
    flags = flags.withColumns(
        {"is_persistent": F.col("error_count") >= ft.PERSISTENT_ERRORS, "is_stale": stale}
    )
    bucket = (
        F.when(F.col("is_paused"), "paused")
        .when(F.col("has_error"), ft.error_bucket(F.col("parsing_error_message")))
        .when(F.col("is_stale"), "stale")
        .otherwise("ok")
    )
    return flags.withColumn("bucket", bucket)


def health_sections(feeds: DataFrame, as_of: Column) -> DataFrame:
    """Feeds in their bucket: most severe bucket first, by title within; one row per feed.

    The size of a bucket is joined from at most thirteen rows, so no bucket is gathered anywhere.
    """
    marked = with_health(feeds, as_of)
    sizes = marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("bucket_size"))
    return (
        marked.join(F.broadcast(sizes), "bucket")
        .withColumns(
            {
                "bucket_rank": ft.bucket_rank(F.col("bucket")),
                "label": ft.bucket_label(F.col("bucket")),
                "remedy": ft.bucket_action(F.col("bucket")),
            }
        )
        .orderBy("bucket_rank", F.lower(text_or_empty(F.col("title"))), "feed_id")
    )


def health_summary(feeds: DataFrame, as_of: Column) -> DataFrame:
    """Persistent, transient and stale feeds, each counted once, paused ones left out."""
    active = with_health(feeds, as_of).where(~F.col("is_paused"))
    persistent, error, stale = F.col("is_persistent"), F.col("has_error"), F.col("is_stale")
    return active.agg(
        F.count_if(persistent).alias("persistent"),
        F.count_if(~persistent & error).alias("transient"),
        F.count_if(~persistent & ~error & stale).alias("stale"),
    )


def icons_of(feed_icons: DataFrame, icons: DataFrame) -> DataFrame:
    joined = feed_icons.join(icons, feed_icons["icon_id"] == icons["id"])
    return joined.select("feed_id", "content", "mime_type")


def url_history(history: DataFrame) -> DataFrame:
    """Address changes of each feed, newest first."""
    return history.orderBy("feed_id", F.desc("changed_at"), "old_url")


def feed_settings(
    feeds: DataFrame, config: DataFrame, history: DataFrame, as_of: Column
) -> DataFrame:
    """Settings and health of every feed, one row per known address change (one row if none)."""
    settings = config.select(
        "feed_id", *[c for c in ("fetch_full_content", "priority", "extract_rules") if c in config.columns]
    )
    changes = history.select(
        "feed_id", "old_url", "new_url", F.col("source").alias("change_source"), "changed_at"
    )
    return (
        with_health(feeds, as_of)
        .join(settings, "feed_id", "left")
        .withColumns(
            {
                "fetch_full_content": F.coalesce("fetch_full_content", F.lit(False)),
                "priority": F.coalesce("priority", F.lit(DEFAULT_PRIORITY)),
            }
        )
        .join(changes, "feed_id", "left")
        .orderBy("feed_id", F.desc_nulls_last("changed_at"))
    )


def url_changes(changes: DataFrame) -> DataFrame:
    """Changes worth logging: the old address is known and differs from the new one."""
    old = text_or_empty(F.col("old_url"))
    return changes.where((old != "") & (old != text_or_empty(F.col("new_url"))))


def resolve_addresses(history: DataFrame) -> DataFrame:
    """Where every address that was ever left points now: (old_url, current_url, feed_id, hops).

    From an address the latest move away counts, and moves are followed forward in time only, so
    going back and forth between two addresses ends. Chains are followed by doubling: a chain of n
    moves takes log2(n) joins, without a cap. The joined side has one row per address, so a popular
    target is skew on one side only, which Spark splits.
    """
    moves = (
        url_changes(history)
        .groupBy("old_url")
        .agg(F.max_by(F.struct("new_url", "feed_id", "changed_at"), F.struct("changed_at", "new_url")).alias("m"))
        .select(
            "old_url",
            F.col("m.new_url").alias("current_url"),
            F.col("m.feed_id").alias("feed_id"),
            F.col("m.changed_at").alias("left_at"),
            F.col("m.changed_at").alias("arrived_at"),
            F.lit(1).alias("hops"),
        )
    )
    state = cut_lineage(moves)
    while True:
        onward = state.select(
            F.col("old_url").alias("_from"),
            F.col("current_url").alias("_to"),
            F.col("feed_id").alias("_feed"),
            F.col("left_at").alias("_left"),
            F.col("arrived_at").alias("_arrived"),
            F.col("hops").alias("_hops"),
        )
        go = (F.col("current_url") == F.col("_from")) & (F.col("_left") > F.col("arrived_at"))
        joined = state.join(onward, go, "left")
        follow = F.col("_from").isNotNull()
        nxt = joined.select(
            "old_url",
            F.when(follow, F.col("_to")).otherwise(F.col("current_url")).alias("current_url"),
            F.when(follow, F.col("_feed")).otherwise(F.col("feed_id")).alias("feed_id"),
            "left_at",
            F.when(follow, F.col("_arrived")).otherwise(F.col("arrived_at")).alias("arrived_at"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            follow.alias("_moved"),
        )
        nxt = cut_lineage(nxt)
        moved = not nxt.where("_moved").isEmpty()
        state = nxt.drop("_moved")
        if not moved:
            return state.select("old_url", "current_url", "feed_id", "hops")


def posts_by_old_address(
    posts: DataFrame, feeds: DataFrame, history: DataFrame, url: str = "feed_url"
) -> DataFrame:
    """Feed of posts that name a feed by a present or a former address."""
    present = feeds.select(F.col("feed_url").alias(url), F.col("feed_id").alias("_now"))
    former = resolve_addresses(history).select(
        F.col("old_url").alias(url), F.col("feed_id").alias("_then")
    )
    out = posts.join(present, url, "left").join(former, url, "left")
    return out.withColumn("feed_id", F.coalesce("_now", "_then")).drop("_now", "_then")


def author_titles(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """New titles for author feeds: author of the newest entry, else the name in the address."""
    pages = feeds.where(F.contains("feed_url", F.lit("/author/")))
    signed = attach(entries, pages.select("feed_id"), "feed_id", "left_semi")
    newest = signed.groupBy("feed_id").agg(
        F.max_by("author", F.struct("published_at", -F.col("entry_id"))).alias("author")
    )
    joined = pages.join(newest, "feed_id", "left")
    author = F.when(F.length("author") > 0, F.col("author")).otherwise(author_slug(F.col("feed_url")))
    title = author_title(author, F.col("title"))
    return joined.select(
        "feed_id",
        F.col("title").alias("old_title"),
        title.alias("new_title"),
        (title != F.trim(text_or_empty(F.col("title")))).alias("renamed"),
    )
