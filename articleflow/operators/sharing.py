"""Share links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.versions import latest_snapshots

# Fixed value: life of a link in days.
LINK_DAYS = 7


def with_expiry(links: DataFrame) -> DataFrame:
    return links.withColumn(
        "expires_at", F.col("created_at") + F.expr(f"make_dt_interval({LINK_DAYS})")
    )


def is_expired(as_of: Column) -> Column:
    return F.coalesce(F.col("expires_at") < as_of, F.lit(False))


def resolve_shares(
    requests: DataFrame, links: DataFrame, entries: DataFrame, snapshots: DataFrame, as_of: Column
) -> DataFrame:
    """Outcome of every request for a token: ``not_found``, ``expired`` or ``ok`` with the content.

    Content is resolved once per linked entry before requests are joined, and joined to live links
    only, so a token that is requested very often multiplies no wide rows on the way.
    """
    known = links.select("token", "entry_id", is_expired(as_of).alias("_expired"))
    live = known.where("NOT _expired").select("entry_id").distinct()
    stored = latest_snapshots(
        snapshots.select("entry_id", "version", "content_html").join(live, "entry_id", "left_semi")
    ).select("entry_id", F.col("content_html").alias("_stored"), F.lit(True).alias("_has"))
    feed = entries.select("entry_id", F.col("content").alias("_feed")).join(live, "entry_id", "left_semi")
    content = live.join(stored, "entry_id", "left").join(feed, "entry_id", "left").select(
        "entry_id", F.when(F.col("_has"), F.col("_stored")).otherwise(F.col("_feed")).alias("content")
    )
    status = (
        F.when(F.col("_expired").isNull(), "not_found")
        .when(F.col("_expired"), "expired")
        .otherwise("ok")
    )
    resolved = requests.join(known, "token", "left").withColumn("status", status)
    return (
        resolved.join(content, "entry_id", "left")
        .withColumn("content", F.when(F.col("status") == "ok", F.col("content")))
        .drop("_expired")
    )
