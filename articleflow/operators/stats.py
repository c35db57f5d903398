"""Reading statistics over the read-event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.functions.text import percent_of
from articleflow.operators.sizing import attach

DAY = "make_dt_interval({})"


def _ago(as_of: Column, days: int) -> Column:
    return as_of - F.expr(DAY.format(days))


def with_bars(df: DataFrame, count: str, out: str = "bar") -> DataFrame:
    """Percent of the largest count. The input is an aggregated report of bounded length."""
    everything = Window.partitionBy()
    return df.withColumn(out, percent_of(F.col(count), F.max(count).over(everything)))


def summary(read_events: DataFrame, as_of: Column) -> DataFrame:
    """Number of articles read today and ever, in one pass."""
    today = F.date_trunc("day", as_of).cast("timestamp_ntz")
    return read_events.agg(
        F.count_if(F.col("read_at") >= today).alias("today_count"),
        F.count(F.lit(1)).alias("total"),
    )


def daily(read_events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Reads per day of the last ``days`` days (rolling bound), with bar lengths."""
    counts = (
        read_events.where(F.col("read_at") >= _ago(as_of, days))
        .groupBy(F.to_date("read_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return with_bars(counts, "cnt").orderBy("day")


def weekly(read_events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Reads per week (Monday start) of the last 30 days, with bar lengths."""
    counts = (
        read_events.where(F.col("read_at") >= _ago(as_of, days))
        .groupBy(F.to_date(F.date_trunc("week", "read_at")).alias("week"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return with_bars(counts, "cnt").orderBy("week")


def top_feeds(
    read_events: DataFrame, feeds: DataFrame, as_of: Column, days: int = 30, k: int = 10
) -> DataFrame:
    """Most-read feeds. Names are joined to the ``k`` winners, not to the events."""
    winners = (
        read_events.where(F.col("read_at") >= _ago(as_of, days))
        .groupBy("feed_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "feed_id")
        .limit(k)
    )
    named = attach(winners, feeds.select("feed_id", "title"), "feed_id")
    name = F.coalesce("title", F.concat(F.lit("Feed "), F.col("feed_id").cast("string")))
    out = named.select("feed_id", name.alias("name"), "cnt")
    return with_bars(out, "cnt").orderBy(F.desc("cnt"), "feed_id")
