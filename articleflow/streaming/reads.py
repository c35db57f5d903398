"""Running reading statistics and unread counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow.operators.ordering import over_groups, top_per_group


def daily_reads(read_events: DataFrame, late: str = "1 day") -> DataFrame:
    """Reads per day of a read-event stream; days older than the watermark leave the state."""
    timed = read_events.withColumn("read_at", F.col("read_at").cast("timestamp"))
    return (
        timed.withWatermark("read_at", late)
        .groupBy(F.window("read_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.to_date("window.start").alias("day"), "cnt")
    )


def first_deliveries(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within ``late`` of the newest; keys older than that leave the state."""
    timed = events.withColumn("read_at", F.col("read_at").cast("timestamp"))
    return timed.withWatermark("read_at", late).dropDuplicatesWithinWatermark(keys)


def write_updates(
    updates: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "update"
) -> StreamingQuery:
    """Start a query, of updates unless told otherwise, that logs each micro-batch in its own folder.

    A repeated batch overwrites its folder, so the log is the same after any restart. ``every``
    gives a polling interval; without it the query ends with the data at hand.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        updates.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(log)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def append_batches(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """As :func:`write_updates` for rows that are final: the folder is a table every row of which is written once."""
    return write_updates(rows, path, checkpoint, every, "append")


def latest_updates(log: DataFrame, keys: list[str]) -> DataFrame:
    """Present value per key of an update log."""
    return top_per_group(log, keys, [F.desc("batch_id")], 1).drop("batch_id")


def unread_counts(entries: DataFrame) -> DataFrame:
    """Running number of unread entries of an entry stream."""
    return entries.where("status = 'unread'").groupBy().agg(F.count(F.lit(1)).alias("count"))


def unread_deltas(log: DataFrame) -> DataFrame:
    """(poll, count, new): how many more unread entries than at the poll before, at least 0.

    The first poll only sets the level.
    """
    keyed = log.select(F.lit(1).alias("_all"), "poll", "count")
    rows = over_groups(
        keyed, ["_all"], ["poll"], lambda g: g.neighbours({"_last": ("count", -1)}).result()
    )
    new = F.greatest(F.col("count") - F.coalesce("_last", "count"), F.lit(0))
    return rows.select("poll", "count", new.alias("new"))
