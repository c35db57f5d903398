"""The polling pipeline: decide, store versions, enrich them, apply saved filters to new entries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow.operators.rules import SavedFilter, filter_actions, match_filters
from articleflow.session import cut_lineage
from articleflow.streaming.versions import stream_changes

# Fixed value: seconds between polls.
POLL_SECONDS = 60


@dataclass
class IngestJob:
    """One streaming query from polls to snapshots and actions.

    Every micro-batch writes ``<out>/<table>/batch_id=<n>`` folders and overwrites them when it is
    repeated, so state and sinks agree after any restart.

    ``articles(spark)`` returns the table of polled articles (entry_id, polled_at and the columns to
    store); a batch reads only the time range of its inserts. Of several articles for one poll the
    smallest row counts. An insert whose article is not there yet goes to the table ``pending``;
    ``replay`` stores it once the article has come. ``enrich`` maps names to functions from stored
    articles to a table; their failures belong in columns of that table (see ``enrichment`` for a
    stream of its own). ``stored`` and ``remember``: see ``stream_changes``.
    """

    polls: DataFrame
    articles: Callable[[SparkSession], DataFrame]
    out: str
    checkpoint: str
    filters: list[SavedFilter] = field(default_factory=list)
    enrich: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    on_revert: str = "touch"
    stored: DataFrame | None = None
    remember: timedelta | None = None

    def _write(self, df: DataFrame, table: str, batch_id: int) -> str:
        path = f"{self.out}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return path

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The decisions are written first and read back: the stateful step runs once per batch.
        decided = spark.read.parquet(self._write(batch, "decisions", batch_id))
        inserts = decided.where(F.col("action").isin("insert_new", "insert_version"))
        self._store(spark, inserts, batch_id)

    def _store(self, spark: SparkSession, inserts: DataFrame, batch_id: int) -> None:
        """Write the inserts whose article is at hand, what follows from them, and the rest as pending."""
        span = inserts.agg(F.min("polled_at").alias("lo"), F.max("polled_at").alias("hi")).first()
        if span.lo is None:
            return
        source = self.articles(spark)
        at = F.col("polled_at").cast("timestamp")
        polled = source.where(at.between(F.lit(span.lo), F.lit(span.hi))).withColumn("polled_at", at)
        keep = [c for c in polled.columns if c not in ("entry_id", "polled_at", *inserts.columns)]
        row = F.min(F.struct(F.lit(1).alias("_"), *keep)).alias("_article")
        found = polled.groupBy("entry_id", "polled_at").agg(row)
        joined = inserts.join(found, ["entry_id", "polled_at"], "left")
        # One folder holds both, so the join runs once and a repeated batch overwrites both together.
        both = spark.read.parquet(self._write(joined, "inserts", batch_id))
        late = both.where("_article is null").select(*inserts.columns)
        stored = both.where("_article is not null").select(*inserts.columns, *[f"_article.{c}" for c in keep])
        self._write(late, "pending", batch_id)
        articles = spark.read.parquet(self._write(stored, "snapshots", batch_id))
        for name, fn in self.enrich.items():
            self._write(fn(articles), name, batch_id)
        if self.filters:
            first_seen = articles.where("action = 'insert_new'")
            hits = match_filters(first_seen, self.filters)
            at = first_seen.select("entry_id", "polled_at")
            actions = filter_actions(hits.join(at, "entry_id"), F.col("polled_at"))
            self._write(actions, "actions", batch_id)

    def replay(self, spark: SparkSession) -> None:
        """Store pending inserts whose article has come since; those still without one stay pending.

        Runs between batches. Its folders have numbers below zero, which no batch has.
        """
        pending, snapshots = (spark.read.parquet(f"{self.out}/{t}") for t in ("pending", "snapshots"))
        least = snapshots.agg(F.min("batch_id").alias("n")).first().n
        waiting = pending.drop("batch_id").dropDuplicates(["entry_id", "version"])
        waiting = waiting.join(snapshots.select("entry_id", "version"), ["entry_id", "version"], "left_anti")
        self._store(spark, cut_lineage(waiting.select(*[c for c in pending.columns if c != "batch_id"])), min(least or 0, 0) - 1)

    def start(self, once: bool = False, every: str | None = None) -> StreamingQuery:
        writer = (
            stream_changes(self.polls, self.on_revert, self.stored, self.remember)
            .writeStream.outputMode("append")
            .option("checkpointLocation", self.checkpoint)
            .foreachBatch(self._process)
        )
        if once:
            writer = writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=every or f"{POLL_SECONDS} seconds")
        # With a time to live Spark makes empty batches for ever, and a run to the end of the data never ends.
        conf, empty = self.polls.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(empty)
        if once and self.remember is not None:
            conf.set(empty, "false")
        try:
            return writer.start()
        finally:
            conf.set(empty, before)
