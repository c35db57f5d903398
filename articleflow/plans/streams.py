"""Queries: streaming jobs run to the end of the data at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators.versions import poll_hashes
from articleflow.plans.registry import query
from articleflow.plans.versions import CHAIN_STORED_SQL, _CHAIN_SQL, stored_starts
from articleflow.session import work_folder
from articleflow.sources.readerviews import ReaderViews
from articleflow.streaming import reads
from articleflow.streaming.enrichment import EnrichJob
from articleflow.streaming.ingest import IngestJob
from articleflow.streaming.versions import STATE_STORE


def _streaming(v: ReaderViews) -> ReaderViews:
    return ReaderViews(v.spark, v.folder, streaming=True)


@query("stream_daily_reads", "SELECT CAST(read_at AS DATE) AS day, count(*) AS cnt FROM v_read_events GROUP BY 1")
def stream_daily_reads(v: ReaderViews) -> DataFrame:
    folder = work_folder(v.spark)
    daily = reads.daily_reads(_streaming(v).read_events())
    reads.write_updates(daily, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return reads.latest_updates(v.spark.read.parquet(f"{folder}/log"), ["day"])


@query("stream_unread", "SELECT count(*) AS count FROM v_entries WHERE status = 'unread'")
def stream_unread(v: ReaderViews) -> DataFrame:
    folder = work_folder(v.spark)
    counts = reads.unread_counts(_streaming(v).entries())
    reads.write_updates(counts, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = v.spark.read.parquet(f"{folder}/log")
    return log.orderBy(F.desc("batch_id")).limit(1).select("count")


@query(
    "unread_deltas",
    """SELECT poll, count, greatest(count - coalesce(lag(count) OVER (ORDER BY poll), count), 0) AS new
       FROM (SELECT event_id AS poll, user_id AS count FROM events)""",
)
def unread_deltas(v: ReaderViews) -> DataFrame:
    return reads.unread_deltas(v.table("events").selectExpr("event_id AS poll", "user_id AS count"))


def _ingest(v: ReaderViews, **kw) -> str:
    return _ingested(v, **kw).out


def _ingested(v: ReaderViews, **kw) -> IngestJob:
    folder = work_folder(v.spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(provider, None)
    v.spark.conf.set(provider, STATE_STORE)
    try:
        given = {
            "polls": poll_hashes(_streaming(v).polls()),
            "articles": lambda spark: ReaderViews(spark, v.folder).polls(),
        }
        job = IngestJob(**given | kw, out=f"{folder}/out", checkpoint=f"{folder}/checkpoint")
        job.start(once=True).awaitTermination()
    finally:
        if before is None:
            v.spark.conf.unset(provider)
        else:
            v.spark.conf.set(provider, before)
    return job


@query("stream_versions", _CHAIN_SQL)
def stream_versions(v: ReaderViews) -> DataFrame:
    decided = v.spark.read.parquet(f"{_ingest(v)}/decisions")
    return decided.select("entry_id", F.col("polled_at").cast("timestamp_ntz").alias("polled_at"), "action", "version")


@query(
    "stream_rule_actions",
    """SELECT conv_id AS id, 'star' AS action FROM conversations WHERE turn = 0 AND contains('src' || (conv_id % 20), 'src1')""",
)
def stream_rule_actions(v: ReaderViews) -> DataFrame:
    """Saved filters on entries seen for the first time."""
    from articleflow.operators.rules import SavedFilter, parse_rules

    wanted = [SavedFilter(1, "src1", parse_rules('[{"field":"url","op":"contains","value":"SRC1"}]'), "star")]
    out = _ingest(v, filters=wanted)
    return v.spark.read.parquet(f"{out}/actions").select("id", "action")


@query("stream_from_stored", CHAIN_STORED_SQL)
def stream_from_stored(v: ReaderViews) -> DataFrame:
    """The stream goes on from stored snapshots: backfilled source hashes, version numbers from there."""
    decided = v.spark.read.parquet(f"{_ingest(v, stored=stored_starts(v))}/decisions")
    return decided.select("entry_id", F.col("polled_at").cast("timestamp_ntz").alias("polled_at"), "action", "version")


@query(
    "stream_snapshots",
    "SELECT conv_id AS entry_id, CAST(turn + 1 AS INTEGER) AS version, conv_id % 20 AS feed_id, md5(text) AS content_md5 FROM conversations",
)
def stream_snapshots(v: ReaderViews) -> DataFrame:
    """What is stored when the articles of every third entry come after their polls were decided."""
    known = lambda spark: ReaderViews(spark, v.folder).polls()
    job = _ingested(v, articles=lambda spark: known(spark).where("entry_id % 3 <> 0"))
    job.articles = known
    job.replay(v.spark)
    stored = v.spark.read.parquet(f"{job.out}/snapshots")
    return stored.select("entry_id", "version", "feed_id", F.md5("content").alias("content_md5"))


@query(
    "stream_enriched",
    """SELECT conv_id AS entry_id, CAST(turn + 1 AS INTEGER) AS version,
              CASE WHEN length(text) % 10 <> 0 THEN CAST(length(text) AS VARCHAR) END AS value,
              CASE WHEN length(text) % 10 = 0 THEN CAST(2 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS attempts
       FROM conversations""",
)
def stream_enriched(v: ReaderViews) -> DataFrame:
    """Answers to stored snapshots from a model that fails on about every tenth text, asked twice."""
    job = _ingested(v)
    folder, stored = work_folder(v.spark), v.spark.read.parquet(f"{job.out}/snapshots")

    def lengths(texts: list[str]) -> list[str]:
        if any(len(t) % 10 == 0 for t in texts):
            raise ValueError("no answer")
        return [str(len(t)) for t in texts]

    stream = v.spark.readStream.schema(stored.schema).parquet(f"{job.out}/snapshots")
    answers = EnrichJob(stream, lengths, F.col("content"), f"{folder}/out", f"{folder}/checkpoint")
    answers.start().awaitTermination()
    answers.retry(v.spark)
    return answers.enriched(stored).select("entry_id", "version", "value", F.coalesce("attempts", F.lit(0)).alias("attempts"))
