"""Queries: keyed tables on disk and read events stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators.rules import list_filters
from articleflow.operators.searchindex import SearchIndex
from articleflow.plans.registry import query
from articleflow.schemas import conform
from articleflow.session import work_folder
from articleflow.sources import tables
from articleflow.sources.buckets import BucketedTable
from articleflow.sources.readerviews import ReaderViews
from articleflow.streaming import reads


def _changed(v: ReaderViews) -> BucketedTable:
    """First versions stored, later ones applied, then the keys of toxic documents deleted."""
    rows = v.snapshots().select("entry_id", "version", "content_text")
    table = BucketedTable(v.spark, f"{work_folder(v.spark)}/snapshots", ["entry_id"], 16)
    table.create(rows.where("version = 1"))
    table.apply(rows.where("version > 1"), F.col("version"))
    table.apply(deletes=v.table("labels").where("toxic = 1").selectExpr("doc_id AS entry_id"))
    return table


_CHANGED_SQL = """
    SELECT entry_id, version, md5(content_text) AS text_md5 FROM v_snapshots
    WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1"""


@query("bucketed_upsert", _CHANGED_SQL)
def bucketed_upsert(v: ReaderViews) -> DataFrame:
    return _changed(v).read().select("entry_id", "version", F.md5("content_text").alias("text_md5"))


@query("bucketed_lookup", f"SELECT entry_id, version FROM ({_CHANGED_SQL}) WHERE entry_id IN (SELECT user_id FROM events)")
def bucketed_lookup(v: ReaderViews) -> DataFrame:
    asked = v.table("events").select(F.col("user_id").alias("entry_id"))
    return _changed(v).lookup(asked).select("entry_id", "version")


@query("stream_reads_once", "SELECT CAST(read_at AS DATE) AS day, count(*) AS cnt FROM v_read_events GROUP BY 1")
def stream_reads_once(v: ReaderViews) -> DataFrame:
    """Every event delivered twice, stored once, then counted per day from what was stored."""
    folder = work_folder(v.spark)
    events = ReaderViews(v.spark, v.folder, streaming=True).read_events()
    once = reads.first_deliveries(events.unionByName(events), ["id"], "40 days")
    reads.append_batches(once, f"{folder}/reads", f"{folder}/reads_checkpoint").awaitTermination()
    stored = v.spark.read.parquet(f"{folder}/reads")
    again = v.spark.readStream.schema(stored.schema).parquet(f"{folder}/reads")
    reads.write_updates(reads.daily_reads(again), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return reads.latest_updates(v.spark.read.parquet(f"{folder}/log"), ["day"])


@query(
    "entry_search_indexed",
    """SELECT entry_id, feed_id, md5(title) AS title_md5 FROM v_entries
       WHERE contains(lower(title || chr(10) || content), 'dhaed') AND contains(lower(title || chr(10) || content), 'on')
         AND contains(lower(title || chr(10) || content), 'thin')""",
)
def entry_search_indexed(v: ReaderViews) -> DataFrame:
    """A search over all entries by postings of its rarest runs."""
    index = SearchIndex(v.spark, f"{work_folder(v.spark)}/index")
    index.add(v.entries())
    return index.search(v.entries(), "dhaED on Thin").select("entry_id", "feed_id", F.md5("title").alias("title_md5"))


@query("typed_scan", "SELECT entry_id, feed_id, version, md5(content_text) AS text_md5, url IS NULL AS no_url FROM (SELECT *, NULL AS url FROM v_snapshots)")
def typed_scan(v: ReaderViews) -> DataFrame:
    """Snapshots from files of two ages: the first versions were stored before there was a version column."""
    rows = v.snapshots().select("entry_id", "feed_id", "version", "content_text")
    path = f"{work_folder(v.spark)}/snapshots"
    tables.append(rows.where("version = 1").drop("version"), path)
    tables.append(rows.where("version IS DISTINCT FROM 1").withColumn("retired", F.lit(0)), path)
    stored = tables.read_table(v.spark, "article_snapshots", path)
    return stored.select(
        "entry_id", "feed_id", "version", F.md5("content_text").alias("text_md5"), F.col("url").isNull().alias("no_url")
    )


@query(
    "filter_list",
    """SELECT c_custkey AS id, 'filter ' || c_custkey AS name, 'title' AS field, c_name AS value,
              TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_nationkey AS INTEGER)) AS created_at
       FROM customer""",
)
def filter_list(v: ReaderViews) -> DataFrame:
    """Stored saved filters, read by their declared schema, newest first."""
    filters = v.table("customer").selectExpr(
        "c_custkey AS id",
        "concat('filter ', c_custkey) AS name",
        "array(named_struct('field', 'title', 'op', 'contains', 'value', c_name)) AS rules",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(c_nationkey AS INT)) AS created_at",
    )
    path = f"{work_folder(v.spark)}/filters"
    tables.append(conform(filters, "saved_filters"), path)
    rows = list_filters(tables.read_exact(v.spark, "saved_filters", path))
    return rows.selectExpr(
        "id", "name", "rules[0].field AS field", "rules[0].value AS value", "CAST(created_at AS TIMESTAMP_NTZ) AS created_at"
    )
