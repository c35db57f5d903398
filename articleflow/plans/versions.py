"""Queries: snapshots, change detection, differences, similarity, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions.text import source_hash
from articleflow.operators import entries, extraction, similar, versions
from articleflow.plans.registry import query
from articleflow.sources.readerviews import ReaderViews


@query(
    "latest_snapshot",
    """SELECT entry_id, feed_id, version, md5(content_text) AS text_md5, fetched_at FROM v_snapshots
       QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1""",
)
def latest_snapshot(v: ReaderViews) -> DataFrame:
    return versions.latest_snapshots(v.snapshots()).select(
        "entry_id", "feed_id", "version", F.md5("content_text").alias("text_md5"), "fetched_at"
    )


@query("version_counts", "SELECT entry_id, count(*) AS versions FROM v_snapshots GROUP BY 1")
def version_counts(v: ReaderViews) -> DataFrame:
    return versions.version_counts(v.snapshots())


@query(
    "changed_entries",
    "SELECT entry_id, count(*) AS versions FROM v_snapshots GROUP BY 1 HAVING count(*) > 1",
)
def changed_entries(v: ReaderViews) -> DataFrame:
    return versions.changed_entries(v.snapshots())


@query("next_versions", "SELECT entry_id, max(version) + 1 AS next_version FROM v_snapshots GROUP BY 1")
def next_versions(v: ReaderViews) -> DataFrame:
    return versions.next_versions(v.snapshots())


@query(
    "unique_snapshots",
    """SELECT DISTINCT entry_id, sha256(content) AS content_hash FROM v_polls
       EXCEPT SELECT entry_id, sha256(content_text) FROM v_snapshots WHERE version % 2 = 1""",
)
def unique_snapshots(v: ReaderViews) -> DataFrame:
    new = v.polls().select("entry_id", source_hash(F.col("content")).alias("content_hash"))
    stored = v.snapshots().where("version % 2 = 1").select(
        "entry_id", source_hash(F.col("content_text")).alias("content_hash")
    )
    return versions.unique_snapshots(new, stored)


_CHAIN_SQL = """
    SELECT entry_id, polled_at,
           CASE WHEN seen = 1 THEN 'insert_new' WHEN delay = 30 THEN 'skip' ELSE 'insert_version' END AS action,
           CAST(inserts AS INTEGER) AS version
    FROM (SELECT *, row_number() OVER w AS seen, sum(CASE WHEN delay = 0 THEN 1 ELSE 0 END) OVER w AS inserts
          FROM v_polls WINDOW w AS (PARTITION BY entry_id ORDER BY polled_at))"""


@query("version_chain", _CHAIN_SQL)
def version_chain(v: ReaderViews) -> DataFrame:
    out = versions.detect_changes(versions.poll_hashes(v.polls()))
    return out.select("entry_id", "polled_at", "action", "version")


def _hard_polls(v: ReaderViews) -> DataFrame:
    """Polls with failures, unchanged and reverted contents: content depends on turn modulo 3,
    every fifth fetch fails, the source always changes."""
    return v.polls().selectExpr(
        "entry_id",
        "feed_id",
        "polled_at",
        "sha2(content, 256) AS source_hash",
        "(entry_id + minute(polled_at)) % 5 <> 0 AS fetched",
        "concat('c', minute(polled_at) % 3 % 2) AS content_hash",
    )


_HARD_SQL = """
    WITH p AS (SELECT *, sha256(content) AS source_hash, (entry_id + minute(polled_at)) % 5 <> 0 AS ok,
                      'c' || (minute(polled_at) % 3 % 2) AS content_hash,
                      row_number() OVER (PARTITION BY entry_id ORDER BY polled_at) AS n FROM v_polls),
    e AS (SELECT *, coalesce(max(CAST(ok AS INTEGER)) OVER (PARTITION BY entry_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS existed,
                 lag(source_hash) OVER (PARTITION BY entry_id ORDER BY n) AS prev FROM p),
    s AS (SELECT *, existed AND prev = source_hash AS skipped FROM e),
    f AS (SELECT *, ok AND NOT coalesce(skipped, false) AS stored FROM s),
    g AS (SELECT *, stored AND row_number() OVER (PARTITION BY entry_id, content_hash, stored ORDER BY n) = 1 AS ins FROM f),
    h AS (SELECT *, sum(CAST(ins AS INTEGER)) OVER (PARTITION BY entry_id ORDER BY n) AS version,
                 last_value(CASE WHEN ins THEN content_hash END IGNORE NULLS) OVER (PARTITION BY entry_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM g)
    SELECT entry_id, polled_at, CAST(coalesce(version, 0) AS INTEGER) AS version,
           CASE WHEN coalesce(skipped, false) THEN 'skip' WHEN NOT ok AND existed THEN 'failed_touch' WHEN NOT ok THEN 'failed_retry'
                WHEN ins AND existed THEN 'insert_version' WHEN ins THEN 'insert_new'
                WHEN content_hash = latest THEN 'unchanged_touch' ELSE 'revert_touch' END AS action
    FROM h"""


@query("version_chain_hard", _HARD_SQL)
def version_chain_hard(v: ReaderViews) -> DataFrame:
    out = versions.detect_changes(_hard_polls(v))
    return out.select("entry_id", "polled_at", "action", "version")


CHAIN_STORED_SQL = """
    WITH b AS (SELECT *, entry_id % 3 AS k FROM v_polls)
    SELECT entry_id, polled_at,
           CASE WHEN first THEN CASE k WHEN 0 THEN 'backfill' WHEN 1 THEN 'skip' ELSE 'insert_version' END
                WHEN delay = 30 THEN 'skip' ELSE 'insert_version' END AS action,
           CAST(7 + sum(CASE WHEN (first AND k = 2) OR (NOT first AND delay = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id ORDER BY polled_at) AS INTEGER) AS version
    FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY polled_at) = 1 AS first FROM b)"""


def stored_starts(v: ReaderViews) -> DataFrame:
    """A stored version of every entry: without source hash, with that of its first poll, or another."""
    return v.snapshots().where("version = 1").selectExpr(
        "entry_id",
        "7 AS version",
        "CASE entry_id % 3 WHEN 0 THEN NULL WHEN 1 THEN sha2(content_text, 256) ELSE 'other' END AS source_hash",
        "'stored' AS content_hash",
    )


@query("version_chain_stored", CHAIN_STORED_SQL)
def version_chain_stored(v: ReaderViews) -> DataFrame:
    out = versions.detect_changes(versions.poll_hashes(v.polls()), stored_starts(v))
    return out.select("entry_id", "polled_at", "action", "version")


@query(
    "forced_fetch",
    """SELECT entry_id, polled_at, CAST(1 + (turn + 1) // 2 AS INTEGER) AS version,
              CASE WHEN turn = 0 AND delay = 0 THEN 'insert_new' WHEN turn % 2 = 0 THEN 'skip'
                   WHEN delay = 0 THEN 'insert_version' ELSE 'unchanged_touch' END AS action FROM v_polls""",
)
def forced_fetch(v: ReaderViews) -> DataFrame:
    """A source that never seems to change; every second turn is fetched on demand all the same."""
    polls = v.polls().selectExpr(
        "entry_id", "polled_at", "'same' AS source_hash", "true AS fetched", "sha2(content, 256) AS content_hash",
        "minute(polled_at) % 2 = 1 AS force",
    )
    return versions.detect_changes(polls).select("entry_id", "polled_at", "version", "action")


@query("poll_throughput", f"SELECT action, count(*) AS polls FROM ({_HARD_SQL}) GROUP BY 1")
def poll_throughput(v: ReaderViews) -> DataFrame:
    return versions.throughput(versions.detect_changes(_hard_polls(v)))


@query(
    "version_pairs",
    """SELECT entry_id, version - 1 AS from_version, version AS to_version, md5(prev) AS from_md5, md5(content_text) AS to_md5
       FROM (SELECT *, lag(content_text) OVER (PARTITION BY entry_id ORDER BY version) AS prev FROM v_snapshots) WHERE version > 1""",
)
def version_pairs(v: ReaderViews) -> DataFrame:
    return versions.version_pairs(v.snapshots()).select(
        "entry_id", "from_version", "to_version",
        F.md5("from_text").alias("from_md5"), F.md5("to_text").alias("to_md5"),
    )


@query("version_diff")
def version_diff(v: ReaderViews) -> DataFrame:
    return versions.version_diff(v.snapshots())


@query(
    "line_changes",
    """WITH p AS (SELECT entry_id, version, content_text, lag(content_text) OVER (PARTITION BY entry_id ORDER BY version) AS prev FROM v_snapshots),
       l AS (SELECT entry_id, version, unnest(string_split(content_text, chr(10))) AS line, 1 AS s FROM p WHERE version > 1
             UNION ALL SELECT entry_id, version, unnest(string_split(prev, chr(10))), -1 FROM p WHERE version > 1),
       d AS (SELECT entry_id, version, line, sum(s) AS d FROM l GROUP BY ALL)
       SELECT entry_id, version - 1 AS from_version, version AS to_version,
              CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM d GROUP BY ALL""",
)
def line_changes(v: ReaderViews) -> DataFrame:
    return versions.line_changes(v.snapshots())


@query(
    "similar_topk",
    """WITH t AS (SELECT embedding AS vec FROM v_embeddings ORDER BY entry_id LIMIT 1)
       SELECT entry_id, round(list_cosine_similarity(embedding, vec), 9) AS similarity FROM v_embeddings, t
       WHERE entry_id <> (SELECT min(entry_id) FROM v_embeddings) AND list_cosine_similarity(embedding, vec) >= 0.2
       ORDER BY similarity DESC, entry_id LIMIT 5""",
)
def similar_topk(v: ReaderViews) -> DataFrame:
    vectors = v.embeddings()
    target = vectors.orderBy("entry_id").first()
    out = similar.similar_to(vectors, target["entry_id"], target["embedding"], threshold=0.2)
    return out.select("entry_id", F.round("similarity", 9).alias("similarity"))


_SIMILAR_SQL = """
    SELECT a.entry_id, b.entry_id AS other_id, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS similarity
    FROM v_embeddings a JOIN v_embeddings b ON a.entry_id <> b.entry_id
    WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.35
    QUALIFY row_number() OVER (PARTITION BY a.entry_id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.entry_id) <= 5"""


@query("similar_entries", _SIMILAR_SQL)
def similar_entries(v: ReaderViews) -> DataFrame:
    out = similar.similar_entries(v.embeddings(), threshold=0.35)
    return out.withColumn("similarity", F.round("similarity", 9))


@query("similar_entries_hashed")
def similar_entries_hashed(v: ReaderViews) -> DataFrame:
    return similar.similar_entries(v.embeddings(), threshold=0.35, method="hashed", bands=24, bits=6)


@query(
    "enabled_entries",
    """SELECT entry_id, feed_id FROM v_entries JOIN v_feed_config USING (feed_id) WHERE fetch_full_content AND url <> ''""",
)
def enabled_entries(v: ReaderViews) -> DataFrame:
    return entries.enabled_entries(v.entries(), v.feed_config()).select("entry_id", "feed_id")


@query("extract_articles")
def extract_articles(v: ReaderViews) -> DataFrame:
    return extraction.extract_articles(v.table("pages"))


@query("extract_articles_rules")
def extract_articles_rules(v: ReaderViews) -> DataFrame:
    """Extraction under per-feed rules: a selector for some feeds, removals for others."""
    pages = v.table("pages").selectExpr("page_id % 4 AS feed_id", "url", "html")
    config = v.table("pages").selectExpr(
        "page_id % 4 AS feed_id",
        """named_struct('content_xpath', IF(page_id % 4 = 1, '//article', NULL),
             'unwrap_tags', array('article'), 'remove_tags', IF(page_id % 4 = 2, array('h*'), array()),
             'remove_xpath', IF(page_id % 4 = 3, array('//div[@class="ad"]'), array())) AS extract_rules""",
    ).distinct()
    return extraction.extract_articles(pages, extraction.compile_rules(config))
