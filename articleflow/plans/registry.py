"""Registry of the queries that exercise each operator, with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from articleflow.sources.readerviews import ReaderViews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FID = "CAST(substring(source, 4) AS BIGINT)"
AS_OF_SQL = "TIMESTAMP '2024-01-30 12:00:00'"

# The reader views of ``sources.readerviews`` in the oracle's dialect.
VIEWS: dict[str, str] = {
    "v_entries": f"""
        SELECT doc_id AS entry_id, {_FID} AS feed_id, substring(text, 1, 60) AS title, text AS content,
               lang AS author,
               'https://' || CASE WHEN doc_id % 2 = 0 THEN 'www.' ELSE '' END || source
                 || '.example.com/a/' || doc_id AS url,
               CASE WHEN doc_id % 3 = 0 THEN 'read' ELSE 'unread' END AS status,
               doc_id % 10 = 0 AS starred,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720) AS published_at
        FROM documents""",
    "v_feeds": f"""
        SELECT fid AS feed_id, 'Feed ' || source AS title,
               'https://' || source || '.example.com/' ||
                 CASE WHEN fid % 5 = 1 THEN 'author/jo-' || source ELSE 'feed.xml' END AS feed_url,
               'https://' || source || '.example.com/' AS site_url, fid % 4 AS category_id,
               {AS_OF_SQL} - to_hours((fid * 25) % 48) AS checked_at,
               CAST(fid % 5 AS INTEGER) AS parsing_error_count,
               CASE fid % 12 WHEN 0 THEN 'resource not found' WHEN 1 THEN 'Unable to detect feed format'
                 WHEN 2 THEN 'access forbidden' WHEN 3 THEN 'server error' WHEN 4 THEN 'not authorized'
                 WHEN 5 THEN 'tls: bad certificate' WHEN 6 THEN 'Unsupported scheme'
                 WHEN 7 THEN 'dial tcp: lookup failed' WHEN 8 THEN 'dial tcp: refused'
                 WHEN 9 THEN 'odd failure' ELSE '' END AS parsing_error_message,
               fid % 9 = 8 AS disabled
        FROM (SELECT DISTINCT source, {_FID} AS fid FROM documents)""",
    "v_feed_config": f"""
        SELECT fid AS feed_id, CAST(1 + fid % 3 AS INTEGER) AS priority, fid % 2 = 0 AS fetch_full_content
        FROM (SELECT DISTINCT {_FID} AS fid FROM documents) WHERE fid % 4 <> 0""",
    "v_categories": "SELECT CAST(r_regionkey AS BIGINT) AS category_id, r_name AS title FROM region",
    "v_read_events": """
        SELECT event_id AS id, event_id % 200 AS entry_id, user_id % 20 AS feed_id, ts AS read_at
        FROM events WHERE event_type = 'view'""",
    "v_snapshots": """
        SELECT conv_id AS entry_id, conv_id % 20 AS feed_id, CAST(turn + 1 AS INTEGER) AS version,
               text AS content_text, '<p>' || text || '</p>' AS content_html,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS fetched_at, turn
        FROM conversations""",
    "v_polls": """
        SELECT conv_id AS entry_id, conv_id % 20 AS feed_id, turn, d AS delay, text AS content,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) + to_seconds(d) AS polled_at
        FROM conversations, (VALUES (0), (30)) AS t(d)
        WHERE d = 0 OR (conv_id + turn) % 3 = 0""",
    "v_tags": """
        SELECT doc_id AS entry_id, lang AS tag FROM documents
        UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'quality' ELSE 'lowquality' END FROM labels
        UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1""",
    "v_embeddings": "SELECT vec_id AS entry_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "v_fetch_attempts": """
        SELECT url, stage, (page_id + stage) % 5 > 2 AS ok, html AS body
        FROM pages, (VALUES (1), (2), (3), (4)) AS t(stage) WHERE stage <= 2 OR page_id % 2 = 0""",
    "v_url_history": """
        SELECT event_id % 20 AS feed_id, 'https://old.example.com/' || event_id AS old_url,
               CASE WHEN event_type = 'signup' THEN 'https://new.example.com/' ELSE 'https://old.example.com/' END || (event_id + 7) AS new_url,
               CASE WHEN event_id % 2 = 0 THEN 'set-url' ELSE 'auto-discover' END AS source,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id) AS changed_at
        FROM events""",
    "v_actions": """
        SELECT event_id AS seq, user_id AS id,
               CASE event_type WHEN 'view' THEN 'mark_read' WHEN 'click' THEN 'toggle_star'
                 WHEN 'purchase' THEN 'star' WHEN 'signup' THEN 'mark_unread' ELSE 'pause' END AS action, ts
        FROM events""",
    "v_share_links": """
        SELECT c_custkey % 200 AS entry_id, 't' || c_custkey AS token,
               CASE WHEN c_custkey % 5 <> 0
                 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER)) END AS expires_at
        FROM customer WHERE c_acctbal > 0""",
    "v_share_requests": "SELECT o_orderkey AS request_id, 't' || o_custkey AS token FROM orders",
    "v_site_settings": """
        SELECT domain FROM (
          SELECT DISTINCT source || '.example.com' AS domain FROM documents
          UNION ALL
          SELECT DISTINCT 'www.' || source || '.example.com' FROM documents
          WHERE CAST(substring(source, 4) AS INTEGER) % 3 = 0)
        WHERE NOT domain LIKE 'src1%'""",
}


def with_views(body: str) -> str:
    """Prefix a query with the views it names."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if not ctes:
        return body
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes},\n{text[4:]}"
    return f"WITH {ctes}\n{text}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its SQL where there is one."""

    def register(fn: Callable[[ReaderViews], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ReaderViews(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
