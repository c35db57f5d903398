"""Queries: statistics, entry lists, tags, digest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators import digest, entries, rules, stats
from articleflow.operators.entries import EntryQuery
from articleflow.plans.registry import AS_OF_SQL, query
from articleflow.sources.readerviews import AS_OF, ReaderViews, as_of

_BAR = "CAST(floor(cnt / max(cnt) OVER () * 100) AS INTEGER) AS bar"


@query(
    "stats_summary",
    """SELECT count(*) FILTER (WHERE read_at >= TIMESTAMP '2024-01-30 00:00:00') AS today_count,
              count(*) AS total FROM v_read_events""",
)
def stats_summary(v: ReaderViews) -> DataFrame:
    return stats.summary(v.read_events(), as_of())


@query(
    "stats_daily",
    f"""SELECT day, cnt, {_BAR} FROM (
          SELECT CAST(read_at AS DATE) AS day, count(*) AS cnt FROM v_read_events
          WHERE read_at >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1)""",
)
def stats_daily(v: ReaderViews) -> DataFrame:
    return stats.daily(v.read_events(), as_of())


@query(
    "stats_weekly",
    f"""SELECT week, cnt, {_BAR} FROM (
          SELECT CAST(date_trunc('week', read_at) AS DATE) AS week, count(*) AS cnt FROM v_read_events
          WHERE read_at >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY 1)""",
)
def stats_weekly(v: ReaderViews) -> DataFrame:
    return stats.weekly(v.read_events(), as_of())


@query(
    "stats_top_feeds",
    f"""WITH top AS (
          SELECT feed_id, count(*) AS cnt FROM v_read_events
          WHERE read_at >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY 1 ORDER BY cnt DESC, feed_id LIMIT 10)
        SELECT feed_id, coalesce(title, 'Feed ' || feed_id) AS name, cnt, {_BAR}
        FROM top LEFT JOIN v_feeds USING (feed_id)""",
)
def stats_top_feeds(v: ReaderViews) -> DataFrame:
    return stats.top_feeds(v.read_events(), v.feeds(), as_of())


_PAGE_COLUMNS = ["entry_id", "feed_id", "title", "status", "starred", "published_at"]


@query(
    "entry_scan",
    f"""SELECT entry_id, feed_id, title, status, starred, published_at FROM v_entries
        WHERE status = 'unread' AND published_at > TIMESTAMP '2024-01-05 00:00:00'
          AND published_at < {AS_OF_SQL}
          AND contains(lower(title || chr(10) || content), 'th') AND contains(lower(title || chr(10) || content), 'on')
        ORDER BY published_at DESC, entry_id LIMIT 50 OFFSET 20""",
)
def entry_scan(v: ReaderViews) -> DataFrame:
    q = EntryQuery(
        status="unread", after=datetime(2024, 1, 5), before=AS_OF, search="th ON", offset=20
    )
    return entries.page(entries.scan_entries(v.entries(), q), q).select(*_PAGE_COLUMNS)


@query(
    "entry_total",
    """SELECT count(*) AS total FROM v_entries JOIN v_feeds USING (feed_id)
       WHERE category_id = 2 AND starred""",
)
def entry_total(v: ReaderViews) -> DataFrame:
    q = EntryQuery(starred=True, category_id=2)
    return entries.count_entries(v.entries(), q, feeds=v.feeds())


@query(
    "time_filters",
    f"""SELECT 'today' AS period, count(*) AS entries FROM v_entries WHERE published_at > TIMESTAMP '2024-01-30 00:00:00'
        UNION ALL SELECT '24h', count(*) FROM v_entries WHERE published_at > {AS_OF_SQL} - INTERVAL 24 HOUR
        UNION ALL SELECT 'week', count(*) FROM v_entries WHERE published_at > {AS_OF_SQL} - INTERVAL 7 DAY
        UNION ALL SELECT 'ever', count(*) FROM v_entries""",
)
def time_filters(v: ReaderViews) -> DataFrame:
    """All periods in one pass; unknown names do not filter."""
    counts = []
    for name in ("today", "24h", "week", "ever"):
        bound = entries.time_bound(name, AS_OF)
        hit = F.lit(True) if bound is None else F.col("published_at") > F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")
        counts.append(F.count_if(hit).alias(name))
    wide = v.entries().agg(*counts)
    return wide.unpivot([], ["today", "24h", "week", "ever"], "period", "entries")


_LISTED = """
    SELECT e.entry_id, e.feed_id, coalesce(c.priority, 2) AS priority, e.published_at,
           coalesce(array_to_string(t.tags, ','), '') AS tags, coalesce(s.n > 1, false) AS has_changes
    FROM v_entries e
    LEFT JOIN v_feed_config c USING (feed_id)
    LEFT JOIN (SELECT entry_id, list_sort(list(DISTINCT tag)) AS tags FROM v_tags GROUP BY 1) t USING (entry_id)
    LEFT JOIN (SELECT entry_id, count(*) AS n FROM v_snapshots GROUP BY 1) s USING (entry_id)"""


def _listed(v: ReaderViews, q: EntryQuery) -> DataFrame:
    df = entries.entry_list(
        v.entries(), v.feed_config(), v.tags(), v.snapshots(), q, v.feeds(), AS_OF
    )
    return df.select(
        "entry_id",
        "feed_id",
        "priority",
        "published_at",
        F.array_join("tags", ",").alias("tags"),
        "has_changes",
    )


@query(
    "entry_page",
    f"""SELECT * FROM ({_LISTED} WHERE e.status = 'unread')
        ORDER BY priority, published_at DESC, entry_id LIMIT 50 OFFSET 50""",
)
def entry_page(v: ReaderViews) -> DataFrame:
    return _listed(v, EntryQuery(offset=50))


@query(
    "entry_page_filtered",
    f"""SELECT * FROM ({_LISTED} WHERE e.published_at > {AS_OF_SQL} - INTERVAL 7 DAY
          AND EXISTS (SELECT 1 FROM v_tags x WHERE x.entry_id = e.entry_id AND x.tag IN ('en', 'toxic')))
        ORDER BY priority, published_at DESC, entry_id LIMIT 50""",
)
def entry_page_filtered(v: ReaderViews) -> DataFrame:
    return _listed(v, EntryQuery(status="all", time_filter="week", tags=["en", "toxic"]))


@query("entry_list_all", f"{_LISTED} WHERE coalesce(s.n > 1, false)")
def entry_list_all(v: ReaderViews) -> DataFrame:
    return _listed(v, EntryQuery(status="all", changed=True, limit=None))


@query(
    "entry_page_after",
    """SELECT entry_id, priority, published_at FROM (
         SELECT e.*, coalesce(c.priority, 2) AS priority FROM v_entries e LEFT JOIN v_feed_config c USING (feed_id))
       WHERE priority > 2 OR (priority = 2 AND (published_at < TIMESTAMP '2024-01-10 00:00:00'
          OR (published_at = TIMESTAMP '2024-01-10 00:00:00' AND entry_id > 216)))
       ORDER BY priority, published_at DESC, entry_id LIMIT 50""",
)
def entry_page_after(v: ReaderViews) -> DataFrame:
    listed = entries.with_priority(v.entries(), v.feed_config())
    page = entries.page_after(listed, (2, datetime(2024, 1, 10), 216))
    return page.select("entry_id", "priority", "published_at")


@query(
    "entry_priority",
    """SELECT coalesce(priority, 2) AS priority, count(*) AS entries, min(entry_id) AS first_entry
       FROM v_entries LEFT JOIN v_feed_config USING (feed_id) GROUP BY 1""",
)
def entry_priority(v: ReaderViews) -> DataFrame:
    return (
        entries.with_priority(v.entries(), v.feed_config())
        .groupBy("priority")
        .agg(F.count(F.lit(1)).alias("entries"), F.min("entry_id").alias("first_entry"))
    )


@query(
    "entry_neighbors",
    """SELECT feed_id, entry_id, published_at, lag(entry_id) OVER w AS prev_entry_id, lead(entry_id) OVER w AS next_entry_id
       FROM v_entries WINDOW w AS (PARTITION BY feed_id ORDER BY published_at DESC, entry_id)""",
)
def entry_neighbors(v: ReaderViews) -> DataFrame:
    return entries.neighbours(v.entries())


@query(
    "new_entries_per_feed",
    """SELECT feed_id, entry_id, published_at, CAST(rn AS INTEGER) AS position FROM (
         SELECT e.*, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, entry_id) AS rn
         FROM v_entries e JOIN v_feed_config c USING (feed_id) WHERE c.fetch_full_content)
       WHERE rn <= 50""",
)
def new_entries_per_feed(v: ReaderViews) -> DataFrame:
    due = entries.enabled_entries(v.entries(), v.feed_config())
    return entries.newest_per_feed(due.select("feed_id", "entry_id", "published_at"), 50)


@query(
    "entry_tags",
    "SELECT entry_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM v_tags GROUP BY 1",
)
def entry_tags(v: ReaderViews) -> DataFrame:
    return entries.tags_per_entry(v.tags()).select("entry_id", F.array_join("tags", ",").alias("tags"))


@query(
    "tag_filter",
    """SELECT entry_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS matched
       FROM v_tags WHERE tag IN ('de', 'quality', 'toxic') GROUP BY 1""",
)
def tag_filter(v: ReaderViews) -> DataFrame:
    wanted = ["de", "quality", "toxic"]
    tagged = entries.tags_overlap(entries.tags_per_entry(v.tags()), wanted)
    return tagged.select("entry_id", F.array_join(F.array_sort("matched"), ",").alias("matched"))


@query(
    "tag_filter_entries",
    """SELECT entry_id, feed_id FROM v_entries e
       WHERE EXISTS (SELECT 1 FROM v_tags t WHERE t.entry_id = e.entry_id AND tag IN ('fr', 'toxic'))""",
)
def tag_filter_entries(v: ReaderViews) -> DataFrame:
    return entries.tag_filter(v.entries(), v.tags(), ["fr", "toxic"]).select("entry_id", "feed_id")


@query(
    "tag_cloud",
    """SELECT tag, count(DISTINCT entry_id) AS entries FROM v_tags
       WHERE entry_id IN (SELECT entry_id FROM v_entries WHERE status = 'unread') GROUP BY 1""",
)
def tag_cloud(v: ReaderViews) -> DataFrame:
    return entries.tag_cloud(v.entries().where("status = 'unread'"), v.tags())


@query(
    "tag_search",
    """SELECT tag, count(DISTINCT entry_id) AS entries FROM v_tags
       WHERE contains(lower(tag), 'qual') AND entry_id IN (SELECT entry_id FROM v_entries) GROUP BY 1""",
)
def tag_search(v: ReaderViews) -> DataFrame:
    return entries.tag_cloud(v.entries(), v.tags(), "QUAL")


@query(
    "shown_tags",
    """WITH t AS (
         SELECT n_chars, doc_id AS entry_id,
                [x FOR x IN [CASE WHEN doc_id % 2 = 0 THEN 'own1' END, CASE WHEN doc_id % 3 = 0 THEN 'own2' END, source] IF x IS NOT NULL]
                  || [x FOR x IN ['m1', CASE WHEN doc_id % 5 = 0 THEN 'm2' END, lang, 'm4'] IF x IS NOT NULL] AS b
         FROM documents)
       SELECT entry_id, array_to_string(b[1:5], ',') AS shown, CAST(greatest(len(b) - 5, 0) AS INTEGER) AS more FROM t""",
)
def shown_tags(v: ReaderViews) -> DataFrame:
    own = F.expr("array_compact(array(IF(doc_id % 2 = 0, 'own1', NULL), IF(doc_id % 3 = 0, 'own2', NULL), source))")
    model = F.expr("array_compact(array('m1', IF(doc_id % 5 = 0, 'm2', NULL), lang, 'm4'))")
    shown, more = entries.shown_tags(own, model)
    return v.table("documents").select(
        F.col("doc_id").alias("entry_id"), F.array_join(shown, ",").alias("shown"), more.alias("more")
    )


@query("latest_per_feed", "SELECT feed_id, max(published_at) AS latest FROM v_entries GROUP BY 1")
def latest_per_feed(v: ReaderViews) -> DataFrame:
    return entries.latest_per_feed(v.entries())


@query(
    "unread_counters",
    "SELECT feed_id, count(*) AS unread FROM v_entries WHERE status = 'unread' GROUP BY 1",
)
def unread_counters(v: ReaderViews) -> DataFrame:
    return entries.unread_per_feed(v.entries())


@query(
    "unread_since",
    """SELECT count(*) AS count FROM v_entries
       WHERE status = 'unread' AND published_at > TIMESTAMP '2024-01-20 00:00:00'""",
)
def unread_since(v: ReaderViews) -> DataFrame:
    return entries.unread_total(v.entries(), datetime(2024, 1, 20))


_ENCLOSURES = """
    CASE doc_id % 4
      WHEN 0 THEN array()
      WHEN 1 THEN array(named_struct('url', concat('v', doc_id), 'mime_type', 'video/mp4'),
                        named_struct('url', concat('a', doc_id), 'mime_type', 'audio/mpeg'))
      WHEN 2 THEN array(named_struct('url', concat('n', doc_id), 'mime_type', CAST(NULL AS STRING)),
                        named_struct('url', concat('x', doc_id), 'mime_type', 'audio/ogg'),
                        named_struct('url', concat('y', doc_id), 'mime_type', 'audio/wav'))
      ELSE CAST(NULL AS ARRAY<STRUCT<url: STRING, mime_type: STRING>>) END"""


@query(
    "audio_enclosures",
    """SELECT doc_id AS entry_id,
              CASE doc_id % 4 WHEN 1 THEN 'a' || doc_id WHEN 2 THEN 'x' || doc_id END AS audio_url
       FROM documents""",
)
def audio_enclosures(v: ReaderViews) -> DataFrame:
    audio = entries.audio_enclosure(F.expr(_ENCLOSURES))
    return v.table("documents").select(
        F.col("doc_id").alias("entry_id"), audio["url"].alias("audio_url")
    )


_SUMMARY_SQL = """
    SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN 'old ' || t WHEN 1 THEN 'd' || t WHEN 2 THEN 'e' || t END AS summary
    FROM (SELECT entry_id, max(turn) AS t FROM v_snapshots GROUP BY 1) WHERE entry_id % 4 <> 3"""


@query(
    "digest",
    f"""WITH today AS (
          SELECT e.entry_id, e.feed_id, e.published_at, coalesce(c.priority = 1, false) AS must_read
          FROM v_entries e LEFT JOIN v_feed_config c USING (feed_id)
          WHERE e.status = 'unread' AND e.published_at > TIMESTAMP '2024-01-30 00:00:00'),
        shown AS (
          SELECT * FROM today WHERE must_read
          UNION ALL (SELECT * FROM today WHERE NOT must_read ORDER BY published_at DESC, entry_id LIMIT 20))
        SELECT shown.*, coalesce(summary, '') AS summary FROM shown LEFT JOIN ({_SUMMARY_SQL}) USING (entry_id)""",
)
def daily_digest(v: ReaderViews) -> DataFrame:
    out = digest.daily_digest(v.entries(), v.feed_config(), v.snapshots(), AS_OF)
    return out.select("entry_id", "feed_id", "published_at", "must_read", "summary")


@query("chosen_summaries", _SUMMARY_SQL)
def chosen_summaries(v: ReaderViews) -> DataFrame:
    return digest.chosen_summaries(v.snapshots())


@query(
    "named_summaries",
    """WITH last AS (SELECT entry_id, max(turn) AS t FROM v_snapshots GROUP BY 1),
       s AS (
         SELECT entry_id, 'default' AS prompt_id, CASE entry_id % 4 WHEN 1 THEN 'd' || t WHEN 0 THEN 'old ' || t ELSE 'old' END AS summary
         FROM last WHERE entry_id % 4 <> 3
         UNION ALL SELECT entry_id, 'eli5', 'e' || t FROM last WHERE entry_id % 4 IN (1, 2)
         UNION ALL SELECT entry_id, 'skeptic', 's' || t FROM last WHERE entry_id % 4 = 2)
       SELECT entry_id, prompt_id, summary,
              CASE prompt_id WHEN 'default' THEN 'Concise' WHEN 'eli5' THEN 'ELI5' ELSE 'Skeptic''s take' END AS name
       FROM s""",
)
def named_summaries(v: ReaderViews) -> DataFrame:
    from articleflow.operators.prompts import builtin_prompts

    return digest.summaries_of(v.snapshots(), builtin_prompts(v.spark))


@query(
    "stored_summaries",
    """SELECT entry_id, version,
              CASE entry_id % 4 WHEN 0 THEN 'old ' || turn WHEN 2 THEN 'old' END AS summary,
              CASE entry_id % 4 WHEN 1 THEN 'd' || turn END AS default_summary,
              CASE WHEN version = 1 THEN 'new ' || entry_id WHEN entry_id % 4 IN (1, 2) THEN 'e' || turn END AS eli5_summary
       FROM v_snapshots""",
)
def stored_summaries(v: ReaderViews) -> DataFrame:
    """A generated summary is merged into the first version of every entry."""
    new = (
        v.snapshots()
        .where("version = 1")
        .selectExpr("entry_id", "version", "map('eli5', concat('new ', entry_id)) AS summaries")
    )
    out = digest.store_summary(v.snapshots(), new)
    return out.select(
        "entry_id",
        "version",
        F.get_json_object("metadata", "$.summary").alias("summary"),
        F.get_json_object("metadata", "$.summaries.default").alias("default_summary"),
        F.get_json_object("metadata", "$.summaries.eli5").alias("eli5_summary"),
    )


@query(
    "rule_matches_many",
    """SELECT entry_id, c_custkey AS filter_id, CASE WHEN c_custkey % 2 = 0 THEN 'star' ELSE 'mark_read' END AS action
       FROM v_entries JOIN customer
         ON contains(url, '/a/' || c_custkey) AND NOT contains(lower(title), substring(lower(c_mktsegment), 1, 2))""",
)
def rule_matches_many(v: ReaderViews) -> DataFrame:
    """A saved filter for every customer, kept as a table."""
    rule = "named_struct('field', '{}', 'op', '{}', 'value', {})"
    url = rule.format("url", "contains", "concat('/A/', c_custkey)")
    title = rule.format("title", "not_contains", "substring(c_mktsegment, 1, 2)")
    filters = v.table("customer").selectExpr(
        "c_custkey AS id", f"array({url}, {title}) AS rules", "IF(c_custkey % 2 = 0, 'star', 'mark_read') AS auto_action"
    )
    return rules.match_filter_table(v.entries(), filters)
