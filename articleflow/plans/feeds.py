"""Queries: feeds, health, settings, discovery, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions import feedtext
from articleflow.operators import discovery, feeds, rules, sharing, sitesettings, state
from articleflow.operators.sizing import spread
from articleflow.plans.registry import AS_OF_SQL, query
from articleflow.sources import outline, tables
from articleflow.sources.feedxml import parse_feed_items
from articleflow.session import work_folder
from articleflow.sources.readerviews import ReaderViews, as_of


@query(
    "feed_overview",
    """SELECT f.feed_id, f.title, coalesce(c.priority, 2) AS priority,
              coalesce(c.fetch_full_content, false) AS fetch_full_content,
              coalesce(e.unread, 0) AS unread, e.latest
       FROM v_feeds f LEFT JOIN v_feed_config c USING (feed_id)
       LEFT JOIN (SELECT feed_id, count(*) FILTER (WHERE status = 'unread') AS unread, max(published_at) AS latest
                  FROM v_entries GROUP BY 1) e USING (feed_id)""",
)
def feed_overview(v: ReaderViews) -> DataFrame:
    out = feeds.overview(v.feeds(), v.feed_config(), v.entries())
    return out.select("feed_id", "title", "priority", "fetch_full_content", "unread", "latest")


@query(
    "feed_search",
    "SELECT feed_id, title FROM v_feeds WHERE contains(lower(title || ' ' || feed_url || ' ' || site_url), 'src1')",
)
def feed_search(v: ReaderViews) -> DataFrame:
    return feeds.search_feeds(v.feeds(), "SRC1").select("feed_id", "title")


_UNREAD = "SELECT feed_id, count(*) AS unread FROM v_entries WHERE status = 'unread' GROUP BY 1"


@query(
    "category_rollup",
    f"""SELECT c.category_id, c.title, count(f.feed_id) AS feeds, CAST(coalesce(sum(u.unread), 0) AS BIGINT) AS unread
        FROM v_categories c LEFT JOIN v_feeds f USING (category_id) LEFT JOIN ({_UNREAD}) u ON u.feed_id = f.feed_id
        GROUP BY 1, 2""",
)
def category_rollup(v: ReaderViews) -> DataFrame:
    return feeds.category_rollup(v.categories(), v.feeds(), v.entries())


@query(
    "category_feeds",
    f"""SELECT c.category_id, c.title, f.feed_id, f.title AS feed_title, coalesce(u.unread, 0) AS unread
        FROM v_categories c LEFT JOIN v_feeds f USING (category_id) LEFT JOIN ({_UNREAD}) u ON u.feed_id = f.feed_id""",
)
def category_feeds(v: ReaderViews) -> DataFrame:
    return feeds.category_feeds(v.categories(), v.feeds(), v.entries())


_BUCKET_SQL = """CASE
      WHEN m = '' THEN ''
      WHEN contains(m, 'not found') AND contains(m, 'resource') THEN 'http_404'
      WHEN contains(m, 'Unable to detect feed format') THEN 'not_a_feed'
      WHEN contains(m, 'bot protection') OR contains(m, 'forbidden') THEN 'bot_blocked'
      WHEN contains(m, 'server error') THEN 'server_5xx'
      WHEN contains(m, 'not authorized') OR contains(m, 'bad username') THEN 'auth'
      WHEN contains(m, 'TLS') OR contains(m, 'tls:') THEN 'tls'
      WHEN contains(lower(m), 'unsupported') THEN 'unsupported_scheme'
      WHEN contains(m, 'dial tcp') AND contains(m, 'lookup') THEN 'dns_fail'
      WHEN contains(m, 'dial tcp') THEN 'connect_fail'
      ELSE 'other' END"""

_HEALTH = f"""
    SELECT *, CASE WHEN disabled THEN 'paused' WHEN m <> '' THEN {_BUCKET_SQL}
                   WHEN checked_ago > 86400 THEN 'stale' ELSE 'ok' END AS bucket
    FROM (SELECT *, parsing_error_message AS m,
                 CAST(epoch({AS_OF_SQL}) - epoch(checked_at) AS DOUBLE) AS checked_ago FROM v_feeds)"""


@query(
    "error_buckets",
    f"""SELECT bucket, count(*) AS messages FROM (
          SELECT {_BUCKET_SQL} AS bucket FROM (
            SELECT CASE event_id % 14 WHEN 0 THEN 'resource not found' WHEN 1 THEN 'Unable to detect feed format here'
              WHEN 2 THEN 'bot protection: forbidden' WHEN 3 THEN 'internal server error' WHEN 4 THEN 'bad username'
              WHEN 5 THEN 'remote TLS failure' WHEN 6 THEN 'UNSUPPORTED thing' WHEN 7 THEN 'dial tcp: lookup x'
              WHEN 8 THEN 'dial tcp: refused' WHEN 9 THEN 'not found' WHEN 10 THEN '' WHEN 11 THEN 'tls: x forbidden'
              WHEN 12 THEN 'DIAL TCP' ELSE event_type END AS m FROM events)) GROUP BY 1""",
)
def error_buckets(v: ReaderViews) -> DataFrame:
    message = F.expr(
        """CASE event_id % 14 WHEN 0 THEN 'resource not found' WHEN 1 THEN 'Unable to detect feed format here'
           WHEN 2 THEN 'bot protection: forbidden' WHEN 3 THEN 'internal server error' WHEN 4 THEN 'bad username'
           WHEN 5 THEN 'remote TLS failure' WHEN 6 THEN 'UNSUPPORTED thing' WHEN 7 THEN 'dial tcp: lookup x'
           WHEN 8 THEN 'dial tcp: refused' WHEN 9 THEN 'not found' WHEN 10 THEN '' WHEN 11 THEN 'tls: x forbidden'
           WHEN 12 THEN 'DIAL TCP' ELSE event_type END"""
    )
    return (
        v.table("events")
        .select(feedtext.error_bucket(message).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


_REMEDY_SQL = """CASE bucket WHEN 'http_404' THEN 'auto-discover' WHEN 'not_a_feed' THEN 'auto-discover'
      WHEN 'bot_blocked' THEN 'set-proxy' WHEN 'server_5xx' THEN 'bulk-refresh' WHEN 'tls' THEN 'allow-self-signed'
      WHEN 'unsupported_scheme' THEN 'pause-polling' WHEN 'dns_fail' THEN 'pause-polling'
      WHEN 'connect_fail' THEN 'pause-polling' WHEN 'other' THEN 'pause-polling' WHEN 'paused' THEN 'resume-polling' END"""


@query(
    "feed_health",
    f"""SELECT feed_id, title, bucket, checked_ago, m <> '' AS has_error, parsing_error_count >= 3 AS is_persistent,
               checked_ago > 86400 AS is_stale, count(*) OVER (PARTITION BY bucket) AS bucket_size,
               CAST(list_position(['http_404','not_a_feed','bot_blocked','server_5xx','auth','tls','unsupported_scheme',
                 'dns_fail','connect_fail','other','stale','paused','ok'], bucket) AS INTEGER) AS bucket_rank,
               {_REMEDY_SQL} AS remedy
        FROM ({_HEALTH})""",
)
def feed_health(v: ReaderViews) -> DataFrame:
    return feeds.health_sections(v.feeds(), as_of()).select(
        "feed_id", "title", "bucket", "checked_ago", "has_error", "is_persistent", "is_stale",
        "bucket_size", "bucket_rank", "remedy",
    )


@query(
    "feed_health_summary",
    f"""SELECT count(*) FILTER (WHERE parsing_error_count >= 3) AS persistent,
               count(*) FILTER (WHERE parsing_error_count < 3 AND m <> '') AS transient,
               count(*) FILTER (WHERE parsing_error_count < 3 AND m = '' AND checked_ago > 86400) AS stale
        FROM ({_HEALTH}) WHERE NOT disabled""",
)
def feed_health_summary(v: ReaderViews) -> DataFrame:
    return feeds.health_summary(v.feeds(), as_of())


@query(
    "feed_icons",
    """SELECT s_suppkey AS feed_id, 'image/' || p_type AS mime_type, CAST(octet_length(encode(p_name)) AS INTEGER) AS bytes
       FROM supplier JOIN part ON p_partkey = s_suppkey * 3""",
)
def feed_icons(v: ReaderViews) -> DataFrame:
    links = v.table("supplier").selectExpr("s_suppkey AS feed_id", "s_suppkey * 3 AS icon_id")
    icons = v.table("part").selectExpr(
        "p_partkey AS id", "CAST(p_name AS BINARY) AS content", "concat('image/', p_type) AS mime_type"
    )
    out = feeds.icons_of(links, icons)
    return out.select("feed_id", "mime_type", F.octet_length("content").alias("bytes"))


@query(
    "feed_settings",
    f"""SELECT h.feed_id, h.bucket, coalesce(c.priority, 2) AS priority,
               coalesce(c.fetch_full_content, false) AS fetch_full_content,
               u.old_url, u.new_url, u.source AS change_source, u.changed_at
        FROM ({_HEALTH}) h LEFT JOIN v_feed_config c USING (feed_id) LEFT JOIN v_url_history u USING (feed_id)""",
)
def feed_settings(v: ReaderViews) -> DataFrame:
    out = feeds.feed_settings(v.feeds(), v.feed_config(), v.url_history(), as_of())
    return out.select(
        "feed_id", "bucket", "priority", "fetch_full_content", "old_url", "new_url", "change_source", "changed_at"
    )


@query("url_history", "SELECT feed_id, old_url, new_url, source, changed_at FROM v_url_history")
def url_history(v: ReaderViews) -> DataFrame:
    return feeds.url_history(v.url_history())


@query(
    "url_change_log",
    """SELECT event_id, old_url, new_url FROM (
         SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE 'u' || user_id END AS old_url,
                'u' || (event_id % 7) AS new_url FROM events)
       WHERE old_url <> '' AND old_url <> new_url""",
)
def url_change_log(v: ReaderViews) -> DataFrame:
    asked = v.table("events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE concat('u', user_id) END AS old_url",
        "concat('u', event_id % 7) AS new_url",
    )
    return feeds.url_changes(asked)


@query(
    "url_history_resolve",
    """WITH RECURSIVE chain AS (
         SELECT old_url, new_url AS current_url, feed_id, changed_at, 1 AS hops FROM v_url_history
         UNION ALL
         SELECT c.old_url, h.new_url, h.feed_id, h.changed_at, c.hops + 1
         FROM chain c JOIN v_url_history h ON h.old_url = c.current_url AND h.changed_at > c.changed_at)
       SELECT old_url, arg_max(current_url, hops) AS current_url, arg_max(feed_id, hops) AS feed_id,
              CAST(max(hops) AS INTEGER) AS hops FROM chain GROUP BY 1""",
)
def url_history_resolve(v: ReaderViews) -> DataFrame:
    return feeds.resolve_addresses(v.url_history())


@query(
    "posts_by_old_address",
    """WITH RECURSIVE chain AS (
         SELECT old_url, new_url, feed_id, changed_at, 1 AS hops FROM v_url_history
         UNION ALL
         SELECT c.old_url, h.new_url, h.feed_id, h.changed_at, c.hops + 1
         FROM chain c JOIN v_url_history h ON h.old_url = c.new_url AND h.changed_at > c.changed_at),
       former AS (SELECT old_url, arg_max(feed_id, hops) AS feed_id FROM chain GROUP BY 1),
       posts AS (SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://old.example.com/' || o_custkey
                   ELSE 'https://src' || (o_custkey % 30) || '.example.com/feed.xml' END AS feed_url FROM orders)
       SELECT post_id, p.feed_url, coalesce(f.feed_id, former.feed_id) AS feed_id
       FROM posts p LEFT JOIN v_feeds f ON f.feed_url = p.feed_url LEFT JOIN former ON former.old_url = p.feed_url""",
)
def posts_by_old_address(v: ReaderViews) -> DataFrame:
    posts = v.table("orders").selectExpr(
        "o_orderkey AS post_id",
        "IF(o_orderkey % 2 = 0, concat('https://old.example.com/', o_custkey), concat('https://src', o_custkey % 30, '.example.com/feed.xml')) AS feed_url",
    )
    return feeds.posts_by_old_address(posts, v.feeds(), v.url_history())


@query(
    "author_titles",
    """WITH a AS (SELECT feed_id, arg_max(author, published_at) AS author FROM (
                    SELECT feed_id, author, published_at FROM v_entries
                    QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, entry_id) = 1) GROUP BY 1)
       SELECT feed_id, title AS old_title, CASE WHEN feed_id % 2 = 0 THEN author ELSE 'Jo Src' || feed_id END || ' | ' || title AS new_title, true AS renamed
       FROM v_feeds JOIN a USING (feed_id) WHERE contains(feed_url, '/author/')""",
)
def author_titles(v: ReaderViews) -> DataFrame:
    """Entries of odd feeds have no author here, so the name in the address is used."""
    unsigned = v.entries().withColumn(
        "author", F.when(F.col("feed_id") % 2 == 0, F.col("author")).otherwise(F.lit(""))
    )
    return feeds.author_titles(v.feeds(), unsigned)


@query("known_feeds", "SELECT feed_id, title FROM v_feeds WHERE feed_id IN (SELECT user_id FROM events)")
def known_feeds(v: ReaderViews) -> DataFrame:
    wanted = v.table("events").select(F.col("user_id").alias("feed_id"))
    return discovery.known_feeds(wanted, v.feeds()).select("feed_id", "title")


@query(
    "fetch_resolution",
    """WITH won AS (SELECT url, stage, body FROM v_fetch_attempts WHERE ok
                    QUALIFY row_number() OVER (PARTITION BY url ORDER BY stage, body NULLS LAST) = 1)
       SELECT p.url, CAST(won.stage AS INTEGER) AS stage, md5(won.body) AS body_md5
       FROM pages p LEFT JOIN won USING (url)""",
)
def fetch_resolution(v: ReaderViews) -> DataFrame:
    out = discovery.resolve_fetch(v.table("pages").select("url"), v.fetch_attempts())
    return out.select("url", "stage", F.md5("body").alias("body_md5"))


_LINKED = """replace(html, '<head>', concat('<head>',
    '<link rel="alternate" type="application/rss+xml" href="/rss/', page_id, '" title=" Main ">',
    '<link rel="feed" type="text/html" href="https://x.example.org/atom.xml">',
    '<link rel="alternate" type="application/rss+xml" href="/rss/', page_id, '" title="again">',
    '<link rel="stylesheet" href="/feed.css">',
    '<link rel="alternate" hreflang="de" href="/de">',
    IF(page_id % 3 = 0, '<link rel="alternate" type="application/json" href="data/feed.json">', '')))"""


def _linked_pages(v: ReaderViews) -> DataFrame:
    return v.table("pages").selectExpr("url", f"{_LINKED} AS html")


_BASE = "regexp_extract(url, '^https?://[^/]+')"
_DIR = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/(?:.*/)?')"
_LINKS_SQL = f"""
    SELECT DISTINCT url, feed_url, title, type FROM (
      SELECT url, {_BASE} || '/rss/' || page_id AS feed_url, 'Main' AS title, 'rss' AS type FROM pages
      UNION ALL SELECT url, 'https://x.example.org/atom.xml', '', 'atom' FROM pages
      UNION ALL SELECT url, {_DIR} || 'data/feed.json', '', 'json' FROM pages WHERE page_id % 3 = 0)"""


@query("feed_links", f"SELECT url, feed_url, title, type FROM ({_LINKS_SQL})")
def feed_links(v: ReaderViews) -> DataFrame:
    return discovery.discover_links(_linked_pages(v)).select("url", "feed_url", "title", "type")


@query(
    "raw_links",
    """SELECT rel, link_type, count(*) AS links FROM (
         SELECT 'alternate' AS rel, 'application/rss+xml' AS link_type FROM pages
         UNION ALL SELECT 'feed', 'text/html' FROM pages UNION ALL SELECT 'alternate', 'application/rss+xml' FROM pages
         UNION ALL SELECT 'alternate', '' FROM pages
         UNION ALL SELECT 'alternate', 'application/json' FROM pages WHERE page_id % 3 = 0) GROUP BY 1, 2""",
)
def raw_links(v: ReaderViews) -> DataFrame:
    links = discovery.raw_links(_linked_pages(v))
    return links.groupBy("rel", "link_type").agg(F.count(F.lit(1)).alias("links"))


def _probe_inputs(v: ReaderViews) -> tuple[DataFrame, DataFrame]:
    """Every page is the site of one feed; its fetch attempts carry the page with links."""
    sites = v.table("pages").selectExpr(
        "page_id AS feed_id",
        "concat('Feed ', page_id) AS title",
        f"IF(page_id % 4 = 0, concat(regexp_extract(url, '^https?://[^/]+', 0), '/rss/', page_id), 'https://gone.example.org/f') AS feed_url",
        "IF(page_id % 10 = 9, NULL, url) AS site_url",
    )
    linked = v.table("pages").selectExpr(
        "page_id", "url", f"IF(page_id % 7 = 3, html, {_LINKED}) AS html"
    )
    attempts = linked.withColumn("stage", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(
        "url", "stage", "(page_id + stage) % 5 > 2 AS ok", "html AS body"
    )
    return sites, attempts


_OUTCOME_SQL = f"""
    SELECT page_id AS feed_id,
           CASE WHEN page_id % 10 = 9 OR got IS NULL THEN 'fetch_failed'
                WHEN got % 7 = 3 THEN 'no_candidate'
                WHEN page_id % 4 = 0 AND got = page_id THEN 'same' ELSE 'candidate' END AS outcome,
           CASE WHEN page_id % 10 <> 9 AND got % 7 <> 3 THEN {_BASE} || '/rss/' || got END AS new_url
    FROM pages LEFT JOIN (
      SELECT url, page_id AS got FROM pages, (VALUES (1), (2)) AS t(stage) WHERE (page_id + stage) % 5 > 2
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY stage, IF(page_id % 7 = 3, html, {_LINKED}) NULLS LAST) = 1) USING (url)"""


@query("discovery_outcomes", _OUTCOME_SQL)
def discovery_outcomes(v: ReaderViews) -> DataFrame:
    out = discovery.discovery_outcomes(*_probe_inputs(v))
    return out.select("feed_id", "outcome", "new_url")


@query(
    "discovery_counts",
    f"""SELECT count(*) FILTER (WHERE outcome = 'candidate') AS candidates, count(*) FILTER (WHERE outcome = 'same') AS same,
               count(*) FILTER (WHERE outcome = 'no_candidate') AS no_candidate,
               count(*) FILTER (WHERE outcome = 'fetch_failed') AS fetch_failed FROM ({_OUTCOME_SQL})""",
)
def discovery_counts(v: ReaderViews) -> DataFrame:
    return discovery.outcome_counts(discovery.discovery_outcomes(*_probe_inputs(v)))


@query(
    "candidate_sources",
    f"""SELECT url, 'https://svc.example.org/' || page_id AS feed_url, 'svc' AS title,
               CASE page_id % 4 WHEN 0 THEN 'atom' ELSE 'unknown' END AS type, 'service' AS source
        FROM pages WHERE page_id % 2 = 0
        UNION ALL
        SELECT l.url, l.feed_url, l.title, l.type, 'parsed' FROM ({_LINKS_SQL}) l
        WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 2 = 0 AND p.url = l.url)""",
)
def candidate_sources(v: ReaderViews) -> DataFrame:
    service = v.table("pages").where("page_id % 2 = 0").selectExpr(
        "url", "concat('https://svc.example.org/', page_id) AS feed_url", "'svc' AS title",
        "IF(page_id % 4 = 0, 'ATOM', NULL) AS type",
    )
    return discovery.candidate_sources(service, discovery.discover_links(_linked_pages(v)))


_BODIES = """CASE doc_id % 10
    WHEN 0 THEN concat('<?xml version="1.0"?>\n<rss version="2.0"><channel><title>', title, '</title></channel></rss>')
    WHEN 1 THEN concat('<!-- c --><a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>', title, '</a:title></a:feed> ')
    WHEN 2 THEN concat('<rdf:RDF xmlns:rdf="http://x"><item>', title, '</item></rdf:RDF>')
    WHEN 3 THEN concat('{"version": "https://jsonfeed.org/version/1.1", "title": "t', doc_id, '"}')
    WHEN 4 THEN concat('{"version": 3, "title": "t', doc_id, '"}')
    WHEN 5 THEN concat('<!DOCTYPE html><html><body>', title, ' rss</body></html>')
    WHEN 6 THEN ''
    WHEN 7 THEN concat('<rss><channel><title>', title, '</title></channel>')
    WHEN 8 THEN concat('{"version": "jsonfeed.org', title)
    ELSE title END"""


def _bodies(v: ReaderViews) -> DataFrame:
    clean = "regexp_replace(text, '[^A-Za-z ]', ' ') AS title"
    return v.table("documents").selectExpr("doc_id", clean).selectExpr("doc_id", f"{_BODIES} AS body")


@query("looks_like_feed", "SELECT doc_id, doc_id % 10 IN (0, 1, 2, 3) AS is_feed FROM documents")
def looks_like_feed(v: ReaderViews) -> DataFrame:
    return _bodies(v).select("doc_id", feedtext.looks_like_feed(F.col("body")).alias("is_feed"))


@query(
    "feed_types",
    """SELECT type, count(*) AS links FROM (
         SELECT CASE WHEN contains(t, 'atom') THEN 'atom' WHEN contains(t, 'json') THEN 'json'
                     WHEN contains(t, 'rss') OR contains(t, 'xml') THEN 'rss' WHEN contains(h, 'atom') THEN 'atom'
                     WHEN h LIKE '%.json' OR contains(h, 'feed.json') THEN 'json'
                     WHEN contains(h, 'rss') OR h LIKE '%.xml' OR contains(h, '/feed') THEN 'rss' ELSE 'unknown' END AS type
         FROM (SELECT ['', 'application/atom+xml', 'application/rss+xml', 'text/xml', 'application/json'][1 + event_id % 5] AS t,
                      ['/atom', '/a.json', '/feed.json?x', '/rss', '/a.xml', '/feed', '/page'][1 + event_id % 7] AS h FROM events))
       GROUP BY 1""",
)
def feed_types(v: ReaderViews) -> DataFrame:
    kind = feedtext.feed_type(F.col("t"), F.col("h"))
    return (
        v.table("events")
        .selectExpr(
            "array('', ' Application/Atom+xml', 'application/rss+xml', 'text/xml', 'application/json')[event_id % 5] AS t",
            "array('/Atom', '/a.json', '/feed.json?x', '/RSS', '/a.xml', '/feed', '/page')[event_id % 7] AS h",
        )
        .groupBy(kind.alias("type"))
        .agg(F.count(F.lit(1)).alias("links"))
    )


@query(
    "url_routes",
    """SELECT doc_id AS feed_id, CASE WHEN doc_id % 11 = 0 THEN 'invalid' WHEN doc_id % 13 = 0 THEN 'no_change'
              WHEN doc_id % 10 IN (0, 1, 2, 3) AND doc_id % 4 <> 3 THEN 'update' ELSE 'discover' END AS route
       FROM documents""",
)
def url_routes(v: ReaderViews) -> DataFrame:
    """One requested change per document; a quarter of the addresses cannot be fetched."""
    known = v.table("documents").selectExpr("doc_id AS feed_id", "concat('https://f.example.org/', doc_id) AS feed_url")
    asked = v.table("documents").selectExpr(
        "doc_id AS feed_id",
        """CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 13 = 0 THEN concat('https://f.example.org/', doc_id)
           ELSE concat(' https://new.example.org/', doc_id) END AS new_url""",
    )
    attempts = _bodies(v).selectExpr(
        "concat('https://new.example.org/', doc_id) AS url", "1 AS stage", "doc_id % 4 <> 3 AS ok", "body"
    )
    return discovery.route_url_changes(asked, known, attempts).select("feed_id", "route")


@query(
    "apply_discovered",
    """WITH u AS (SELECT doc_id, doc_id % 25 AS feed_id, 'https://new.example.org/' || doc_id AS new_url,
                     CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id END AS new_title,
                     CASE WHEN doc_id % 7 = 0 THEN 'https://s.example.org/' || doc_id END AS new_site_url
              FROM documents),
       l AS (SELECT feed_id, arg_max(new_url, doc_id) AS new_url,
                    arg_max(new_title, doc_id) FILTER (WHERE new_title IS NOT NULL) AS new_title,
                    arg_max(new_site_url, doc_id) FILTER (WHERE new_site_url IS NOT NULL) AS new_site_url FROM u GROUP BY 1)
       SELECT f.feed_id, coalesce(new_url, feed_url) AS feed_url, coalesce(new_title, title) AS title,
              coalesce(new_site_url, site_url) AS site_url FROM v_feeds f LEFT JOIN l USING (feed_id)""",
)
def apply_discovered(v: ReaderViews) -> DataFrame:
    """Many partial updates per feed, some with blank values."""
    updates = v.table("documents").selectExpr(
        "doc_id % 25 AS feed_id",
        "doc_id AS at",
        "concat('https://new.example.org/', doc_id) AS new_url",
        "IF(doc_id % 3 = 0, concat(' T', doc_id), '  ') AS new_title",
        "IF(doc_id % 7 = 0, concat('https://s.example.org/', doc_id), NULL) AS new_site_url",
    )
    return state.apply_discovered(v.feeds(), updates).select("feed_id", "feed_url", "title", "site_url")


@query(
    "feed_items",
    """WITH lines AS (
         SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z' || chr(10) || ' ]', '', 'g'), chr(10)) AS l FROM documents WHERE doc_id % 10 <> 9)
       SELECT 'd' || doc_id AS url, CAST(pos AS INTEGER) AS pos, trim(line) AS title, published FROM (
         SELECT doc_id, line, published, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
           SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i,
                  CASE WHEN generate_subscripts(l, 1) % 2 = 0 THEN 'day ' || generate_subscripts(l, 1) ELSE '' END AS published FROM lines)
         WHERE trim(line) <> '' OR published <> '')
       WHERE pos <= 3""",
)
def feed_items(v: ReaderViews) -> DataFrame:
    """Each document's lines as items of a feed, RSS or Atom in turn; some are cut off."""
    lines = "split(regexp_replace(text, '[^A-Za-z\\n ]', ''), '\\n')"
    item = """transform({lines}, (line, i) -> concat('<', tag, '><title>', line, '</title>',
                IF(i % 2 = 1, concat('<', dt, '>day ', i + 1, '</', dt, '>'), ''), '</', tag, '>'))"""
    bodies = spread(v.table("documents")).selectExpr(
        "doc_id", "text", "IF(doc_id % 2 = 0, 'item', 'entry') AS tag", "IF(doc_id % 2 = 0, 'pubDate', 'updated') AS dt"
    ).selectExpr(
        "concat('d', doc_id) AS url",
        f"""concat(IF(doc_id % 2 = 0, '<rss><channel>', '<feed xmlns="http://www.w3.org/2005/Atom">'),
             array_join({item.format(lines=lines)}, ''),
             IF(doc_id % 10 = 9, '', IF(doc_id % 2 = 0, '</channel></rss>', '</feed>'))) AS body""",
    )
    return parse_feed_items(bodies)


_OUTLINE_SQL = """
    SELECT f.title, f.feed_url, f.site_url, c.title AS category
    FROM v_feeds f LEFT JOIN v_categories c USING (category_id)"""


@query("outline_roundtrip", _OUTLINE_SQL)
def outline_roundtrip(v: ReaderViews) -> DataFrame:
    """The feed list written as an outline file and read back."""
    path = f"{work_folder(v.spark)}/feeds.opml"
    outline.write_outline(outline.outline_lines(v.feeds(), v.categories()), path)
    return outline.read_outline(v.spark, path)


@query(
    "outline_export",
    """WITH f AS (SELECT f.*, c.title AS cat FROM v_feeds f JOIN v_categories c USING (category_id))
       SELECT '    <outline type="rss" text="' || title || '" title="' || title || '" xmlUrl="' || feed_url
              || '" htmlUrl="' || site_url || '"/>' AS line FROM f
       UNION ALL SELECT DISTINCT '  <outline text="' || cat || '">' FROM f
       UNION ALL SELECT '  </outline>' FROM (SELECT DISTINCT cat FROM f)
       UNION ALL SELECT '<?xml version="1.0" encoding="UTF-8"?>'
       UNION ALL SELECT '<opml version="2.0"><head><title>Feeds</title></head><body>'
       UNION ALL SELECT '</body></opml>'""",
)
def outline_export(v: ReaderViews) -> DataFrame:
    return outline.ordered_lines(outline.outline_lines(v.feeds(), v.categories())).select("line")


_FILTERS = [
    rules.SavedFilter(1, "english", rules.parse_rules('[{"field":"author","op":"equals","value":"EN"},{"field":"content","op":"contains","value":"The"}]'), "mark_read"),
    rules.SavedFilter(2, "www", rules.parse_rules('[{"field":"url","op":"starts_with","value":"https://WWW."},{"field":"title","op":"not_contains","value":"on"}]'), "star"),
    rules.SavedFilter(3, "odd rule", rules.parse_rules('[{"field":"nowhere","op":"equals","value":""},{"field":"author","op":"matches","value":"x"},{"field":"feed_title","op":"contains","value":"src1"}]'), "star"),
    rules.SavedFilter(4, "no rules", (), "star"),
    rules.SavedFilter(5, "no action", rules.parse_rules('[{"field":"title","op":"contains","value":"a"}]'), None),
]

_MATCH_SQL = """
    SELECT entry_id, CAST(1 AS BIGINT) AS filter_id, 'mark_read' AS action FROM v_entries
    WHERE lower(author) = 'en' AND contains(lower(content), 'the')
    UNION ALL SELECT entry_id, 2, 'star' FROM v_entries
    WHERE starts_with(lower(url), 'https://www.') AND NOT contains(lower(title), 'on')
    UNION ALL SELECT entry_id, 3, 'star' FROM v_entries WHERE contains('feed src' || feed_id, 'src1')"""


def _rule_entries(v: ReaderViews) -> DataFrame:
    return v.entries().withColumn("feed_title", F.concat(F.lit("Feed src"), F.col("feed_id")))


@query("rule_matches", _MATCH_SQL)
def rule_matches(v: ReaderViews) -> DataFrame:
    return rules.match_filters(_rule_entries(v), _FILTERS)


@query("rule_matches_table", _MATCH_SQL)
def rule_matches_table(v: ReaderViews) -> DataFrame:
    """The same filters held as data, as for a large number of them."""
    return rules.match_filters(_rule_entries(v), _FILTERS, compiled_up_to=0)


@query(
    "rule_actions",
    f"""WITH m AS ({_MATCH_SQL})
        SELECT entry_id, CASE WHEN bool_or(coalesce(action = 'mark_read', false)) THEN 'read' ELSE any_value(status) END AS status,
               any_value(starred) OR bool_or(coalesce(action = 'star', false)) AS starred
        FROM v_entries LEFT JOIN m USING (entry_id) GROUP BY 1""",
)
def rule_actions(v: ReaderViews) -> DataFrame:
    hits = rules.match_filters(_rule_entries(v), _FILTERS)
    actions = rules.filter_actions(hits, as_of())
    current = v.entries().select("entry_id", "status", "starred")
    return state.apply_actions(current, actions, "entry_id")


@query(
    "action_fold",
    """WITH s AS (SELECT entry_id AS id, status, starred, false AS disabled FROM v_entries),
       w AS (SELECT id, arg_max(action, (ts, seq)) AS last_status FROM v_actions WHERE action IN ('mark_read', 'mark_unread') GROUP BY 1),
       st AS (SELECT id, max((ts, seq)) AS at FROM v_actions WHERE action = 'star' GROUP BY 1),
       fl AS (SELECT a.id, count(*) AS n FROM v_actions a LEFT JOIN st USING (id)
              WHERE a.action = 'toggle_star' AND (st.at IS NULL OR (a.ts, a.seq) > st.at) GROUP BY 1),
       p AS (SELECT DISTINCT id FROM v_actions WHERE action = 'pause')
       SELECT s.id AS entry_id,
              CASE last_status WHEN 'mark_read' THEN 'read' WHEN 'mark_unread' THEN 'unread' ELSE status END AS status,
              (CASE WHEN st.id IS NOT NULL THEN true ELSE starred END) <> (coalesce(fl.n, 0) % 2 = 1) AS starred,
              p.id IS NOT NULL AS disabled
       FROM s LEFT JOIN w USING (id) LEFT JOIN st USING (id) LEFT JOIN fl USING (id) LEFT JOIN p USING (id)""",
)
def action_fold(v: ReaderViews) -> DataFrame:
    current = v.entries().select("entry_id", "status", "starred", F.lit(False).alias("disabled"))
    return state.apply_actions(current, v.actions(), "entry_id")


@query(
    "bulk_result",
    "SELECT count(*) FILTER (WHERE ok) AS ok, count(*) AS total FROM v_fetch_attempts",
)
def bulk_result(v: ReaderViews) -> DataFrame:
    return state.bulk_result(v.fetch_attempts())


@query(
    "config_upsert",
    """WITH ch AS (SELECT user_id % 25 AS feed_id, event_id, ts,
                     CASE WHEN event_id % 3 = 1 THEN CAST(event_id % 9 AS INTEGER) - 2 END AS priority,
                     CASE WHEN event_id % 3 = 2 THEN event_id % 2 = 0 END AS full_text FROM events),
       last AS (SELECT feed_id, arg_max(priority, (ts, event_id)) FILTER (WHERE priority IS NOT NULL) AS priority,
                       arg_max(full_text, (ts, event_id)) FILTER (WHERE full_text IS NOT NULL) AS full_text FROM ch GROUP BY 1)
       SELECT coalesce(c.feed_id, l.feed_id) AS feed_id,
              coalesce(CASE WHEN l.priority IS NOT NULL THEN least(3, greatest(1, l.priority)) END, c.priority, 2) AS priority,
              coalesce(l.full_text, c.fetch_full_content, false) AS fetch_full_content
       FROM v_feed_config c FULL JOIN last l USING (feed_id)""",
)
def config_upsert(v: ReaderViews) -> DataFrame:
    changes = v.table("events").selectExpr(
        "user_id % 25 AS feed_id",
        "struct(ts, event_id) AS at",
        "IF(event_id % 3 = 1, CAST(event_id % 9 AS INT) - 2, NULL) AS priority",
        "IF(event_id % 3 = 2, event_id % 2 = 0, NULL) AS fetch_full_content",
    )
    return state.set_config(v.feed_config(), changes).select("feed_id", "priority", "fetch_full_content")


@query(
    "config_toggle",
    """SELECT coalesce(c.feed_id, a.feed_id) AS feed_id, coalesce(c.priority, 2) AS priority,
              coalesce(c.fetch_full_content, false) <> coalesce(a.n % 2 = 1, false) AS fetch_full_content
       FROM v_feed_config c FULL JOIN (SELECT user_id % 25 AS feed_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a USING (feed_id)""",
)
def config_toggle(v: ReaderViews) -> DataFrame:
    asked = v.table("events").where("event_type = 'click'").selectExpr("user_id % 25 AS feed_id")
    return state.toggled(v.feed_config(), asked).select("feed_id", "priority", "fetch_full_content")


@query(
    "upsert_latest",
    """SELECT entry_id, version, content_text FROM v_snapshots
       QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1""",
)
def upsert_latest(v: ReaderViews) -> DataFrame:
    """First versions as the stored table, all later ones as changes."""
    rows = v.snapshots().select("entry_id", "version", "content_text")
    return tables.upsert(rows.where("version = 1"), rows.where("version > 1"), ["entry_id"], [F.desc("version")])


@query(
    "insert_absent",
    """SELECT DISTINCT entry_id, tag FROM (
         SELECT doc_id AS entry_id, CASE WHEN n_chars > 1000 THEN 'long' ELSE lang END AS tag FROM documents
         UNION ALL SELECT doc_id, 'quality' FROM labels) n
       WHERE NOT EXISTS (SELECT 1 FROM v_tags t WHERE t.entry_id = n.entry_id AND t.tag = n.tag)""",
)
def insert_absent(v: ReaderViews) -> DataFrame:
    new = v.table("documents").selectExpr("doc_id AS entry_id", "IF(n_chars > 1000, 'long', lang) AS tag")
    again = v.table("labels").selectExpr("doc_id AS entry_id", "'quality' AS tag")
    return tables.insert_absent(v.tags(), new.unionByName(again), ["entry_id", "tag"])


@query("delete_by_key", "SELECT entry_id, feed_id FROM v_entries WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_key(v: ReaderViews) -> DataFrame:
    gone = v.table("labels").where("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    return tables.delete_keys(v.entries(), gone, ["entry_id"]).select("entry_id", "feed_id")


@query(
    "share_status",
    f"""WITH last AS (SELECT entry_id, content_html FROM v_snapshots
                      QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1)
        SELECT r.request_id, r.token,
               CASE WHEN l.token IS NULL THEN 'not_found' WHEN l.expires_at < {AS_OF_SQL} THEN 'expired' ELSE 'ok' END AS status,
               CASE WHEN l.token IS NOT NULL AND (l.expires_at IS NULL OR l.expires_at >= {AS_OF_SQL})
                    THEN md5(coalesce(s.content_html, e.content)) END AS content_md5
        FROM v_share_requests r LEFT JOIN v_share_links l USING (token)
        LEFT JOIN last s ON s.entry_id = l.entry_id LEFT JOIN v_entries e ON e.entry_id = l.entry_id""",
)
def share_status(v: ReaderViews) -> DataFrame:
    out = sharing.resolve_shares(v.share_requests(), v.share_links(), v.entries(), v.snapshots(), as_of())
    return out.select("request_id", "token", "status", F.md5("content").alias("content_md5"))


@query(
    "share_expiry",
    "SELECT o_orderkey AS entry_id, o_orderdate + INTERVAL 7 DAY AS expires_at FROM orders",
)
def share_expiry(v: ReaderViews) -> DataFrame:
    links = v.table("orders").selectExpr("o_orderkey AS entry_id", "CAST(o_orderdate AS TIMESTAMP_NTZ) AS created_at")
    return sharing.with_expiry(links).select("entry_id", "expires_at")


@query(
    "site_settings_lookup",
    """WITH u AS (SELECT entry_id, regexp_extract(url, '^https://([^/]+)', 1) AS h FROM v_entries)
       SELECT entry_id, coalesce(a.domain, b.domain) AS domain
       FROM u LEFT JOIN v_site_settings a ON a.domain = h
       LEFT JOIN v_site_settings b ON b.domain = regexp_replace(h, '^www\\.', '')""",
)
def site_settings_lookup(v: ReaderViews) -> DataFrame:
    urls = v.entries().select("entry_id", "url")
    return sitesettings.settings_for(urls, v.site_settings()).select("entry_id", "domain")


@query(
    "site_settings_list",
    """SELECT 'd' || c_custkey || '.example.com' AS domain, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS pairs
       FROM customer WHERE c_custkey % 4 <> 1""",
)
def site_settings_list(v: ReaderViews) -> DataFrame:
    """Settings texts: two keys, a repeated key, or none with a value."""
    raw = v.table("customer").selectExpr(
        "concat(' D', c_custkey, '.example.com ') AS domain",
        """CASE WHEN c_custkey % 4 = 1 THEN 'nothing; here' WHEN c_custkey % 3 = 0 THEN 'a=1; b=x=y;'
           ELSE concat('a=1;a=', c_custkey) END AS raw""",
    )
    return sitesettings.list_settings(sitesettings.parse_settings(raw))
