"""Queries: scalar functions over article text, addresses, vectors and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions import metadata, sqlnames, text, urls
from articleflow.operators import enrich, prompts
from articleflow.operators.sizing import spread
from articleflow.plans.registry import AS_OF_SQL, query
from articleflow.sources import markdown
from articleflow.sources.readerviews import ReaderViews, as_of

_EXCERPT_SQL = """
    CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substring(t, 1, 400), ' [^ ]*$', '') || '...' END"""


@query(
    "excerpt",
    f"""SELECT entry_id, {_EXCERPT_SQL} AS excerpt FROM (
          SELECT entry_id, trim(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM v_entries)""",
)
def excerpt(v: ReaderViews) -> DataFrame:
    return spread(v.entries()).select("entry_id", text.excerpt(F.col("content")).alias("excerpt"))


@query(
    "excerpt_html",
    f"""SELECT page_id, {_EXCERPT_SQL} AS excerpt FROM (
          SELECT page_id, trim(regexp_replace(
                   replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),
                     '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'),
                   '\\s+', ' ', 'g')) AS t FROM pages)""",
)
def excerpt_html(v: ReaderViews) -> DataFrame:
    return spread(v.table("pages")).select("page_id", text.excerpt(F.col("html")).alias("excerpt"))


@query(
    "reading_time",
    """SELECT entry_id, greatest(1, len(regexp_extract_all(content, '\\S+')) // 230) || ' min read' AS reading_time FROM v_entries""",
)
def reading_time(v: ReaderViews) -> DataFrame:
    return v.entries().select("entry_id", text.reading_time(F.col("content")).alias("reading_time"))


_AGO = """CASE
    WHEN s = 0 THEN 'now' WHEN s = 1 THEN 'a second' || d WHEN s < 60 THEN s || ' seconds' || d
    WHEN s < 120 THEN 'a minute' || d WHEN s < 3600 THEN (s // 60) || ' minutes' || d
    WHEN s < 7200 THEN 'an hour' || d WHEN s < 86400 THEN (s // 3600) || ' hours' || d
    WHEN s // 86400 = 1 THEN 'a day' || d ELSE (s // 86400) || ' days' || d END"""


@query(
    "timeago",
    f"""SELECT event_id, CASE WHEN gap >= 86400000000 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE {_AGO} END AS ago
        FROM (SELECT *, abs(gap) // 1000000 AS s, CASE WHEN gap < 0 THEN ' from now' ELSE ' ago' END AS d
              FROM (SELECT event_id, ts, epoch_us({AS_OF_SQL}) - epoch_us(ts) AS gap FROM events))""",
)
def timeago(v: ReaderViews) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return v.table("events").select("event_id", text.time_ago(ts, as_of()).alias("ago"))


@query(
    "sql_functions",
    f"""SELECT page_id, {_EXCERPT_SQL} AS excerpt, CASE WHEN words < 460 THEN 0 ELSE words // 230 END AS minutes FROM (
          SELECT page_id, len(regexp_extract_all(html, '\\S+')) AS words, trim(regexp_replace(
                   replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),
                     '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'),
                   '\\s+', ' ', 'g')) AS t FROM pages)""",
)
def sql_functions(v: ReaderViews) -> DataFrame:
    """The helpers called from SQL text."""
    sqlnames.register(v.spark)
    spread(v.table("pages")).createOrReplaceTempView("articleflow_pages")
    return v.spark.sql(
        """SELECT page_id,
                  cut_at_word(plain_text(decode_entities(regexp_replace(html, '<[^>]+>', ''))), 400) AS excerpt,
                  IF(reading_time(html) = '1 min read', 0L, CAST(split(reading_time(html), ' ')[0] AS BIGINT)) AS minutes
           FROM articleflow_pages"""
    ).selectExpr("page_id", "excerpt", "minutes")


@query(
    "sql_timeago",
    f"""SELECT event_id, CASE WHEN gap >= 86400000000 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE {_AGO} END AS ago
        FROM (SELECT *, abs(gap) // 1000000 AS s, CASE WHEN gap < 0 THEN ' from now' ELSE ' ago' END AS d
              FROM (SELECT event_id, ts, epoch_us({AS_OF_SQL}) - epoch_us(ts) AS gap FROM events))""",
)
def sql_timeago(v: ReaderViews) -> DataFrame:
    sqlnames.register(v.spark)
    return v.table("events").selectExpr(
        "event_id", "timeago(CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-30 12:00:00') AS ago"
    )


@query(
    "hashes",
    """SELECT entry_id, sha256(content) AS source_hash, sha256(content || chr(10) || '<p>' || title || '</p>') AS content_hash
       FROM v_entries""",
)
def hashes(v: ReaderViews) -> DataFrame:
    body = F.concat(F.lit("<p>"), "title", F.lit("</p>"))
    return v.entries().select(
        "entry_id",
        text.source_hash(F.col("content")).alias("source_hash"),
        text.content_hash(F.col("content"), body).alias("content_hash"),
    )


@query(
    "model_inputs",
    """WITH w AS (SELECT doc_id AS entry_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents)
       SELECT entry_id, CASE WHEN length(text) >= 100 THEN md5(array_to_string(w[1:4000], ' ')) END AS summarise,
              CASE WHEN length(text) >= 50 THEN md5(array_to_string(w[1:2000], ' ')) END AS classify,
              CASE WHEN length(text) >= 1 THEN md5(array_to_string(w[1:1200], ' ')) END AS embed FROM w""",
)
def model_inputs(v: ReaderViews) -> DataFrame:
    cols = [F.md5(enrich.model_input(F.col("content"), t)).alias(t) for t in ("summarise", "classify", "embed")]
    return spread(v.entries()).select("entry_id", *cols)


@query(
    "parsed_tags",
    """WITH raw AS (SELECT event_id, list_transform(string_split(event_type || ', "Big Idea", ,' || user_id || ',''x'',' || repeat('z', 60) || ',a,b', ','),
                     lambda t: trim(lower(trim(t)), '"''')) AS t FROM events)
       SELECT event_id, array_to_string((list_filter(t, lambda x: length(x) > 0 AND length(x) < 50))[1:5], '|') AS tags FROM raw""",
)
def parsed_tags(v: ReaderViews) -> DataFrame:
    raw = F.expr("concat(event_type, ', \"Big Idea\", ,', user_id, \",'x',\", repeat('z', 60), ',a,b')")
    return v.table("events").select("event_id", F.array_join(text.parse_tags(raw), "|").alias("tags"))


_SLUG = "coalesce(nullif(substring(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), 1, 50), ''), 'custom')"


@query("slugs", f"SELECT entry_id, {_SLUG.format('title')} AS slug FROM v_entries")
def slugs(v: ReaderViews) -> DataFrame:
    return v.entries().select("entry_id", text.slugify(F.col("title")).alias("slug"))


@query(
    "unique_slugs",
    """WITH r AS (SELECT event_id AS seq, event_type || ' ' || chr(65 + CAST(user_id % 5 AS INTEGER)) AS name,
                         event_type || '_' || chr(97 + CAST(user_id % 5 AS INTEGER)) AS base FROM events),
       n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS r FROM r)
       SELECT seq, name, CASE WHEN base LIKE '%\\_a' ESCAPE '\\' THEN base || '_' || CASE WHEN r <= 2 THEN r + 1 ELSE r + 2 END
                              WHEN r = 1 THEN base ELSE base || '_' || r END AS slug FROM n""",
)
def unique_slugs(v: ReaderViews) -> DataFrame:
    """Bases ending in ``_a`` have the plain slug and number 4 taken."""
    names = v.table("events").selectExpr(
        "event_id AS seq", "concat(event_type, ' ', chr(65 + user_id % 5)) AS name"
    )
    taken = v.table("events").selectExpr("explode(array(concat(event_type, '_a'), concat(event_type, '_a_4'))) AS slug").distinct()
    return prompts.unique_slugs(names, taken)


@query(
    "hosts",
    """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
              regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS bare_host FROM pages""",
)
def hosts(v: ReaderViews) -> DataFrame:
    url = F.col("url")
    return v.table("pages").select("page_id", urls.host(url).alias("host"), urls.bare_host(url).alias("bare_host"))


@query(
    "archive_urls",
    """SELECT page_id, 'https://web.archive.org/web/' || url_encode(url) AS archive_url,
              url_encode(url || ' ~*é+') AS encoded FROM pages""",
)
def archive_urls(v: ReaderViews) -> DataFrame:
    return v.table("pages").select(
        "page_id",
        urls.archive_url(F.col("url")).alias("archive_url"),
        urls.percent_encode(F.concat("url", F.lit(" ~*é+"))).alias("encoded"),
    )


@query(
    "resolved_urls",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^https?://[^/]+') || '/feed.xml'
                WHEN 1 THEN 'https://other.example.org/x' ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/(?:.*/)?') || 'rss' END AS target
       FROM pages""",
)
def resolved_urls(v: ReaderViews) -> DataFrame:
    href = F.expr("CASE page_id % 3 WHEN 0 THEN '/feed.xml' WHEN 1 THEN 'https://other.example.org/x' ELSE 'rss' END")
    return v.table("pages").select("page_id", urls.resolve_url(F.col("url"), href).alias("target"))


@query(
    "cookie_pairs",
    """SELECT event_id, '1=' || user_id AS first_value, event_type AS kind, CAST(CASE WHEN user_id % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS pairs
       FROM events""",
)
def cookie_pairs(v: ReaderViews) -> DataFrame:
    raw = F.expr(
        "concat('a=0; noise ; a = 1=', user_id, ';kind=', event_type, IF(user_id % 2 = 0, '; z=', ''))"
    )
    pairs = urls.parse_pairs(raw)
    return v.table("events").select(
        "event_id",
        F.try_element_at(pairs, F.lit("a")).alias("first_value"),
        F.try_element_at(pairs, F.lit("kind")).alias("kind"),
        F.size(pairs).alias("pairs"),
    )


@query(
    "time_parts",
    """SELECT event_id, epoch_us(ts) // 1000000 AS epoch, CAST(date_trunc('day', ts) AS DATE) AS day,
              CAST(date_trunc('week', ts) AS DATE) AS week, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events""",
)
def time_parts(v: ReaderViews) -> DataFrame:
    """Times written as ISO strings with a Z and parsed again."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parsed = F.try_to_timestamp(iso)
    return v.table("events").select(
        "event_id",
        F.unix_seconds(parsed).alias("epoch"),
        F.to_date(parsed).alias("day"),
        F.to_date(F.date_trunc("week", parsed)).alias("week"),
        F.date_format(parsed, "yyyy-MM-dd HH:mm").alias("shown"),
    )


@query(
    "summary_maps",
    """SELECT entry_id, version,
              CASE entry_id % 4 WHEN 0 THEN 'default=old ' || turn WHEN 1 THEN 'default=d' || turn || ',eli5=e' || turn
                WHEN 2 THEN 'default=old,eli5=e' || turn || ',skeptic=s' || turn ELSE '' END AS summaries
       FROM v_snapshots""",
)
def summary_maps(v: ReaderViews) -> DataFrame:
    pairs = F.array_sort(F.map_entries(metadata.summaries(metadata.parse_metadata(F.col("metadata")))))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    return v.snapshots().select("entry_id", "version", F.coalesce(shown, F.lit("")).alias("summaries"))


@query(
    "merged_summaries",
    """SELECT conv_id AS entry_id, turn, CASE WHEN turn % 2 = 0 THEN 'a=old,b=new,c=' || turn ELSE 'b=new,c=' || turn END AS merged
       FROM conversations""",
)
def merged_summaries(v: ReaderViews) -> DataFrame:
    old = F.expr("IF(turn % 2 = 0, map('a', 'old', 'b', 'old'), CAST(NULL AS MAP<STRING, STRING>))")
    new = F.expr("map('b', 'new', 'c', CAST(turn AS STRING))")
    pairs = F.array_sort(F.map_entries(metadata.merge_summaries(old, new)))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    return v.table("conversations").select(F.col("conv_id").alias("entry_id"), "turn", shown.alias("merged"))


@query(
    "error_texts",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no ' || event_type WHEN 1 THEN 'e' || user_id WHEN 2 THEN 'plain ' || user_id END AS message
       FROM events""",
)
def error_texts(v: ReaderViews) -> DataFrame:
    body = F.expr(
        """CASE event_id % 5 WHEN 0 THEN concat('{"error_message": "no ', event_type, '", "error": "x"}')
             WHEN 1 THEN concat('{"error": "e', user_id, '"}') WHEN 2 THEN concat(' plain ', user_id, ' ')
             WHEN 3 THEN '[1, 2]' ELSE '  ' END"""
    )
    return v.table("events").select("event_id", metadata.error_text(body).alias("message"))


@query(
    "clamped_values",
    """SELECT event_id, least(3, greatest(1, CAST(user_id % 7 AS INTEGER) - 2)) AS priority,
              CAST(floor(value / 150.0 * 100) AS INTEGER) AS percent, CAST(CAST(round_even(value / 100 * 100, 0) AS INTEGER) AS VARCHAR) AS percent_text FROM events""",
)
def clamped_values(v: ReaderViews) -> DataFrame:
    return v.table("events").select(
        "event_id",
        text.clamp(F.expr("CAST(user_id % 7 AS INT) - 2"), 1, 3).alias("priority"),
        text.percent_of(F.col("value"), F.lit(150.0)).alias("percent"),
        text.percent_text(F.col("value") / 100).alias("percent_text"),
    )


@query(
    "prompt_list",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name, user_id % 2 = 0 AS is_builtin,
              row_number() OVER (ORDER BY (user_id % 2 = 0) DESC, event_type, CAST(event_id AS VARCHAR)) AS position
       FROM events""",
)
def prompt_list(v: ReaderViews) -> DataFrame:
    """A large prompt table in list order, every row with its place."""
    rows = v.table("events").selectExpr(
        "CAST(event_id AS STRING) AS id", "event_type AS name", "user_id % 2 = 0 AS is_builtin"
    )
    return prompts.list_prompts(rows, position="position")


@query(
    "summary_requests",
    """SELECT entry_id, version, p AS prompt_id, length(content_text) AS chars
       FROM v_snapshots, (VALUES ('default'), ('eli5')) AS t(p) WHERE length(content_text) > 0""",
)
def summary_requests(v: ReaderViews) -> DataFrame:
    library = prompts.builtin_prompts(v.spark)
    asked = prompts.summary_requests(v.snapshots(), library, ["default", "eli5"])
    return asked.select("entry_id", "version", "prompt_id", F.length("text").cast("bigint").alias("chars"))


def _first_words_model(texts: list[str]) -> list[str]:
    """Stand-in for a model: the three first words as a tag answer."""
    return [", ".join(t.split()[:3]) for t in texts]


@query(
    "model_tags",
    """SELECT doc_id AS entry_id, array_to_string(
         list_filter(list_transform(string_split(array_to_string((regexp_extract_all(text, '\\S+'))[1:3], ', '), ','),
           lambda t: trim(lower(trim(t)), '"''')), lambda x: length(x) > 0 AND length(x) < 50)[1:5], '|') AS tags
       FROM documents WHERE length(text) >= 50""",
)
def model_tags(v: ReaderViews) -> DataFrame:
    tagged = enrich.classify(spread(v.entries()), _first_words_model, "content")
    return tagged.where("size(tags) > 0").select("entry_id", F.array_join("tags", "|").alias("tags"))


@query("keyword_tags")
def keyword_tags(v: ReaderViews) -> DataFrame:
    return enrich.keyword_tags(v.entries())


@query("hashed_embeddings")
def hashed_embeddings(v: ReaderViews) -> DataFrame:
    return spread(v.entries()).select("entry_id", enrich.hashed_embedding(F.col("content")).alias("embedding"))


@query(
    "markdown_export",
    """WITH last AS (SELECT entry_id, content_html FROM v_snapshots
                     QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1),
       t AS (SELECT entry_id, array_to_string(list_sort(list(DISTINCT tag)), ', ') AS tags FROM v_tags GROUP BY 1)
       SELECT e.entry_id, substring(regexp_replace(e.title, '[^\\p{L}\\p{N} _-]', '', 'g'), 1, 80) || '.md' AS filename,
              '---' || chr(10) || 'title: "' || replace(e.title, '"', '\\"') || '"' || chr(10) || 'author: "' || author || '"' || chr(10)
                || 'url: "' || e.url || '"' || chr(10) || 'feed: "Feed src' || e.feed_id || '"' || chr(10)
                || 'date: "' || strftime(published_at, '%Y-%m-%d') || '"' || chr(10) || 'tags: [' || coalesce(t.tags, '') || ']' || chr(10)
                || '---' || chr(10) || chr(10) AS head,
              md5(coalesce(last.content_html, e.content)) AS body_md5
       FROM v_entries e LEFT JOIN last USING (entry_id) LEFT JOIN t USING (entry_id)""",
)
def markdown_export(v: ReaderViews) -> DataFrame:
    out = markdown.export_markdown(v.entries(), v.feeds(), v.snapshots(), v.tags())
    return out.select("entry_id", "filename", "head", F.md5("body_html").alias("body_md5"))


@query("markdown_documents")
def markdown_documents(v: ReaderViews) -> DataFrame:
    """Whole documents of the web pages, HTML turned into Markdown."""
    return spread(v.table("pages")).select("page_id", "url", markdown.to_markdown(F.col("html")).alias("document"))
