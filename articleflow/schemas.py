"""Table schemas. Every reader takes one of these, so no scan infers types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

EXTRACT_RULES = T.StructType(
    [
        T.StructField("content_xpath", T.StringType()),
        T.StructField("unwrap_tags", T.ArrayType(T.StringType())),
        T.StructField("remove_tags", T.ArrayType(T.StringType())),
        T.StructField("remove_xpath", T.ArrayType(T.StringType())),
    ]
)

SUMMARY_METADATA = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("summaries", T.MapType(T.StringType(), T.StringType())),
    ]
)

ENCLOSURES = T.ArrayType(
    T.StructType(
        [T.StructField("url", T.StringType()), T.StructField("mime_type", T.StringType())]
    )
)


_DDL: dict[str, str] = {
    "entries": (
        "entry_id bigint, feed_id bigint, title string, content string, author string, url string, "
        "status string, starred boolean, published_at timestamp, "
        "enclosures array<struct<url:string,mime_type:string>>, tags array<string>"
    ),
    "feeds": (
        "feed_id bigint, title string, feed_url string, site_url string, category_id bigint, "
        "checked_at timestamp, parsing_error_count int, parsing_error_message string, "
        "disabled boolean, fetch_via_proxy boolean, allow_self_signed_certificates boolean"
    ),
    "categories": "category_id bigint, title string",
    "feed_config": (
        "feed_id bigint, fetch_full_content boolean, priority int, "
        "extract_rules struct<content_xpath:string,unwrap_tags:array<string>,"
        "remove_tags:array<string>,remove_xpath:array<string>>, "
        "created_at timestamp, updated_at timestamp"
    ),
    "article_snapshots": (
        "id bigint, entry_id bigint, feed_id bigint, url string, fetched_at timestamp, "
        "content_text string, content_html string, content_hash string, metadata string, "
        "version int, source_hash string"
    ),
    "read_events": "id bigint, entry_id bigint, feed_id bigint, read_at timestamp",
    "saved_filters": (
        "id bigint, name string, rules array<struct<field:string,op:string,value:string>>, "
        "auto_action string, created_at timestamp, updated_at timestamp"
    ),
    "article_tags": "id bigint, entry_id bigint, tag string, created_at timestamp",
    "share_links": (
        "entry_id bigint, token string, expires_at timestamp, created_at timestamp"
    ),
    "article_embeddings": (
        "entry_id bigint, embedding array<double>, created_at timestamp"
    ),
    "summary_prompts": (
        "id string, name string, system_prompt string, is_builtin boolean, created_at timestamp"
    ),
    "site_settings": "domain string, settings map<string,string>, updated_at timestamp",
    "feed_url_history": (
        "feed_id bigint, old_url string, new_url string, source string, changed_at timestamp"
    ),
    "icons": "id bigint, content binary, mime_type string",
    "feed_icons": "feed_id bigint, icon_id bigint",
    "fetch_attempts": "url string, stage int, ok boolean, body string",
}


def schema_of(table: str) -> T.StructType:
    """Declared schema of a table; needs a running session."""
    return T.StructType.fromDDL(_DDL[table])


# Values a row takes when an older file lacks the column or holds a null.
DEFAULTS: dict[str, dict[str, object]] = {
    "feed_config": {"fetch_full_content": False, "priority": 2},
    "article_snapshots": {"version": 1},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring a DataFrame to the table's present schema.

    Columns it lacks are added with their default, columns dropped from the schema go away, the
    others are cast. This is a projection, so it costs no shuffle and keeps pushdown.
    """
    defaults = DEFAULTS.get(table, {})
    have = set(df.columns)
    out = []
    for field in schema_of(table):
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)
