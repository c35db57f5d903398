"""Column functions over article text. All but entity decoding run inside the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as a Unicode-aware reader sees it: the White_Space property plus the four
# information separators.
_WS = r"[\s\x1c-\x1f]"
_NON_WS = r"[^\s\x1c-\x1f]"


def ws_trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^{_WS}+|{_WS}+$", "")


def collapse_ws(col: Column) -> Column:
    return ws_trim(F.regexp_replace(col, rf"(?U){_WS}+", " "))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


@F.pandas_udf(T.StringType())
def _decode_entities(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def decode_entities(col: Column) -> Column:
    """HTML entities to characters. Only rows that hold an ampersand carry text to Python."""
    has = F.contains(col, F.lit("&"))
    return F.coalesce(_decode_entities(F.when(has, col)), col)


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, r"<[^>]+>", "")


def excerpt(col: Column, length: int = 400, entities: bool = True) -> Column:
    """Plain-text beginning of an article, cut at a word and marked with dots."""
    text = strip_tags(text_or_empty(col))
    if entities:
        text = decode_entities(text)
    text = collapse_ws(text)
    cut = F.regexp_replace(F.substring(text, 1, length), r"(?s) [^ ]*$", "")
    return F.when(F.length(text) <= length, text).otherwise(F.concat(cut, F.lit("...")))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(rf"(?U){_NON_WS}+"))


def reading_minutes(col: Column, words_per_minute: int = 230) -> Column:
    return F.greatest(
        F.lit(1), F.floor(word_count(col) / F.lit(words_per_minute)).cast("int")
    )


def reading_time(col: Column, strip: bool = False) -> Column:
    """``N min read``; tags count as words unless ``strip`` is set."""
    body = strip_tags(col) if strip else col
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, F.lit("< 1 min")).otherwise(
        F.concat(reading_minutes(body).cast("string"), F.lit(" min read"))
    )


def _spell(seconds: Column) -> Column:
    """Length of a duration in words, for a non-negative number of whole seconds."""
    minutes = F.floor(seconds / 60)
    hours = F.floor(seconds / 3600)
    all_days = F.floor(seconds / 86400)
    years = F.floor(all_days / 365)
    days = all_days % 365
    months = F.floor(days / F.lit(30.5))

    def counted(n: Column, unit: str) -> Column:
        return F.concat(n.cast("bigint").cast("string"), F.lit(" " + unit))

    below_year = (
        F.when(days == 1, F.lit("a day"))
        .when(months == 0, counted(days, "days"))
        .when(months == 1, F.lit("a month"))
        .otherwise(counted(months, "months"))
    )
    one_year = (
        F.when((months == 0) & (days == 0), F.lit("a year"))
        .when((months == 0) & (days == 1), F.lit("1 year, 1 day"))
        .when(months == 0, F.concat(F.lit("1 year, "), counted(days, "days")))
        .when(months == 1, F.lit("1 year, 1 month"))
        .otherwise(F.concat(F.lit("1 year, "), counted(months, "months")))
    )
    return (
        F.when(seconds == 1, F.lit("a second"))
        .when(seconds < 60, counted(seconds, "seconds"))
        .when(seconds < 120, F.lit("a minute"))
        .when(seconds < 3600, counted(minutes, "minutes"))
        .when(seconds < 7200, F.lit("an hour"))
        .when(seconds < 86400, counted(hours, "hours"))
        .when(years == 0, below_year)
        .when(years == 1, one_year)
        .otherwise(counted(years, "years"))
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def time_ago(ts: Column, as_of: Column) -> Column:
    """Age in words below one day, the minute-precise time beyond; future times read ``from now``."""
    gap = micros(as_of) - micros(ts)
    whole = F.floor(F.abs(gap) / 1_000_000)
    words = (
        F.when(whole == 0, F.lit("now"))
        .when(gap < 0, F.concat(_spell(whole), F.lit(" from now")))
        .otherwise(F.concat(_spell(whole), F.lit(" ago")))
    )
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(gap < 86_400_000_000, words)
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    )


def time_ago_text(col: Column, as_of: Column) -> Column:
    """As :func:`time_ago` for ISO-8601 strings; what does not parse keeps its first 16 characters."""
    parsed = F.try_to_timestamp(col)
    return (
        F.when(text_or_empty(col) == "", F.lit(""))
        .when(parsed.isNull(), F.replace(F.substring(col, 1, 16), F.lit("T"), F.lit(" ")))
        .otherwise(time_ago(parsed, as_of))
    )


def source_hash(content: Column) -> Column:
    return F.sha2(text_or_empty(content), 256)


def content_hash(text: Column, body_html: Column) -> Column:
    return F.sha2(F.concat(text_or_empty(text), F.lit("\n"), text_or_empty(body_html)), 256)


def first_words(col: Column, n: int) -> Column:
    """The first ``n`` words joined by single spaces, for model input limits."""
    head = F.regexp_replace(col, rf"(?U)^{_WS}+", "")
    parts = F.split(head, rf"(?U){_WS}+", n + 1)
    return F.trim(F.array_join(F.slice(parts, 1, n), " "))


def parse_tags(col: Column, limit: int = 5, max_length: int = 50) -> Column:
    """Comma-separated model answer to a list of clean tags."""
    tags = F.transform(
        F.split(text_or_empty(col), ","), lambda t: F.btrim(F.lower(ws_trim(t)), F.lit("\"'"))
    )
    kept = F.filter(tags, lambda t: (F.length(t) > 0) & (F.length(t) < max_length))
    return F.slice(kept, 1, limit)


def slugify(col: Column) -> Column:
    base = F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))
    cut = F.substring(base, 1, 50)
    return F.when(F.length(text_or_empty(cut)) == 0, F.lit("custom")).otherwise(cut)


def title_case(col: Column) -> Column:
    """Capitalise every run of letters, also after digits and apostrophes."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
        ),
        "",
    )


def author_slug(feed_url: Column) -> Column:
    """Author name read from an ``/author/<slug>`` address."""
    path = F.substring_index(F.rtrim(feed_url, F.lit("/")), "/author/", -1)
    return title_case(F.replace(F.substring_index(path, "/", 1), F.lit("-"), F.lit(" ")))


def author_title(author: Column, title: Column) -> Column:
    """``author | publication``; the publication is what follows the first bar of the old title."""
    existing = F.trim(text_or_empty(title))
    bar = F.instr(existing, "|")
    publication = F.when(bar > 0, F.trim(F.substr(existing, bar + 1))).otherwise(existing)
    return F.when(F.length(publication) > 0, F.concat(author, F.lit(" | "), publication)).otherwise(
        author
    )


def safe_filename(title: Column) -> Column:
    kept = F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")
    return F.concat(F.substring(kept, 1, 80), F.lit(".md"))


def percent_text(similarity: Column) -> Column:
    return F.format_string("%.0f", F.rint(similarity * 100))


def percent_of(part: Column, whole: Column) -> Column:
    """Integer percent, truncated."""
    return F.floor(F.try_divide(part, whole) * 100).cast("int")


def clamp(col: Column, low: int, high: int) -> Column:
    """Value kept within bounds; null stays null."""
    return F.when(col.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), col)))
