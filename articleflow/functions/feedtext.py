"""Column functions that classify feeds, links and error messages."""

from __future__ import annotations

from itertools import chain
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the health buckets in order of severity, and remedies. Labels are our own words.
BUCKETS: list[tuple[str, str, str | None]] = [
    ("http_404", "Address no longer exists (404)", "auto-discover"),
    ("not_a_feed", "A web page where a feed was expected", "auto-discover"),
    ("bot_blocked", "Refused as automated traffic", "set-proxy"),
    ("server_5xx", "The site failed to answer (5xx)", "bulk-refresh"),
    ("auth", "A login is needed", None),
    ("tls", "Secure connection could not be set up", "allow-self-signed"),
    ("unsupported_scheme", "Address of a kind that cannot be fetched", "pause-polling"),
    ("dns_fail", "Host name unknown", "pause-polling"),
    ("connect_fail", "Host did not accept a connection", "pause-polling"),
    ("other", "Failed for another reason", "pause-polling"),
    ("stale", "No poll for a day", None),
    ("paused", "Polling switched off by the user", "resume-polling"),
    ("ok", "Working", None),
]

# Limits of the health check.
STALE_SECONDS = 24 * 3600
PERSISTENT_ERRORS = 3

# Media types that announce a feed.
FEED_TYPES = [
    "application/rss+xml",
    "application/atom+xml",
    "application/feed+json",
    "application/json",
]


def error_bucket(message: Column) -> Column:
    """Bucket of an error message; the first test that holds decides."""
    m = F.coalesce(message, F.lit(""))

    def has(text: str) -> Column:
        return F.contains(m, F.lit(text))

    return (
        F.when(m == "", F.lit(""))
        .when(has("not found") & has("resource"), "http_404")
        .when(has("Unable to detect feed format"), "not_a_feed")
        .when(has("bot protection") | has("forbidden"), "bot_blocked")
        .when(has("server error"), "server_5xx")
        .when(has("not authorized") | has("bad username"), "auth")
        .when(has("TLS") | has("tls:"), "tls")
        .when(F.contains(F.lower(m), F.lit("unsupported")), "unsupported_scheme")
        .when(has("dial tcp") & has("lookup"), "dns_fail")
        .when(has("dial tcp"), "connect_fail")
        .otherwise("other")
    )


def _bucket_map(position: int) -> Column:
    pairs = [(b[0], b[position]) for b in BUCKETS if b[position] is not None]
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def bucket_label(bucket: Column) -> Column:
    return F.try_element_at(_bucket_map(1), bucket)


def bucket_action(bucket: Column) -> Column:
    return F.try_element_at(_bucket_map(2), bucket)


def bucket_rank(bucket: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b[0]) for b in BUCKETS]), bucket).cast("int")


def is_feed_link(link_type: Column, href: Column) -> Column:
    typed = F.lower(F.trim(F.coalesce(link_type, F.lit("")))).isin(FEED_TYPES)
    return typed | F.rlike(F.lower(href), F.lit(r"/rss|/atom|/feed|\.xml"))


def feed_type(link_type: Column, href: Column) -> Column:
    """``rss``, ``atom``, ``json`` or ``unknown``, read from the media type before the address."""
    t = F.lower(F.trim(F.coalesce(link_type, F.lit(""))))
    h = F.lower(F.coalesce(href, F.lit("")))

    def has(col: Column, text: str) -> Column:
        return F.contains(col, F.lit(text))

    return (
        F.when(has(t, "atom"), "atom")
        .when(has(t, "json"), "json")
        .when(has(t, "rss") | has(t, "xml"), "rss")
        .when(has(h, "atom"), "atom")
        .when(F.endswith(h, F.lit(".json")) | has(h, "feed.json"), "json")
        .when(has(h, "rss") | F.endswith(h, F.lit(".xml")) | has(h, "/feed"), "rss")
        .otherwise("unknown")
    )


# First element of a document behind declaration, comments and doctype; an optional prefix is cut.
_ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)"


def root_name(body: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(body, "^﻿", ""), _ROOT, 1))


@F.pandas_udf(T.BooleanType())
def _well_formed(bodies: pd.Series) -> pd.Series:
    def check(body: str) -> bool:
        try:
            expat.ParserCreate().Parse(body.encode("utf-8"), True)
        except (expat.ExpatError, ValueError, LookupError):
            return False
        return True

    return bodies.map(check, na_action="ignore").astype(object)


def looks_like_feed(body: Column) -> Column:
    """Whether fetched text is a feed: well-formed XML with a feed's root, or a JSON Feed version.

    The root's name is read inside the JVM; only texts that may be feeds are parsed in Python.
    """
    text = F.coalesce(body, F.lit(""))
    maybe = root_name(text).isin("rss", "feed", "rdf")
    xml = maybe & F.coalesce(_well_formed(F.when(maybe, text)), F.lit(False))
    json_text = F.when(F.startswith(F.ltrim(text), F.lit("{")), text)
    version = F.try_variant_get(F.try_parse_json(json_text), "$.version", "string")
    return xml | F.coalesce(F.contains(version, F.lit("jsonfeed.org")), F.lit(False))
