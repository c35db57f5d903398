"""Fetch resolution and discovery of feeds on pages."""

from __future__ import annotations

from collections.abc import Iterator
from articleflow.functions.htmlparse import PageParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions.feedtext import feed_type, is_feed_link, looks_like_feed
from articleflow.functions.text import text_or_empty
from articleflow.operators.ordering import top_per_group
from articleflow.operators.sizing import spread


def resolve_fetch(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Body of each requested address by the cheapest stage that worked; nulls where none did.

    ``attempts``: url, stage, ok, body. Of several bodies of that stage the smallest in byte order counts, a
    null last. Tasks keep one attempt per address before the shuffle.
    """
    order = [F.col("stage"), F.col("body").asc_nulls_last()]
    won = top_per_group(attempts.where("ok"), ["url"], order, 1)
    return requests.join(won.select("url", "stage", "body"), "url", "left")


class _Links(PageParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "link":
            self.found.append({k: v or "" for k, v in reversed(attrs)})


def _link_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for url, body in zip(batch["url"], batch["html"]):
            parser = _Links()
            parser.feed(body)
            for pos, at in enumerate(parser.found):
                href = at.get("href", "").strip()
                try:
                    target = urljoin(url or "", href)
                except ValueError:
                    target = href
                rows.append(
                    (url, pos, at.get("rel", ""), at.get("type", ""), href, target, at.get("title", ""))
                )
        yield pd.DataFrame(
            rows, columns=["url", "pos", "rel", "link_type", "href", "target", "title"]
        )


def raw_links(pages: DataFrame) -> DataFrame:
    """Every announced alternate of every page (url, html); only pages with links are parsed."""
    some = pages.where(F.contains(F.lower("html"), F.lit("<link"))).select("url", "html")
    parsed = spread(some).mapInPandas(
        _link_rows,
        "url string, pos int, rel string, link_type string, href string, target string, title string",
    )
    return parsed.where(F.col("rel").isin("alternate", "feed") & (F.col("href") != "")).select(
        "url",
        "pos",
        "rel",
        F.trim("link_type").alias("link_type"),
        "href",
        "target",
        F.trim("title").alias("title"),
    )


def discover_links(pages: DataFrame) -> DataFrame:
    """Feed candidates of every page in order, each address once: url, pos, feed_url, title, type.

    Pages of one url count as one page: an address that several of them announce comes once, as its first
    announcement (by place, then title and type) has it.
    """
    candidates = raw_links(pages).where(is_feed_link(F.col("link_type"), F.col("href")))
    row = F.struct("pos", "title", feed_type(F.col("link_type"), F.col("target")).alias("type"))
    return (
        candidates.groupBy("url", F.col("target").alias("feed_url"))
        .agg(F.min(row).alias("first"))
        .select("url", "first.pos", "feed_url", "first.title", "first.type")
    )


def first_candidate(links: DataFrame) -> DataFrame:
    """First candidate of every page; of several at one place the smallest address."""
    return links.groupBy("url").agg(F.min_by("feed_url", F.struct("pos", "feed_url")).alias("new_url"))


def discovery_outcomes(feeds: DataFrame, attempts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Probe of each feed's site: candidate, same, no_candidate or fetch_failed, with the address.

    ``links`` may be given when the pages are parsed already; else the fetched bodies are.
    """
    site = F.when(text_or_empty(F.col("site_url")) != "", F.col("site_url")).otherwise(F.col("feed_url"))
    probes = feeds.withColumn("url", site)
    fetched = resolve_fetch(probes.select("url").distinct(), attempts)
    if links is None:
        links = discover_links(fetched.where("body IS NOT NULL").select("url", F.col("body").alias("html")))
    status = fetched.select("url", (text_or_empty(F.col("body")) != "").alias("fetched"))
    joined = probes.join(status, "url", "left").join(first_candidate(links), "url", "left")
    fetched_ok = F.coalesce("fetched", F.lit(False))
    outcome = (
        F.when(~fetched_ok, "fetch_failed")
        .when(F.col("new_url").isNull(), "no_candidate")
        .when(F.col("new_url") == F.col("feed_url"), "same")
        .otherwise("candidate")
    )
    return joined.select(
        "feed_id",
        "title",
        F.col("feed_url").alias("current_url"),
        outcome.alias("outcome"),
        F.when(fetched_ok, F.col("new_url")).alias("new_url"),
    )


def known_feeds(wanted: DataFrame, feeds: DataFrame) -> DataFrame:
    """Requested feeds that exist."""
    return feeds.join(wanted.select("feed_id"), "feed_id", "left_semi")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        *[
            F.count_if(F.col("outcome") == o).alias(name)
            for o, name in (
                ("candidate", "candidates"),
                ("same", "same"),
                ("no_candidate", "no_candidate"),
                ("fetch_failed", "fetch_failed"),
            )
        ]
    )


def candidate_sources(primary: DataFrame, parsed: DataFrame) -> DataFrame:
    """Candidates per page: those of the discovery service where it has any, else the parsed ones.

    Both inputs: url, feed_url, title, type. A page is its url: one row of the service replaces all parsed ones.
    """
    columns = ["url", "feed_url", "title", "type"]
    kind = F.lower(text_or_empty(F.col("type")))
    first = primary.select(
        "url", "feed_url", "title", F.when(kind == "", "unknown").otherwise(kind).alias("type")
    )
    rest = parsed.select(*columns).join(first.select("url"), "url", "left_anti")
    return first.withColumn("source", F.lit("service")).unionByName(
        rest.withColumn("source", F.lit("parsed"))
    )


def route_url_changes(changes: DataFrame, feeds: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a requested address change (feed_id, new_url) leads to.

    no_change, update (the address serves a feed) or discover; blank requests are ``invalid``.
    """
    asked = changes.select("feed_id", F.trim(text_or_empty(F.col("new_url"))).alias("url"))
    bodies = resolve_fetch(asked.select("url").distinct(), attempts).select("url", "body")
    judged = bodies.select("url", looks_like_feed(F.col("body")).alias("_feed"))
    joined = asked.join(feeds.select("feed_id", F.col("feed_url").alias("old_url")), "feed_id").join(
        judged, "url", "left"
    )
    route = (
        F.when(F.col("url") == "", "invalid")
        .when(F.col("url") == F.col("old_url"), "no_change")
        .when(F.col("_feed"), "update")
        .otherwise("discover")
    )
    return joined.select("feed_id", "old_url", F.col("url").alias("new_url"), route.alias("route"))
