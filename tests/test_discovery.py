"""Discovery where several pages have the same address."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from articleflow.operators import discovery

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Test data with every page's address on three more pages, other texts and a page with the same text among them."""
    out = tmp_path_factory.mktemp("pages")
    copies = """SELECT page_id + 1003 * k AS page_id, url, CASE WHEN k = 3 THEN html ELSE replace(html, '<p>', '<p>' || chr(CAST(97 + (page_id * 7 + k * 5) % 11 AS INTEGER))) END AS html
                FROM pages, range(4) AS r(k)"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    con.execute(f"COPY (SELECT * FROM ({copies}) ORDER BY hash(page_id)) TO '{out}/pages.parquet'")
    return out


def _agrees(spark, folder: Path, name: str) -> int:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(tuple, cursor.fetchall()), key=repr)
    got = entry.queries()[name](spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == want
    return len(want)


def test_fetch_resolution_of_shared_addresses(spark, folder):
    assert _agrees(spark, folder, "fetch_resolution") > 0


def test_smallest_body_of_the_cheapest_stage_wins(spark):
    rows = [("u", 2, True, "a"), ("u", 1, True, None), ("u", 1, True, "c"), ("u", 1, True, "b"), ("u", 0, False, "0")]
    attempts = spark.createDataFrame(rows, "url string, stage int, ok boolean, body string")
    asked = spark.createDataFrame([("u",), ("v",)], "url string")
    for ascending in (True, False):
        given = attempts.coalesce(1).sortWithinPartitions("body", ascending=ascending)
        out = discovery.resolve_fetch(asked, given).orderBy("url").collect()
        assert [tuple(r) for r in out] == [("u", 1, "b"), ("v", None, None)]


def test_feed_links_of_shared_addresses(spark, folder):
    assert _agrees(spark, folder, "feed_links") > 0


def test_an_address_two_pages_announce_comes_once(spark):
    link = '<link rel="alternate" type="application/rss+xml" href="/{}" title="{}">'
    pages = [("https://a.org/", link.format("x", "later") + link.format("y", "b")), ("https://a.org/", link.format("y", "a"))]
    out = discovery.discover_links(spark.createDataFrame(pages, "url string, html string")).orderBy("feed_url").collect()
    assert [(r["feed_url"], r["pos"], r["title"]) for r in out] == [("https://a.org/x", 0, "later"), ("https://a.org/y", 0, "a")]


def test_discovery_outcomes_of_shared_addresses(spark, folder):
    assert _agrees(spark, folder, "discovery_outcomes") > 0


def test_first_of_several_candidates_at_one_place(spark):
    rows = [("u", 0, "b"), ("u", 0, "a"), ("u", 1, "0")]
    links = spark.createDataFrame(rows, "url string, pos int, feed_url string")
    assert [tuple(r) for r in discovery.first_candidate(links).collect()] == [("u", "a")]


def test_discovery_counts_of_shared_addresses(spark, folder):
    assert _agrees(spark, folder, "discovery_counts") == 1


def test_candidate_sources_of_shared_addresses(spark, folder):
    assert _agrees(spark, folder, "candidate_sources") > 0
