"""Column functions on literal cases, one or more per branch."""

import hashlib
import random
import re
from datetime import datetime, timedelta
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from articleflow.functions import feedtext, metadata, text, urls, vectors
from articleflow.operators.entries import audio_enclosure, shown_tags, time_bound
from articleflow.operators.rules import parse_rules, valid_rules

NOW = datetime(2024, 1, 30, 12, 0, 0)


@pytest.mark.parametrize(
    "message,bucket",
    [
        (None, ""),
        ("", ""),
        ("the requested resource is not found", "http_404"),
        ("not found", "other"),
        ("Unable to detect feed format: forbidden", "not_a_feed"),
        ("bot protection", "bot_blocked"),
        ("access forbidden by server error", "bot_blocked"),
        ("server error", "server_5xx"),
        ("not authorized", "auth"),
        ("bad username", "auth"),
        ("TLS handshake", "tls"),
        ("tls: bad certificate unsupported", "tls"),
        ("Unsupported protocol", "unsupported_scheme"),
        ("dial tcp: lookup host", "dns_fail"),
        ("dial tcp 1.2.3.4: refused", "connect_fail"),
        ("Dial TCP", "other"),
    ],
)
def test_error_bucket(one, message, bucket):
    assert one([(message,)], "m string", feedtext.error_bucket(F.col("m"))) == [bucket]


def test_bucket_tables_cover_all(one):
    names = [(b[0],) for b in feedtext.BUCKETS]
    assert one(names, "b string", feedtext.bucket_rank(F.col("b"))) == list(range(1, 14))
    assert one(names, "b string", feedtext.bucket_label(F.col("b"))) == [b[1] for b in feedtext.BUCKETS]
    assert one(names, "b string", feedtext.bucket_action(F.col("b"))) == [b[2] for b in feedtext.BUCKETS]


@pytest.mark.parametrize(
    "kind,href,expected",
    [
        ("application/atom+xml", "/x", "atom"),
        ("application/feed+json", "/x", "json"),
        (" Application/RSS+xml ", "/atom", "rss"),
        ("text/xml", "/x", "rss"),
        ("", "https://a/ATOM", "atom"),
        (None, "https://a/x.json", "json"),
        ("", "https://a/feed.json?p", "json"),
        ("", "https://a/rss", "rss"),
        ("", "https://a/x.xml", "rss"),
        ("", "https://a/feed/", "rss"),
        ("text/html", "https://a/page", "unknown"),
    ],
)
def test_feed_type(one, kind, href, expected):
    got = one([(kind, href)], "t string, h string", feedtext.feed_type(F.col("t"), F.col("h")))
    assert got == [expected]


@pytest.mark.parametrize(
    "body,expected",
    [
        (None, False),
        ("", False),
        ("<rss version='2.0'><channel/></rss>", True),
        ("<?xml version='1.0'?><!-- c --><feed xmlns='http://www.w3.org/2005/Atom'></feed>\n", True),
        ("<rdf:RDF xmlns:rdf='http://x'></rdf:RDF>", True),
        ("<RSS></RSS>", True),
        ("<rss/>", True),
        ("<rss><channel></rss>", False),
        ("<rss><channel>", False),
        ("<rss></rss>trailing", False),
        ("<!DOCTYPE html><html><rss></rss></html>", False),
        ('  {"version": "https://jsonfeed.org/version/1", "items": []}', True),
        ('{"version": 1}', False),
        ('{"version": "2"}', False),
        ('["jsonfeed.org"]', False),
        ('{"version": "https://jsonfeed.org', False),
        ("plain", False),
    ],
)
def test_looks_like_feed(one, body, expected):
    assert one([(body,)], "b string", feedtext.looks_like_feed(F.col("b"))) == [expected]


def test_excerpt(one):
    long = "word " * 200
    cases = [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b&nbsp;c</p>\n d", "a & b c d"),
        ("x&lt;b&gt;y", "x<b>y"),
        ("y" * 500, "y" * 400 + "..."),
    ]
    got = one([(c[0],) for c in cases], "c string", text.excerpt(F.col("c")))
    assert got == [c[1] for c in cases]
    cut = " ".join(long.split())[:400].rsplit(" ", 1)[0] + "..."
    assert one([(long,)], "c string", text.excerpt(F.col("c"))) == [cut]


def test_excerpt_never_long(one):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab <>&;é\n\t　") for _ in range(rng.randint(0, 900))),) for _ in range(200)]
    assert all(len(v) <= 403 for v in one(rows, "c string", text.excerpt(F.col("c"))))


def test_reading_time(one):
    cases = {None: "< 1 min", "": "< 1 min", "  ": "1 min read", "w " * 229: "1 min read", "w " * 460: "2 min read", "a b " * 345: "3 min read"}
    rows = [(k,) for k in cases]
    assert one(rows, "c string", text.reading_time(F.col("c"))) == list(cases.values())
    assert one([("<p>" + "<b> " * 500,)], "c string", text.reading_time(F.col("c"), strip=True)) == ["1 min read"]


@pytest.mark.parametrize(
    "delta,expected",
    [
        (timedelta(0), "now"),
        (timedelta(seconds=1), "a second ago"),
        (timedelta(seconds=59), "59 seconds ago"),
        (timedelta(seconds=60), "a minute ago"),
        (timedelta(minutes=2), "2 minutes ago"),
        (timedelta(hours=1), "an hour ago"),
        (timedelta(hours=23, minutes=59), "23 hours ago"),
        (timedelta(days=1), "2024-01-29 12:00"),
        (timedelta(minutes=-5), "5 minutes from now"),
        (timedelta(days=-1), "a day from now"),
        (timedelta(days=-20), "20 days from now"),
        (timedelta(days=-40), "a month from now"),
        (timedelta(days=-100), "3 months from now"),
        (timedelta(days=-365), "a year from now"),
        (timedelta(days=-366), "1 year, 1 day from now"),
        (timedelta(days=-400), "1 year, 1 month from now"),
        (timedelta(days=-800), "2 years from now"),
    ],
)
def test_time_ago(one, delta, expected):
    column = text.time_ago(F.col("t"), F.lit(NOW).cast("timestamp_ntz"))
    assert one([(NOW - delta,)], "t timestamp_ntz", column) == [expected]


def test_time_ago_text(one):
    rows = [("2024-01-30T11:00:00Z",), ("2024-01-01T10:20:30+02:00",), ("T broken value here",), (None,)]
    got = one(rows, "t string", text.time_ago_text(F.col("t"), F.lit(NOW)))
    assert got == ["an hour ago", "2024-01-01 08:20", "  broken value h", ""]


def test_hashes(one):
    got = one([("a", None)], "t string, h string", text.content_hash(F.col("t"), F.col("h")))
    assert got == [hashlib.sha256(b"a\n").hexdigest()]
    assert one([(None,)], "t string", text.source_hash(F.col("t"))) == [hashlib.sha256(b"").hexdigest()]


def test_first_words(one):
    rows = [("  a\tb  c d ",), ("a b",), ("",), (None,)]
    assert one(rows, "t string", text.first_words(F.col("t"), 3)) == ["a b c", "a b", "", None]


def test_parse_tags(one):
    rows = [("Tech, \"AI\", , 'privacy' ,a,b,c",), ("x" * 50 + ",ok",), ("",), (None,)]
    got = one(rows, "t string", text.parse_tags(F.col("t")))
    assert got == [["tech", "ai", "privacy", "a", "b"], ["ok"], [], []]


def test_slugify(one):
    rows = [("Hello, World!",), ("--é--",), ("",), ("a" * 70,), ("x" * 49 + " yz",)]
    got = one(rows, "t string", text.slugify(F.col("t")))
    assert got == ["hello_world", "custom", "custom", "a" * 50, "x" * 49 + "_"]
    assert all(re.fullmatch("[a-z0-9_]{1,50}", s) for s in got)


def test_title_case_matches_python(one):
    words = ["jo-ann o'neil", "3d printing", "ALL CAPS", "mixed cASE x9y", ""]
    got = one([(w,) for w in words], "t string", text.title_case(F.col("t")))
    assert got == [w.title() for w in words]


def test_author_title(one):
    rows = [("Ann", "The Paper"), ("Ann", "| The Paper"), ("Ann", "Bob | The Paper"), ("Ann", ""), ("Ann", None)]
    got = one(rows, "a string, t string", text.author_title(F.col("a"), F.col("t")))
    assert got == ["Ann | The Paper", "Ann | The Paper", "Ann | The Paper", "Ann", "Ann"]
    again = one([("Ann", got[0])], "a string, t string", text.author_title(F.col("a"), F.col("t")))
    assert again == ["Ann | The Paper"]
    slug = one([("https://x/author/jo-ann/feed/",)], "u string", text.author_slug(F.col("u")))
    assert slug == ["Jo Ann"]


def test_safe_filename(one):
    rows = [('A/b: "c" é-1_2?',), ("x" * 100,)]
    assert one(rows, "t string", text.safe_filename(F.col("t"))) == ["Ab c é-1_2.md", "x" * 80 + ".md"]


def test_percent(one):
    assert one([(1, 3), (3, 3), (1, 0)], "a int, b int", text.percent_of(F.col("a"), F.col("b"))) == [33, 100, None]
    assert one([(0.875,), (0.905,)], "s double", text.percent_text(F.col("s"))) == ["88", "90"]
    assert one([(0,), (2,), (9,)], "p int", text.clamp(F.col("p"), 1, 3)) == [1, 2, 3]


def test_hosts(one):
    rows = [("https://www.Example.com:80/a",), ("http://x.org",), ("not a url at all",), (None,)]
    assert one(rows, "u string", urls.host(F.col("u"))) == ["www.example.com", "x.org", None, None]
    assert one(rows, "u string", urls.bare_host(F.col("u")))[0] == "example.com"


def test_percent_encode_matches_python(one):
    values = ["https://a/b c?d=é&f=~*", "", "100%", "a+b"]
    got = one([(v,) for v in values], "u string", urls.percent_encode(F.col("u")))
    assert got == [quote(v, safe="") for v in values]


def test_resolve_url_matches_python(one):
    base = "https://a.org/x/y?z=1"
    hrefs = ["/r", "r", "../r", "https://b.org/../q", "//c.org/f", "?q=1", "", "https://b.org/f"]
    got = one([(base, h) for h in hrefs], "b string, h string", urls.resolve_url(F.col("b"), F.col("h")))
    assert got == [urljoin(base, h) for h in hrefs]


def test_parse_pairs(one):
    rows = [("a=1; b = x=y ;junk; a=2; =e",), ("",), ("nothing",)]
    assert one(rows, "r string", urls.parse_pairs(F.col("r"))) == [{"a": "2", "b": "x=y", "": "e"}, {}, {}]


def test_cosine(one):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0, 5.0], [1.0, 1.0]), ([0.0], [1.0])]
    got = one(rows, "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(2 / (27**0.5 * 2**0.5))
    assert got[2] is None


def test_summaries(one):
    def of(json):
        return one([(json,)], "m string", metadata.summaries(metadata.parse_metadata(F.col("m"))))[0]

    assert of('{"summary": "s"}') == {"default": "s"}
    assert of('{"summary": "s", "summaries": {"default": "d"}}') == {"default": "d"}
    assert of('{"summary": "s", "summaries": {"eli5": "e"}}') == {"eli5": "e", "default": "s"}
    assert of('{"summary": ""}') == {}
    assert of("{}") == {}


def test_pick_summary(one):
    rows = [
        ('{"summaries": {"default": "d", "a": "x"}}',),
        ('{"summaries": {"longer": "l", "b": "first", "c": "second"}}',),
        ('{"summaries": {"b": ""}, "summary": "old"}',),
        ('{"summary": "old"}',),
        ("{}",),
    ]
    got = one(rows, "m string", metadata.pick_summary(metadata.parse_metadata(F.col("m"))))
    assert got == ["d", "first", "old", "old", None]


def test_error_text(one):
    rows = [('{"error_message": "m", "error": "e"}',), ('{"error_message": "", "error": "e"}',), (" body ",), ("  ",), ("[1]",), ("{}",)]
    assert one(rows, "b string", metadata.error_text(F.col("b"))) == ["m", "e", "body", None, None, None]


def test_time_bound():
    now = datetime(2024, 1, 30, 12, 34, 56, 789)
    assert time_bound("today", now) == datetime(2024, 1, 30)
    assert time_bound("24h", now) == datetime(2024, 1, 29, 12, 34, 56)
    assert time_bound("week", now) == datetime(2024, 1, 23, 12, 34, 56)
    assert time_bound("month", now) is None and time_bound(None, now) is None


def test_audio_enclosure(one):
    rows = [([("v", "video/mp4"), ("a", "audio/mpeg"), ("b", "audio/ogg")],), ([("n", None)],), ([],), (None,)]
    column = audio_enclosure(F.col("e"))["url"]
    assert one(rows, "e array<struct<url:string,mime_type:string>>", column) == ["a", None, None, None]


def test_shown_tags(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["x", "y", "z"]), (None, ["x"])], "o array<string>, m array<string>")
    shown, more = shown_tags(F.col("o"), F.col("m"))
    assert [tuple(r) for r in df.select(shown, more).collect()] == [(["a", "b", "c", "d", "x"], 2), (["x"], 0)]


def test_rules_json(one):
    with pytest.raises(ValueError):
        parse_rules('{"field": "x"}')
    with pytest.raises(ValueError):
        parse_rules("[")
    assert parse_rules("") == ()
    got = one([('[{"field":"title","op":"equals","value":"x"}]',), ("nonsense",)], "j string", valid_rules(F.col("j")))
    assert [tuple(r) for r in got[0]] == [("title", "equals", "x")]
    assert not got[1] or got[1][0]["op"] is None
