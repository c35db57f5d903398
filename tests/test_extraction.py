"""Article extraction, feed documents, outlines and Markdown on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from articleflow.operators import extraction
from articleflow.operators.extraction import glob_pattern, xpath_pattern
from articleflow.sources import feedxml, markdown, outline

import re

LONG = "This sentence stands for the body of an article and has clearly more than sixteen words in it, as bodies do."
MENU = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8))

PAGE = f"""<html><head><title>T</title><style>p {{}}</style><script>var a = "<p>x</p>";</script></head><body>
<nav><ul>{MENU}</ul></nav><div class="links"><ul>{MENU}</ul></div>
<aside><p>{LONG} ASIDE</p></aside>
<div class="box sidebar"><p>{LONG} SIDEBAR</p></div>
<div class="my-sidebar-widget"><p>{LONG} WIDGET</p></div>
<div role="complementary"><p>{LONG} COMPLEMENTARY</p></div>
<article id="main"><h1>Head line</h1><p>{LONG} ONE <a href="/x">link</a></p>
<p>{LONG} TWO</p><img src="/pic one.png" alt="A &amp; B"><widget-ad><p>{LONG} PROMO</p></widget-ad>
<custom-box><p>{LONG} BOXED</p></custom-box></article>
<div class="post"><p>{LONG} POST</p></div>
<footer><p>(c) 2024</p></footer></body></html>"""

SCHEMA = "feed_id bigint, url string, html string"
RULES = (
    "feed_id bigint, extract_rules struct<content_xpath:string,unwrap_tags:array<string>,"
    "remove_tags:array<string>,remove_xpath:array<string>>"
)


def extract(spark, html, rules=None, **kw):
    pages = spark.createDataFrame([(1, "https://h.org/d/p", html)], SCHEMA)
    config = None
    if rules is not None:
        full = {"content_xpath": None, "unwrap_tags": [], "remove_tags": [], "remove_xpath": [], **rules}
        config = extraction.compile_rules(spark.createDataFrame([(1, tuple(full.values()))], RULES))
    return extraction.extract_articles(pages, config, **kw).first()


def test_boilerplate_goes_content_stays(spark):
    row = extract(spark, PAGE)
    assert row["fetched"] and not row["too_short"] and not row["missed_start"]
    for word in ("ASIDE", "SIDEBAR", "WIDGET", "COMPLEMENTARY", "Section", "(c) 2024", "var a"):
        assert word not in row["content_text"] and word not in row["content_html"]
    for word in ("Head line", "ONE", "TWO", "PROMO", "BOXED", "POST"):
        assert word in row["content_text"] and word in row["content_html"]
    assert '<img src="/proxy/image?url=https%3A%2F%2Fh.org%2Fpic%20one.png" alt="A &amp; B">' in row["content_html"]
    assert '<a href="/x">link</a>' in row["content_html"]
    assert "<custom-box" not in row["content_html"] and "<h1>" in row["content_html"]
    assert len(row["content_hash"]) == 64


def test_images_without_proxy_and_special_sources(spark):
    body = f"<p>{LONG}</p><img src='data:xx'><img src='/proxy/image?url=y'><img src='z.png'>"
    assert '"data:xx"' in extract(spark, body)["content_html"]
    row = extract(spark, f"<p>{LONG}</p><img src='/proxy/image?url=y'>")
    assert '<img src="/proxy/image?url=y" alt="">' in row["content_html"]
    row = extract(spark, f"<p>{LONG}</p><img src='z.png'>", proxy_images=False)
    assert '<img src="https://h.org/d/z.png" alt="">' in row["content_html"]


def test_removal_rules(spark):
    row = extract(spark, PAGE, {"remove_tags": ["widget-*"], "remove_xpath": ['//div[@class="post"]']})
    assert "PROMO" not in row["content_text"] and "POST" not in row["content_text"]
    assert "BOXED" in row["content_text"] and row["unsupported"] == []


def test_selector(spark):
    row = extract(spark, PAGE, {"content_xpath": "//article[@id='main']"})
    assert "ONE" in row["content_html"] and "POST" not in row["content_html"]
    missing = extract(spark, PAGE, {"content_xpath": "//section"})
    assert "POST" in missing["content_html"]


def test_selector_takes_first_match(spark):
    html = f"<div class='c'><p>{LONG} A</p></div><div class='c'><p>{LONG} B</p></div>"
    row = extract(spark, html, {"content_xpath": "//div[@class='c']"})
    assert " A<" in row["content_html"] and " B<" not in row["content_html"]
    # The selected part has less than 40 % of the text for three such parts: the text's HTML wins.
    more = extract(spark, html + f"<div><p>{LONG} C</p></div>", {"content_xpath": "//div[@class='c']"})
    assert more["too_short"] and " C<" in more["content_html"]


def test_missed_start(spark):
    html = f"<div><p>{LONG} A</p></div><div class='c'><p>{LONG} B {LONG}</p></div>"
    row = extract(spark, html, {"content_xpath": "//div[@class='c']"})
    assert row["missed_start"] or row["too_short"] is False
    start = extract(spark, html.replace("This sentence stands", "Quite another start", 1), {"content_xpath": "//div[@class='c']"})
    assert start["missed_start"] and "Quite another start" in start["content_html"]


def test_unwrap_frees_blocks_from_selectors(spark):
    rules = {"remove_xpath": ["//custom-box"]}
    assert "BOXED" not in extract(spark, PAGE, rules)["content_text"]
    assert "BOXED" in extract(spark, PAGE, {**rules, "unwrap_tags": ["custom-box"]})["content_text"]


def test_unsupported_selector_is_reported(spark):
    row = extract(spark, PAGE, {"content_xpath": "//div[position()>count(//p)]", "remove_xpath": ["count(//p)"]})
    assert row["unsupported"] == ["//div[position()>count(//p)]", "count(//p)"] and "ONE" in row["content_html"]


@pytest.mark.parametrize("html", [None, "", "<p></p>", "<script>x</script>", "<nav><p>" + LONG + "</p></nav>"])
def test_nothing_to_extract(spark, html):
    row = extract(spark, html)
    assert not row["fetched"] and row["content_text"] is None and row["content_hash"] is None


def test_broken_markup(spark):
    row = extract(spark, f"<div><p>{LONG} ONE<p>{LONG} TWO</b></span></div><p>{LONG} THREE")
    assert [w for w in ("ONE", "TWO", "THREE") if w in row["content_text"]] == ["ONE", "TWO", "THREE"]
    assert row["content_text"].count("\n") == 2


def test_inline_tags_are_closed(spark):
    row = extract(spark, f"<p><b>{LONG} <i>x</b> y<p>{LONG}</i>")
    assert row["content_html"] == f"<p><b>{LONG} <i>x</i></b> y</p><p>{LONG}</p>"


def test_selectors_with_places(spark):
    row = extract(spark, PAGE, {"content_xpath": "//article/p[2]"})
    assert row["content_html"].count(LONG) >= 1 and not row["unsupported"]
    row = extract(spark, PAGE, {"content_xpath": "//div[.//p]"})
    assert row["unsupported"] == ["//div[.//p]"]
    page = f"<div><p>{LONG} A</p></div><div><p>{LONG} B</p></div><div><p>{LONG} C</p></div>"
    row = extract(spark, page, {"remove_xpath": ["//div[p][2]", "//nothing[1]", "//div[last()]"]})
    assert row["content_text"] == f"{LONG} A" and not row["unsupported"]
    row = extract(spark, page, {"remove_xpath": ["//div[1]"], "content_xpath": "/div[1]"})
    assert row["content_html"] == f"<p>{LONG} B</p>" or row["missed_start"] or row["too_short"]
    row = extract(spark, page, {"content_xpath": "//p[contains(text(), ' B')]/ancestor::div"})
    assert row["too_short"] and not row["unsupported"]
    row = extract(spark, "<body><p>x</p><aside><i>y</i></aside><p>" + LONG + "</p></body>", {"content_xpath": "/body/p[2]"}, selected=True)
    assert row["selected_text"] == LONG


def test_known_pages_are_left_out(spark):
    pages = spark.createDataFrame([(1, "https://a", f"<p>{LONG}</p>"), (1, "https://b", f"<p>{LONG}</p>")], SCHEMA)
    first = extraction.extract_articles(pages)
    known = first.where("url = 'https://a'").select("url", "source_hash")
    assert [r["url"] for r in extraction.extract_articles(pages, known=known).collect()] == ["https://b"]


@pytest.mark.parametrize(
    "xpath,path,hit",
    [
        ("//article", "/html#1/body#2/article#3", True),
        ("//article", "/html#1/articles#3", False),
        ("/html/body", "/html#1/body#2/p#3", True),
        ("/body", "/html#1/body#2", False),
        ("//div/p", "/div#1/span#2/p#3", False),
        ("//div//p", "/div#1/span#2/p#3", True),
        ("//*[@id='x']", '/div#1{id="x"}', True),
        ("//div[@class='a b']", '/div#1{class="a b"}', True),
        ("//div[@class='a']", '/div#1{class="a b"}', False),
        ("//div[contains(@class,'a')][@id]", '/div#1{class="xay"}{id="q"}', True),
        ("//div[contains(@class,'a')][@id]", '/div#1{class="xay"}', False),
    ],
)
def test_xpath_patterns(xpath, path, hit):
    assert bool(re.match(xpath_pattern(xpath), path)) is hit


def test_pattern_edges():
    assert xpath_pattern(None) is None and xpath_pattern(" ") is None and xpath_pattern("//a[1]") is None
    assert re.search(glob_pattern("widget-*"), "/div#1/widget-ad#2") and not re.search(glob_pattern("h?"), "/html#1/hr2#3")


# --- feed documents ----------------------------------------------------------------------------

RSS = "<rss><channel><title>C</title>" + "".join(f"<item><title> T{i} </title><pubDate>D{i}</pubDate></item>" for i in range(5)) + "</channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><updated>U</updated><published>P</published></entry><entry><title/></entry><entry><published>only</published></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="http://r" xmlns:dc="http://d" xmlns="http://s"><item><title>R</title><dc:date>X</dc:date></item></rdf:RDF>'


def test_feed_items(spark):
    bodies = [("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("json", '{"items": []}'), ("html", "<html><p>x</html>"), ("cut", RSS[:60]), ("none", None), ("empty", "")]
    out = feedxml.parse_feed_items(spark.createDataFrame(bodies, "url string, body string"))
    got = {}
    for r in out.orderBy("url", "pos").collect():
        got.setdefault(r["url"], []).append((r["title"], r["published"]))
    assert got == {
        "rss": [("T0", "D0"), ("T1", "D1"), ("T2", "D2")],
        "atom": [("A", "U"), ("", "only")],
        "rdf": [("R", "X")],
    }
    assert feedxml.parse_feed_items(spark.createDataFrame([("rss", RSS)], "url string, body string"), None).count() == 5


def test_outline_with_nested_groups(spark, tmp_path):
    path = tmp_path / "list.opml"
    path.write_text(
        """<?xml version="1.0"?><opml version="2.0"><head><title>x</title></head><body>
        <outline text="Top" type="rss" xmlUrl="https://t/f" htmlUrl="https://t"/>
        <outline text="News"><outline title="A" text="a" xmlUrl="https://a/f"/>
          <outline title="World"><outline text="B &amp; C" xmlUrl="https://b/f"/></outline></outline>
        <outline text="Empty"/></body></opml>"""
    )
    got = sorted(map(tuple, outline.read_outline(spark, str(path)).na.fill("-").collect()))
    assert got == [
        ("A", "https://a/f", "-", "News"),
        ("B & C", "https://b/f", "-", "World"),
        ("Top", "https://t/f", "https://t", "-"),
    ]
    with pytest.raises(ValueError):
        outline.read_outline(spark, str(path), depth=2)


def test_outline_is_ordered_and_escaped(spark):
    feeds = spark.createDataFrame([(1, 'Q"<', "https://q?a&b", None, 5), (2, "b", "https://b", "s", 4), (3, "A", "https://a", "s", 4)], "feed_id bigint, title string, feed_url string, site_url string, category_id bigint")
    groups = spark.createDataFrame([(4, "Zoo"), (5, "Art")], "category_id bigint, title string")
    lines = [r["line"] for r in outline.ordered_lines(outline.outline_lines(feeds, groups)).collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</body></opml>"
    assert [line.strip()[:19] for line in lines[2:-1]] == [
        '<outline text="Art"', '<outline type="rss"', "</outline>",
        '<outline text="Zoo"', '<outline type="rss"', '<outline type="rss"', "</outline>",
    ]
    assert 'text="Q&quot;&lt;"' in lines[3] and 'xmlUrl="https://q?a&amp;b"' in lines[3]
    assert 'text="A"' in lines[6] and 'text="b"' in lines[7]


def test_markdown(one):
    html = """<h2>Head</h2><p>One <b>bold</b> and <em>slanted</em> <a href="/u">link</a><br>next</p>
    <ul><li>x</li><li>y<ol><li>n</li></ol></li></ul><script>no</script><style>no</style>
    <blockquote>q</blockquote><pre>a
  b</pre><img src="i.png" alt="pic">"""
    (out,) = one([(html,)], "h string", markdown.to_markdown(F.col("h")))
    for part in ("## Head", "One **bold** and *slanted* [link](/u)", "* x", "* y", "  1. n", "> q", "```\na\n  b\n```", "![pic](i.png)"):
        assert part in out
    assert "no" not in out.split()
