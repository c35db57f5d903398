import pytest

from articleflow.functions.htmlparse import PageParser


class Seen(PageParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(tag)

    def handle_data(self, data):
        self.found.append(data)


@pytest.mark.parametrize("bad", ["<![x y]>", "<![if !IE]>", "<![CDATA[a]]>", "<![endif]>", "<![9>"])
def test_unknown_sections_are_comments(bad):
    parser = Seen()
    parser.feed(f"<p>one{bad}<b>two")
    parser.close()
    assert parser.found == ["p", "one", "b", "two"]


def test_pages_with_unknown_sections(spark):
    from articleflow.operators.discovery import discover_links
    from articleflow.operators.extraction import extract_articles

    html = '<p>one</p><![x y]><link rel="alternate" type="application/rss+xml" href="/f.xml"><p>two</p>'
    pages = spark.createDataFrame([("http://a.org/", html), ("http://b.org/", "<![x")], "url string, html string")
    assert len(extract_articles(pages).collect()) == 2
    assert [r for r in discover_links(pages).collect() if "f.xml" in str(r)]
