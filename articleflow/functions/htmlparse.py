"""The HTML parser the operators share: no page may end a job."""

from __future__ import annotations

from html.parser import HTMLParser

# Fixed values of HTML: tags dropped with their content, tags without content, tags that end a paragraph.
DROPPED_TAGS = ("style", "script", "noscript")
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = set("p div ul ol li table blockquote pre h1 h2 h3 h4 h5 h6 section article aside nav figure header footer form".split())


class PageParser(HTMLParser):
    """Reads an unknown marked section (``<![x y]>``) as a comment, as browsers do."""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, 0)
