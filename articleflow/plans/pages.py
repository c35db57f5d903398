"""Queries: elements of web pages by selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators import extraction, selectors
from articleflow.plans.registry import query
from articleflow.sources.readerviews import ReaderViews

_TEXT = """trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'),
    '\\s+', ' ', 'g'))"""

_PARTS = """parts AS (
    SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1, 's') AS li,
           string_split(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<p>')[2:] AS p,
           regexp_extract(html, '<article><h1>(.*?)</h1>', 1, 's') AS h1,
           regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad FROM pages)"""


@query(
    "page_elements",
    f"""WITH {_PARTS},
        found AS (
          SELECT page_id, '//nav/ul/li[2]/a' AS selector, 1 AS place, 'a' AS tag, li[2] AS t FROM parts WHERE len(li) > 1
          UNION ALL SELECT page_id, '//nav//li[last()]/a[contains(@href, "/")]', 1, 'a', li[-1] FROM parts WHERE len(li) > 0
          UNION ALL SELECT page_id, '//h1/following-sibling::p[1]', 1, 'p', p[1] FROM parts WHERE len(p) > 0
          UNION ALL SELECT page_id, '//article/p[last()]', 1, 'p', p[-1] FROM parts WHERE len(p) > 0
          UNION ALL SELECT page_id, '//footer/preceding::h1', 1, 'h1', h1 FROM parts
          UNION ALL SELECT page_id, '//div[@class="ad" and not(contains(., "q"))]', 1, 'div', ad FROM parts WHERE NOT contains(ad, 'q')
          UNION ALL SELECT page_id, '//article/p[position()>1 and not(b)]', CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER),
                           'p', t
                    FROM (SELECT page_id, unnest(p[2:]) AS t, generate_subscripts(p[2:], 1) AS i FROM parts)
                    WHERE NOT starts_with(t, '<b>'))
        SELECT page_id, selector, place, tag, {_TEXT} AS text FROM found""",
)
def page_elements(v: ReaderViews) -> DataFrame:
    """Elements of every page by selectors with places, ``and``, ``not()``, siblings and preceding elements."""
    asked = [
        "//nav/ul/li[2]/a",
        '//nav//li[last()]/a[contains(@href, "/")]',
        "//h1/following-sibling::p[1]",
        "//article/p[last()]",
        "//footer/preceding::h1",
        '//div[@class="ad" and not(contains(., "q"))]',
        "//article/p[position()>1 and not(b)]",
    ]
    found = selectors.select_elements(v.table("pages").select("page_id", "html"), asked)
    return found.withColumn("text", F.btrim(F.regexp_replace("text", "\\s+", " ")))


@query(
    "extract_by_place",
    f"""WITH {_PARTS},
        shown AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN p[1] WHEN 1 THEN p[-1] ELSE h1 END AS t FROM parts)
        SELECT page_id, 0 AS unsupported, {_TEXT} AS picked FROM shown""",
)
def extract_by_place(v: ReaderViews) -> DataFrame:
    """What each feed's own selector picks on its pages, after removals by place."""
    pages = v.table("pages").selectExpr("page_id", "page_id % 3 AS feed_id", "url", "html")
    config = pages.selectExpr(
        "feed_id",
        """named_struct('content_xpath', CASE feed_id WHEN 0 THEN '//h1/following-sibling::p[1]' WHEN 1 THEN '//article/p[last()]'
                                         ELSE '//article/*[not(self)][1]' END,
             'unwrap_tags', array(), 'remove_tags', array(), 'remove_xpath', array('//footer[1]', '//div[@class="ad"][last()]')) AS extract_rules""",
    ).distinct()
    out = extraction.extract_articles(pages, extraction.compile_rules(config), selected=True)
    picked = F.btrim(F.regexp_replace("selected_text", "\\s+", " "))
    return out.select("page_id", F.size("unsupported").alias("unsupported"), picked.alias("picked"))
