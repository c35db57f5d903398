"""Selectors over numbered elements, against results written out by hand."""

from __future__ import annotations

import pytest

from articleflow.operators.selectors import select_elements, selector_steps

PAGE = """<html><body>
<nav><ul><li>one<li class="x">two</li><li>three</li></ul></nav>
<!-- c --><div class=" side bar ">ad <b>now</b></div>
<main><h2>A</h2><p>a1</p><p id="q">a2 <i>it</i></p><h2>B</h2><img src="i"><p>b1<div>in</div></main>
<footer><p>end</p></footer></body></html>"""

CASES = [
    ("//li", ["one", "two", "three"]),
    ("//li[2]", ["two"]),
    ("//li[last()]", ["three"]),
    ("//li[last()-1]", ["two"]),
    ("//li[last()-5]", []),
    ("//li[0]", []),
    ("//li[position()>1]", ["two", "three"]),
    ("//li[position()<=2]", ["one", "two"]),
    ("//li[position()!=2]", ["one", "three"]),
    ("//li[position()<9]", ["one", "two", "three"]),
    ("//li[not(@class)][2]", ["three"]),
    ("//li[@class='x' or text()='three']", ["two", "three"]),
    ("//li[not(@class='x' or .='one')]", ["three"]),
    ("//li[@class!='y']", ["two"]),
    ("//main/*[i]", ["a2 it"]),
    ("//p[contains(., 'it') and starts-with(text(), 'a2')]", ["a2 it"]),
    ("//*[contains(concat(' ', normalize-space(@class), ' '), ' bar ')]", ["ad now"]),
    ("//div[normalize-space()='ad now']", ["ad now"]),
    ("//h2[.='A']/following-sibling::p", ["a1", "a2 it", "b1"]),
    ("//h2/following-sibling::p[1]", ["a1", "b1"]),
    ("//h2[1]/following-sibling::p[3]", ["b1"]),
    ("//h2[2]/preceding-sibling::*[1]", ["a2 it"]),
    ("//h2[2]/preceding-sibling::p", ["a1", "a2 it"]),
    ("//i/ancestor::p", ["a2 it"]),
    ("//i/..", ["a2 it"]),
    ("//i/parent::p/following::p", ["b1", "end"]),
    ("//footer/preceding::p", ["a1", "a2 it", "b1"]),
    ("//main/descendant::i", ["it"]),
    ("//p/self::p[@id]", ["a2 it"]),
    ("/html/body/footer/p", ["end"]),
    ("/body", []),
    ("//main/div", ["in"]),
    (".//b", ["now"]),
]


@pytest.fixture(scope="module")
def picked(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no tags")], "id int, html string")
    rows = select_elements(pages, [c[0] for c in CASES]).orderBy("id", "selector", "place").collect()
    assert {r["id"] for r in rows} == {1}
    out: dict = {}
    for r in rows:
        out.setdefault(r["selector"], []).append(r["text"].strip())
    return out


@pytest.mark.parametrize("selector,texts", CASES)
def test_selected(picked, selector, texts):
    assert picked.get(selector, []) == texts


@pytest.mark.parametrize(
    "selector",
    ["", "  ", "p", "//p[", "//p[@id=]", "//p[foo()]", "//p/@id", "//h2/following::p[2]", "//h2/following-sibling::p[not(1)]",
     "//h2/following-sibling::p[position()>1]", "//p[1]extra", "//attribute::id"],
)
def test_not_understood(spark, selector):
    assert selector_steps(selector) is None
    with pytest.raises(ValueError):
        select_elements(spark.createDataFrame([(1, PAGE)], "id int, html string"), [selector])


def test_clashing_columns_and_empty_tables(spark):
    schema = "place string, text string, html string, extra int"
    one = select_elements(spark.createDataFrame([("a", "b", PAGE, 7)], schema), ["//i"]).collect()
    assert [r.asDict() for r in one] == [{"extra": 7, "selector": "//i", "place": 1, "tag": "i", "text": "it"}]
    assert select_elements(spark.createDataFrame([], schema), ["//i"]).count() == 0
