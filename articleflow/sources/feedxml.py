"""Items of feed documents."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.operators.sizing import spread

# Element names of items and of their dates.
ITEM_NAMES = ("item", "entry")
DATE_NAMES = ("pubDate", "published", "updated", "date")


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _child_text(item: ElementTree.Element, names: tuple[str, ...]) -> str:
    found = next((c for c in item if _local(c.tag) in names), None)
    return ((found.text if found is not None else None) or "").strip()


def _items(body: str) -> Iterator[tuple[str, str]]:
    try:
        root = ElementTree.fromstring(body)
    except (ElementTree.ParseError, ValueError):
        return
    for element in root.iter():
        if _local(element.tag) in ITEM_NAMES:
            title, published = _child_text(element, ("title",)), _child_text(element, DATE_NAMES)
            if title or published:
                yield title, published


def parse_feed_items(bodies: DataFrame, limit: int | None = 3) -> DataFrame:
    """First items (url, pos, title, published) of RSS, RDF and Atom texts; broken texts have none.

    A document's items are numbered and cut where it is parsed, so nothing is shuffled.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, body in zip(batch["url"], batch["body"]):
                for pos, (title, published) in enumerate(_items(body), 1):
                    if limit is not None and pos > limit:
                        break
                    rows.append((url, pos, title, published))
            yield pd.DataFrame(rows, columns=["url", "pos", "title", "published"])

    xmlish = spread(bodies.where(F.contains("body", F.lit("<"))).select("url", "body"))
    return xmlish.mapInPandas(parse, "url string, pos int, title string, published string")
