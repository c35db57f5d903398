"""Markdown export of entries."""

from __future__ import annotations

import re
from articleflow.functions.htmlparse import PageParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions.text import safe_filename, text_or_empty
from articleflow.operators.entries import tags_per_entry
from articleflow.operators.sizing import attach
from articleflow.operators.versions import latest_snapshots

_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
_BLOCKS = {"p", "div", "article", "section", "table", "tr", "figure", "figcaption", "ul", "ol"}
_SKIP = {"script", "style"}


class _Writer(PageParser):
    """Collects the Markdown of one article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.skip = 0
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            mark = "* " if number is None else f"{number + 1}. "
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "a":
            self.links.append(at.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{at.get('alt') or ''}]({at.get('src') or ''})")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in _MARKS and not self.pre:
            self.out.append(_MARKS[tag])
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in _MARKS and not self.pre:
            self.out.append(_MARKS[tag])
        elif tag in _BLOCKS or re.fullmatch("h[1-6]|blockquote", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def _markdown(body: str | None) -> str:
    writer = _Writer()
    writer.feed(body or "")
    writer.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(writer.out)).strip()


@F.pandas_udf(T.StringType())
def to_markdown(bodies: pd.Series) -> pd.Series:
    return bodies.map(_markdown, na_action="ignore")


def front_matter() -> Column:
    title = F.replace(F.coalesce("title", F.lit("Untitled")), F.lit('"'), F.lit('\\"'))
    parts = [
        F.lit('---\ntitle: "'),
        title,
        F.lit('"\nauthor: "'),
        text_or_empty(F.col("author")),
        F.lit('"\nurl: "'),
        text_or_empty(F.col("url")),
        F.lit('"\nfeed: "'),
        text_or_empty(F.col("feed_title")),
        F.lit('"\ndate: "'),
        text_or_empty(F.date_format("published_at", "yyyy-MM-dd")),
        F.lit('"\ntags: ['),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "),
        F.lit("]\n---\n\n"),
    ]
    return F.concat(*parts)


def export_markdown(
    entries: DataFrame, feeds: DataFrame, snapshots: DataFrame, tags: DataFrame
) -> DataFrame:
    """(entry_id, filename, head, body_html) of every entry; the stored version before the feed's."""
    stored = latest_snapshots(snapshots.select("entry_id", "version", "content_html")).select(
        "entry_id", "content_html", F.lit(True).alias("_stored")
    )
    named = attach(entries, feeds.select("feed_id", F.col("title").alias("feed_title")), "feed_id")
    joined = named.join(stored, "entry_id", "left").join(tags_per_entry(tags), "entry_id", "left")
    return joined.select(
        "entry_id",
        safe_filename(F.coalesce("title", F.lit("Untitled"))).alias("filename"),
        front_matter().alias("head"),
        F.when(F.col("_stored"), F.col("content_html")).otherwise(F.col("content")).alias("body_html"),
    )


def markdown_documents(exported: DataFrame) -> DataFrame:
    return exported.select(
        "entry_id",
        "filename",
        F.concat("head", F.coalesce(to_markdown(F.col("body_html")), F.lit(""))).alias("document"),
    )
