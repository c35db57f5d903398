"""Feed lists as OPML outlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTES = ("_text", "_title", "_type", "_xmlUrl", "_htmlUrl")


def _outline_type(depth: int) -> T.DataType:
    fields = [T.StructField(a, T.StringType()) for a in _ATTRIBUTES]
    if depth > 1:
        fields.append(T.StructField("outline", _outline_type(depth - 1)))
    return T.ArrayType(T.StructType(fields))


def read_outline(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """Feeds of an OPML file: title, feed_url, site_url, category (nearest group, or null).

    Groups may nest; each level is one explode. A level below ``depth`` raises instead of being
    lost.
    """
    schema = T.StructType([T.StructField("outline", _outline_type(depth + 1))])
    body = spark.read.format("xml").option("rowTag", "body").schema(schema).load(path)
    level = body.select(F.explode("outline").alias("o"), F.lit(None).cast("string").alias("category"))
    found = []
    name = F.coalesce("o._title", "o._text")
    for _ in range(depth):
        found.append(
            level.where("o._xmlUrl IS NOT NULL").select(
                F.coalesce(name, F.col("o._xmlUrl")).alias("title"),
                F.col("o._xmlUrl").alias("feed_url"),
                F.col("o._htmlUrl").alias("site_url"),
                "category",
            )
        )
        group = F.when(F.col("o._xmlUrl").isNull(), name).otherwise(F.col("category"))
        level = level.select(group.alias("category"), F.explode("o.outline").alias("o"))
    if not level.isEmpty():
        raise ValueError(f"outline nests deeper than {depth} levels")
    return reduce(DataFrame.unionByName, found)


def _escape(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def outline_lines(feeds: DataFrame, categories: DataFrame) -> DataFrame:
    """Lines of the outline in order: (part, category_title, category_id, kind, title, feed_id, line).

    Every line is a row that sorts into its place, so a group with very many feeds is never
    collected. Write with :func:`write_outline`.
    """
    named = feeds.join(
        categories.select("category_id", F.col("title").alias("category_title")),
        "category_id",
        "left",
    )
    attrs = [
        F.lit('    <outline type="rss" text="'),
        _escape(F.col("title")),
        F.lit('" title="'),
        _escape(F.col("title")),
        F.lit('" xmlUrl="'),
        _escape(F.col("feed_url")),
        F.lit('" htmlUrl="'),
        _escape(F.col("site_url")),
        F.lit('"/>'),
    ]
    feed_rows = named.select(
        F.lit(1).alias("part"),
        F.coalesce("category_title", F.lit("")).alias("category_title"),
        F.coalesce("category_id", F.lit(-1)).cast("bigint").alias("category_id"),
        F.lit(1).alias("kind"),
        "title",
        "feed_id",
        F.concat(*attrs).alias("line"),
    )
    groups = feed_rows.select("part", "category_title", "category_id").distinct()

    def edge(kind: int, line: Column) -> DataFrame:
        return groups.select(
            "part",
            "category_title",
            "category_id",
            F.lit(kind).alias("kind"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("bigint").alias("feed_id"),
            line.alias("line"),
        )

    head = F.concat(F.lit('  <outline text="'), _escape(F.col("category_title")), F.lit('">'))
    spark = feeds.sparkSession
    frame = spark.createDataFrame(
        [
            (0, "", -1, 0, None, None, '<?xml version="1.0" encoding="UTF-8"?>'),
            (0, "", -1, 1, None, None, '<opml version="2.0"><head><title>Feeds</title></head><body>'),
            (2, "", -1, 0, None, None, "</body></opml>"),
        ],
        feed_rows.schema,
    )
    return (
        frame.unionByName(edge(0, head))
        .unionByName(feed_rows)
        .unionByName(edge(2, F.lit("  </outline>")))
    )


def ordered_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy("part", "category_title", "category_id", "kind", F.lower("title"), "feed_id")


def write_outline(lines: DataFrame, path: str) -> None:
    """Sorted text parts; their concatenation in name order is the document."""
    ordered_lines(lines).select("line").write.mode("overwrite").text(path)
