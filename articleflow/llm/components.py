"""Connected components of a link table, by smallest label and jumps to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import shared


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (its smallest id) of every id in ``links`` (columns ``a``, ``b``).

    Only narrow rows move. Every round's tables are stored, so joins start from plain tables whose
    crowded partitions Spark may split, and a lost executor costs one round at most.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null")
    both = shared(both)
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    label = shared(label.select("id", F.least("id", "low").alias("component")))
    while True:
        far = label.select(F.col("id").alias("b"), F.col("component").alias("low"))
        low = both.join(far, "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low"))
        spread = shared(
            label.join(low, "id").select(
                "id",
                F.least("component", "low").alias("component"),
                (F.col("low") < F.col("component")).alias("moved"),
            )
        )
        if spread.where("moved").isEmpty():
            return spread.select("id", "component")
        up = spread.select(F.col("id").alias("component"), F.col("component").alias("top"))
        label = shared(
            spread.join(up, "component", "left").select(
                "id", F.coalesce("top", "component").alias("component")
            )
        )
