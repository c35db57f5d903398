"""Decisions that depend on the size of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A row of a dimension here is a few numbers and short strings, so this is well under 100 MB.
BROADCAST_ROWS = 200_000


def fits(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``max_rows`` rows. The count stops at the bound."""
    narrow = small.select(F.lit(1).alias("one"))
    return narrow.limit(max_rows + 1).count() <= max_rows


def attach(
    facts: DataFrame,
    dimension: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join wide facts with a table expected to be small.

    Within the bound the small side is broadcast and the facts are not shuffled. Beyond it the
    join is left to Spark, which sorts both sides by key and splits skewed partitions at run time.
    """
    if fits(dimension, max_rows):
        dimension = F.broadcast(dimension)
    return facts.join(dimension, on, how)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly work per row, if the input is too small to be split.

    A file below the split size is read by one task. The test uses the size Spark estimates from
    file metadata; inputs that give every core a full split pass through without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < split * cores else df
