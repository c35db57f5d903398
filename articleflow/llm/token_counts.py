"""Token counts through a cache of digests: only contents never counted before are encoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm.bpe import Tokenizer
from articleflow.llm.common import map_slices, shared
from articleflow.session import work_folder


class TokenCountCache:
    """Stored counts below one folder, a partition per tokenizer version.

    A row is (content digest, number of tokens). Rows are only ever appended; if two jobs append
    the same digest at the same time, both rows hold the same count.
    """

    SCHEMA = "content binary, n_tokens long, tokenizer string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stored(self, tokenizer: Tokenizer) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).option("pathGlobFilter", "*.parquet")
        return (
            rows.parquet(self.path)
            .where(F.col("tokenizer") == tokenizer.digest)
            .select("content", "n_tokens")
        )

    def append(self, counts: DataFrame, tokenizer: Tokenizer) -> None:
        rows = counts.select("content", "n_tokens", F.lit(tokenizer.digest).alias("tokenizer"))
        rows.write.mode("append").partitionBy("tokenizer").parquet(self.path)

    def create(self) -> None:
        """An empty cache, if there is none: an append of no rows makes the folder."""
        self.spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)


def count_tokens(
    docs: DataFrame,
    tokenizer: Tokenizer,
    cache: TokenCountCache | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``.

    A null text counts as empty. Normalising content means just that: any other change of a text
    could change its tokens. Ids may be null or repeat; other columns are ignored. Equal texts are
    encoded once. Without a cache a new one below the shared folder is used.
    """
    spark = docs.sparkSession
    if cache is None:
        cache = TokenCountCache(spark, work_folder(spark))
    cache.create()
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("content", F.unhex(F.sha2("text", 256)))
    keys = shared(texts.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    first = keys.groupBy("content").agg(F.min("id").alias("rep"))
    misses = first.join(cache.stored(tokenizer), "content", "left_anti")
    # The small side is hashed and texts pass by unsorted; each distinct miss keeps its first id.
    missing = texts.alias("t").join(
        misses.hint("shuffle_hash").alias("m"),
        F.col("t.id").eqNullSafe(F.col("m.rep")) & (F.col("t.content") == F.col("m.content")),
        "left_semi",
    )

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = tokenizer.encoder()
        counts = [len(encoder.ids(text)) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
        )

    counted = map_slices(missing.select("content", "text"), encode, "content binary, n_tokens long")
    cache.append(counted, tokenizer)
    counts = cache.stored(tokenizer).join(first, "content", "left_semi")
    counts = shared(counts.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    # Both sides are plain tables, so Spark may split the partition of a very common content.
    return keys.join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
