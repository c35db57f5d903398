"""Substring search over stored runs of three characters, so a search reads few postings instead of every text.

Postings say which entries hold a run. They are cut by run and entry, so a very common run spreads over files, each
of which is sorted by run, so a search reads the folders and row groups of its own runs alone. Candidates are verified against the
entries as they are: postings of old texts cost time, never a wrong result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.text import text_or_empty
from articleflow.operators.entries import search_condition
from articleflow.operators.sizing import spread

_RUN = 3


def _haystack() -> Column:
    return F.lower(F.concat_ws("\n", text_or_empty(F.col("title")), text_or_empty(F.col("content"))))


def runs_of(text: Column) -> Column:
    """Distinct runs of three characters, in time linear in the text."""

    def run(chars: Column) -> Column:
        at = F.filter(F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2))), lambda r: r.isNotNull())
        return F.array_distinct(at)

    return F.get(F.transform(F.array(F.split(text, "")), run), F.lit(0))


@dataclass
class SearchIndex:
    """Postings and counts of runs below ``path``; ``buckets`` folders hold the postings of each addition, in up to
    ``slices`` files by entry; ``rarest`` runs are looked up."""

    spark: SparkSession
    path: str
    buckets: int = 64
    rarest: int = 3
    slices: int = 16

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("run"), F.lit(self.buckets)).cast("int").alias("bucket")

    def add(self, entries: DataFrame) -> None:
        """Files new or changed entries: entry_id, title, content. Ids may repeat, texts may be null.

        The runs of a text are made once: files are dealt by hash, and counts are read from what was written.
        """
        held = spread(entries.select("entry_id", "title", "content")).select("entry_id", F.explode(runs_of(_haystack())).alias("run"))
        part = F.pmod(F.xxhash64("entry_id"), F.lit(self.slices))
        rows = held.select(self._bucket(), "run", "entry_id").repartition("bucket", part)
        added = f"{self.path}/postings/added=a{uuid.uuid4().hex}"
        rows.sortWithinPartitions("bucket", "run", "entry_id").write.partitionBy("bucket").parquet(added)
        counts = self.spark.read.schema(rows.schema).parquet(added).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("run").sortWithinPartitions("run").write.mode("append").parquet(f"{self.path}/runs")

    def _wanted(self, text: str) -> list[str] | None:
        """Runs to look up, the rarest of the search; None where a run of it is in no entry.

        At most one row per run of the search comes to the driver.
        """
        words = [w.lower() for w in text.split() if len(w) >= _RUN]
        if not words:
            return []
        asked = self.spark.createDataFrame([(w,) for w in words], "word string").select(F.explode(runs_of(F.col("word"))).alias("run"))
        runs = sorted({r["run"] for r in asked.collect()})
        stored = self.spark.read.parquet(f"{self.path}/runs").where(F.col("run").isin(runs))
        found = stored.groupBy("run").agg(F.sum("n").alias("n")).collect()
        if len(found) < len(runs):
            return None
        return [r["run"] for r in sorted(found, key=lambda r: (r["n"], r["run"]))[: self.rarest]]

    def candidates(self, text: str) -> DataFrame | None:
        """Ids of entries that hold the rarest runs of the search; None where no word has three characters."""
        wanted = self._wanted(text)
        if wanted == []:
            return None
        postings = self.spark.read.parquet(f"{self.path}/postings")
        if wanted is None:
            return postings.where(F.lit(False)).select("entry_id")
        numbers = self.spark.createDataFrame([(w,) for w in wanted], "run string").select(self._bucket()).distinct().collect()
        rows = postings.where(F.col("bucket").isin([r["bucket"] for r in numbers]) & F.col("run").isin(wanted))
        ids = rows.groupBy("entry_id").agg(F.count_distinct("run").alias("held"))
        return ids.where(F.col("held") == len(wanted)).select("entry_id")

    def search(self, entries: DataFrame, text: str) -> DataFrame:
        """The entries that hold every word of the search in title or content, ignoring case: as a scan finds them.

        A search without a word of three characters scans; an empty one keeps every entry.
        """
        if not text.split():
            return entries
        ids = self.candidates(text)
        if ids is not None:
            ids = ids.withColumnRenamed("entry_id", "_candidate")
            entries = entries.join(ids, F.col("entry_id").eqNullSafe(F.col("_candidate")), "left_semi")
        return entries.where(search_condition(text))
