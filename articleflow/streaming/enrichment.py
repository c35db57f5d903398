"""Enrichment as a stream of its own: every distinct text is asked for once, failures wait in a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow.operators.enrich import call_model
from articleflow.session import cut_lineage


@dataclass
class EnrichJob:
    """A streaming query from stored snapshots to the answers of a model.

    ``snapshots`` is a stream with ``content_hash`` and the columns ``prompt`` is made of; ``fn`` answers a
    list of prompts, ``kind`` is the type of an answer. The query has a checkpoint of its own, so slow or
    failing answers never hold up the ingest. Content hashes asked for are streaming state: a text that comes
    again, in another entry or after a restart, is not asked for again.

    ``<out>/results/run=<run>`` holds content_hash and value, ``<out>/failures/run=<run>`` content_hash,
    prompt, error and attempts of the answers that failed. ``retry`` asks for open failures again, up to
    ``attempts`` times in all. A batch that is repeated keeps the answers it has already written.
    """

    snapshots: DataFrame
    fn: Callable[[list[str]], list]
    prompt: Column
    out: str
    checkpoint: str
    kind: str = "string"
    attempts: int = 3

    def _answer(self, asked: DataFrame, run: str) -> None:
        """``asked``: content_hash, prompt, attempts so far."""
        spark = asked.sparkSession
        path = f"{self.out}/answers/run={run}"
        if not _written(spark, path):
            answered = call_model(asked, self.fn, F.col("prompt"), "value", self.kind)
            answered.write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        good = made.where("value_error is null").select("content_hash", "value")
        good.write.mode("overwrite").parquet(f"{self.out}/results/run={run}")
        bad = made.where("value_error is not null").select(
            "content_hash", "prompt", F.col("value_error").alias("error"), (F.col("attempts") + 1).alias("attempts")
        )
        bad.write.mode("overwrite").parquet(f"{self.out}/failures/run={run}")

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        self._answer(batch.select("content_hash", "prompt", F.lit(0).alias("attempts")), f"b{batch_id:012d}")

    def start(self) -> StreamingQuery:
        """Answer all texts at hand that were not asked for yet."""
        new = self.snapshots.select("content_hash", self.prompt.alias("prompt"))
        new = new.where("content_hash is not null and prompt is not null").dropDuplicates(["content_hash"])
        writer = new.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint)
        return writer.foreachBatch(self._process).trigger(availableNow=True).start()

    def failures(self, spark: SparkSession) -> DataFrame:
        """The last failure of every content hash that has no answer yet."""
        failed = spark.read.parquet(f"{self.out}/failures")
        answered = spark.read.parquet(f"{self.out}/results").select("content_hash")
        last = failed.groupBy("content_hash").agg(F.max_by(F.struct("prompt", "error", "attempts"), "attempts").alias("f"))
        return last.join(answered, "content_hash", "left_anti").select("content_hash", "f.*")

    def retry(self, spark: SparkSession) -> None:
        """Ask again for what failed, if it may be asked for again."""
        again = self.failures(spark).where(F.col("attempts") < self.attempts)
        again = cut_lineage(again.select("content_hash", "prompt", "attempts"))
        last = spark.read.parquet(f"{self.out}/failures").agg(F.max("run").alias("run")).first().run
        if last is not None and not again.isEmpty():
            self._answer(again, f"{last}r")

    def enriched(self, snapshots: DataFrame) -> DataFrame:
        """``snapshots`` with ``value``, and ``attempts`` and ``error`` where there is no answer yet."""
        spark = snapshots.sparkSession
        results = spark.read.parquet(f"{self.out}/results").select("content_hash", "value")
        failed = self.failures(spark).select("content_hash", "attempts", "error")
        return snapshots.join(results, "content_hash", "left").join(failed, "content_hash", "left")


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a run's answers were written to the end."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
