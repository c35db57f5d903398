"""Keyed tables cut into hash buckets, so a change rewrites only the buckets its keys fall into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, LIVE = "_bucket", "_live"


@dataclass
class BucketedTable:
    """A Parquet table with one folder per bucket of its key; the key is unique, null counts as a value.

    ``buckets`` is fixed for the life of a table: a bucket should be a few files' worth of rows. The numbers of the
    buckets that change come to the driver, at most ``buckets`` of them.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int

    def _cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKET)
            .parquet(self.path)
        )

    def create(self, rows: DataFrame) -> None:
        """Stores a first state; keys must be unique."""
        self._write(self._cut(rows).withColumn(LIVE, F.lit(True)).repartition(BUCKET))

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().where(LIVE).drop(LIVE, BUCKET)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Stored rows with the given keys, from their buckets alone."""
        asked = self._cut(rows.select(*self.keys).distinct())
        stored = self._in_buckets(self._touched(asked))
        same = [stored[k].eqNullSafe(asked[k]) for k in (BUCKET, *self.keys)]
        return stored.join(asked, same, "left_semi").drop(LIVE, BUCKET)

    def _touched(self, cut: DataFrame) -> list[int]:
        return sorted(r[0] for r in cut.select(BUCKET).distinct().collect())

    def _in_buckets(self, numbers: list[int]) -> DataFrame:
        return self._stored().where(F.col(LIVE) & F.col(BUCKET).isin(numbers))

    def apply(self, upserts: DataFrame | None = None, version: Column | None = None, deletes: DataFrame | None = None) -> list[int]:
        """Inserts or replaces rows by key, then drops the keys of ``deletes``; the buckets rewritten.

        Of several upserts of a key the greatest ``version`` wins, of equal ones the same in every run; a version
        that is null comes first. Changes are reduced before they are shuffled, so a key with very many of them
        costs no more than others. A run that fails before its commit leaves the table as it was, and the same
        changes may be applied again; the commit moves bucket after bucket.
        """
        stored = self._stored()
        columns = [c for c in stored.columns if c not in (BUCKET, LIVE)]
        row, key = F.struct(*columns), [BUCKET, *self.keys]
        parts = []
        if upserts is not None:
            at = F.struct(version if version is not None else F.lit(0), F.xxhash64(*columns))
            latest = self._cut(upserts.select("*", at.alias("_at"))).groupBy(*key).agg(F.max_by(row, F.col("_at")).alias("_row"))
            parts.append(latest.select(*key, F.lit(1).alias("_kind"), "_row"))
        if deletes is not None:
            gone = self._cut(deletes.select(*self.keys).distinct())
            parts.append(gone.select(*key, F.lit(2).alias("_kind"), F.lit(None).cast(stored.select(row.alias("r")).schema["r"].dataType).alias("_row")))
        if not parts:
            return []
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        touched = self._touched(changes)
        if not touched:
            return []
        base = self._in_buckets(touched)
        merged = (
            base.select(*key, F.lit(0).alias("_kind"), row.alias("_row"))
            .unionByName(changes)
            .repartition(BUCKET)
            .groupBy(*key)
            .agg(F.max_by("_row", "_kind").alias("_row"), F.max("_kind").alias("_kind"))
            .where("_kind < 2")
            .select(*[F.col("_row")[c].alias(c) for c in columns], F.lit(True).alias(LIVE), BUCKET)
        )
        # A bucket that lost its last row is written too: each has one row that is not live.
        marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").select(
            *[F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in columns], F.lit(False).alias(LIVE), BUCKET
        )
        self._write(merged.unionByName(marks))
        return touched
