"""Typed table reads and writes on Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.operators.ordering import top_per_group
from articleflow.schemas import conform, schema_of


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan of a known table. The stored schema may be older; see :func:`conform`."""
    stored = spark.read.option("mergeSchema", "true").parquet(path)
    return conform(stored, table)


def read_exact(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan with the declared schema given to the reader, so files are not opened for inference."""
    return spark.read.schema(schema_of(table)).parquet(path)


def lookup(df: DataFrame, key: str, *values: object) -> DataFrame:
    """Rows with the given keys; the test reaches the Parquet scan."""
    return df.where(F.col(key).isin(list(values)) if len(values) > 1 else F.col(key) == values[0])


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def upsert(
    base: DataFrame, changes: DataFrame, keys: list[str], version: list[Column]
) -> DataFrame:
    """Keyed insert-or-replace; of several changes to a key the last by ``version`` wins.

    ``version`` gives descending sort expressions over the columns of ``changes``. Only keys that
    change are looked up, base rows of other keys pass through an anti-join untouched.
    """
    latest = top_per_group(changes, keys, version, 1)
    kept = base.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*base.columns))


def upsert_columns(
    base: DataFrame, changes: DataFrame, keys: list[str], version: Column, defaults: dict
) -> DataFrame:
    """Keyed update by column: each takes its value of the greatest ``version`` that is not null (the
    greatest of equal versions), else the stored value, else the default. One aggregation that
    combines before its shuffle, so a key with many changes costs no more than others."""
    values = [c for c in base.columns if c not in keys]
    latest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(version.alias("at"), F.col(c).alias("value"))))["value"].alias(f"_new_{c}")
        for c in values
        if c in changes.columns
    ]
    renamed = changes.groupBy(*keys).agg(*latest) if latest else changes.select(*keys).distinct()
    joined = base.join(renamed, keys, "full_outer")
    out = [F.col(k) for k in keys]
    for c in values:
        parts = [F.col(f"_new_{c}")] if f"_new_{c}" in renamed.columns else []
        parts.append(F.col(c))
        if c in defaults:
            parts.append(F.lit(defaults[c]).cast(base.schema[c].dataType))
        out.append(F.coalesce(*parts).alias(c))
    return joined.select(*out)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored, the smallest row per key; append the result."""
    return smallest_per_key(new, keys).join(base.select(*keys), keys, "left_anti")


def smallest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the same one in every run: the smallest by its other columns in their order.

    Columns must be of types that have an order.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a changed table next to the old one, then swap the directories.

    The plan may read ``path`` itself, so the old files stay in place until the new ones are
    complete. A run that dies leaves either the old table or ``<path>.old`` to recover from.
    """
    spark = df.sparkSession
    staged, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    backup, fresh = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(staged)
    if fs.exists(backup):
        fs.delete(backup, True)
    if fs.exists(target) and not fs.rename(target, backup):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot move {staged} into place")
    fs.delete(backup, True)
