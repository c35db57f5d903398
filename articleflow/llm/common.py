"""What the operators of this folder share: reading tables, shared tables, batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from articleflow.session import cut_lineage, ship_package

# Text handled at once inside a task; less where every word costs many bytes of arrays.
SLICE_BYTES = 4 << 20
WORD_SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that lost executors cost no earlier stage."""
    ship_package(df.sparkSession)
    return cut_lineage(df)


def discard(df: DataFrame) -> None:
    """Free the files of a table that ``shared`` wrote and no later step reads."""
    files = df.inputFiles()
    if files:
        nothing = df.sparkSession.createDataFrame([], df.schema)
        nothing.write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``size`` bytes of one column, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        per_row = max(1, batch.column(column).nbytes // max(1, rows))
        step = max(1, size // per_row)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def map_slices(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    column: str = "text",
    size: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, size):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
