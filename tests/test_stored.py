"""Keyed tables in buckets, and read events that are delivered more than once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from articleflow.plans.stored import filter_list
from articleflow.sources.buckets import BucketedTable
from articleflow.sources.readerviews import ReaderViews
from articleflow.streaming import reads

SCHEMA = "k long, name string, v int"


def _files(path: str) -> dict[str, set[str]]:
    return {d.name: {f.name for f in d.glob("*.parquet")} for d in Path(path).glob("_bucket=*")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, ["k"], 8)
    table.create(spark.createDataFrame([(i, f"n{i}", 1) for i in range(100)], SCHEMA))
    before = _files(path)
    assert len(before) == 8
    changes = [(3, "old", 2), (3, "new", 5), (3, "mid", 4), (500, "fresh", 1)]
    touched = table.apply(spark.createDataFrame(changes, SCHEMA), F.col("v"))
    after = _files(path)
    assert 1 <= len(touched) <= 2
    assert {b for b in after if after[b] != before[b]} == {f"_bucket={n}" for n in touched}
    rows = {r["k"]: r["name"] for r in table.read().collect()}
    assert len(rows) == 101 and rows[3] == "new" and rows[500] == "fresh" and rows[4] == "n4"


def test_null_keys_ties_and_emptied_buckets(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k", "name"], 4)
    table.create(spark.createDataFrame([(None, "a", 1), (1, None, 1), (2, "b", 1)], SCHEMA))
    table.apply(spark.createDataFrame([(None, "a", 7), (1, None, 8), (1, None, 8)], SCHEMA), F.col("v"))
    assert sorted(map(tuple, table.read().collect()), key=repr) == [(1, None, 8), (2, "b", 1), (None, "a", 7)]
    asked = spark.createDataFrame([(None, "a", 0), (9, "x", 0), (None, "a", 1)], SCHEMA)
    assert [tuple(r) for r in table.lookup(asked).collect()] == [(None, "a", 7)]
    table.apply(deletes=table.read())
    assert table.read().count() == 0 and table.lookup(asked).count() == 0
    assert table.apply(spark.createDataFrame([], SCHEMA), F.col("v")) == [] and table.apply() == []
    table.apply(spark.createDataFrame([(2, "b", 3)], SCHEMA))
    assert [tuple(r) for r in table.read().collect()] == [(2, "b", 3)]


def test_changes_apply_twice_alike_and_deletes_come_last(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.create(spark.createDataFrame([(i, "x", 0) for i in range(10)], SCHEMA))
    up = spark.createDataFrame([(i, "y", i) for i in range(5, 15)], SCHEMA)
    gone = spark.createDataFrame([(7, "", 0), (77, "", 0)], SCHEMA)
    table.apply(up, F.col("v"), gone)
    first = sorted(map(tuple, table.read().collect()))
    table.apply(up, F.col("v"), gone)
    assert sorted(map(tuple, table.read().collect())) == first
    assert first == [(i, "x", 0) for i in range(5)] + [(i, "y", i) for i in range(5, 15) if i != 7]


def test_a_plan_reads_the_asked_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 8)
    table.create(spark.createDataFrame([(i, "x", 0) for i in range(50)], SCHEMA))
    found = table.lookup(spark.createDataFrame([(3, "", 0)], SCHEMA))
    assert "PartitionFilters: [isnotnull(_bucket" in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [(3, "x", 0)]


def test_repeated_deliveries_count_once_over_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "id long, read_at timestamp"
    days = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00"), (1, "2024-01-01 10:00:00")], "id long, t string")
    days.selectExpr("id", "CAST(t AS TIMESTAMP) AS read_at").write.mode("append").parquet(source)

    def run():
        once = reads.first_deliveries(spark.readStream.schema(schema).parquet(source), ["id"], "2 days")
        reads.append_batches(once, out, checkpoint).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert run() == [1, 2]
    more = spark.createDataFrame([(2, "2024-01-01 11:00:00"), (3, "2024-01-02 09:00:00")], "id long, t string")
    more.selectExpr("id", "CAST(t AS TIMESTAMP) AS read_at").write.mode("append").parquet(source)
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]


def test_filters_are_listed_newest_first(spark):
    rows = [(r["created_at"], r["id"]) for r in filter_list(ReaderViews(spark, "/root/testdata/sf0.001")).collect()]
    assert len(rows) > 100 and len({r[0] for r in rows}) < len(rows)
    assert rows == sorted(rows, reverse=True)
