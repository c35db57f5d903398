"""Indexed search against the scan."""

from __future__ import annotations

import re

import pytest

from articleflow.operators.entries import EntryQuery, scan_entries
from articleflow.operators.searchindex import SearchIndex

SCHEMA = "entry_id long, title string, content string"
ROWS = [
    (1, "Spark news", "Streams and joins"),
    (2, None, "spark"),
    (3, "x", None),
    (4, "", ""),
    (None, "Spark", "no id"),
    (5, "ab", "spar kling"),
    (5, "twice", "sparks 😀é fly"),
    (6, "ar", "sp"),
    (7, "common the the", "the " * 500),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=4)
    made.add(spark.createDataFrame(ROWS, SCHEMA))
    return made


@pytest.mark.parametrize("text", ["spark", "SPARK news", "the", "ar", "ar spark", "zzz", "spark zzz", "😀é", "s fly", "", " ", "kling", "nojoins"])
def test_search_equals_the_scan(spark, index, text):
    entries = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted(map(tuple, scan_entries(entries, EntryQuery(search=text.strip() or None)).collect()), key=repr)
    assert sorted(map(tuple, index.search(entries, text).collect()), key=repr) == want


def test_later_texts_are_found_and_old_postings_do_no_harm(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(spark.createDataFrame([(1, "a", "first words")], SCHEMA))
    now = spark.createDataFrame([(1, "a", "other things")], SCHEMA)
    index.add(now)
    assert index.search(now, "first").count() == 0
    assert [r["entry_id"] for r in index.search(now, "things").collect()] == [1]


def test_only_postings_of_the_search_are_read(spark, index):
    plan = index.candidates("spark news")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan) and "PushedFilters: [In(run" in plan
    assert index.candidates("ab") is None and index.candidates("qqq").count() == 0


def test_runs_of_a_text_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    entries = spark.createDataFrame(ROWS, SCHEMA).mapInPandas(counted, SCHEMA)
    SearchIndex(spark, str(tmp_path / "i"), buckets=4).add(entries)
    assert made.value == len(ROWS)
