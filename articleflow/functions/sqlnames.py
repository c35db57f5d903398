"""The presentation helpers under their names in SQL text: excerpt, reading_time, timeago."""

from __future__ import annotations

from pyspark.sql import SparkSession

from articleflow.functions.text import _decode_entities

_SPACE = r"(?U)[\\s\\x1c-\\x1f]+"
_WORD = r"(?U)[^\\s\\x1c-\\x1f]+"

_READING_TIME = f"""
CREATE OR REPLACE TEMPORARY FUNCTION reading_time(content STRING) RETURNS STRING RETURN
  CASE WHEN coalesce(length(content), 0) = 0 THEN '< 1 min'
       ELSE concat(greatest(1, regexp_count(content, '{_WORD}') DIV 230), ' min read') END"""

_CUT = """
CREATE OR REPLACE TEMPORARY FUNCTION cut_at_word(plain STRING, n INT) RETURNS STRING RETURN
  CASE WHEN length(plain) <= n THEN plain
       ELSE concat(regexp_replace(substring(plain, 1, n), '(?s) [^ ]*$', ''), '...') END"""

_PLAIN = f"""
CREATE OR REPLACE TEMPORARY FUNCTION plain_text(decoded STRING) RETURNS STRING RETURN
  trim(regexp_replace(decoded, '{_SPACE}', ' '))"""

_AGE = """
CREATE OR REPLACE TEMPORARY FUNCTION age_words(seconds BIGINT) RETURNS STRING RETURN
  CASE WHEN seconds = 1 THEN 'a second' WHEN seconds < 60 THEN concat(seconds, ' seconds')
       WHEN seconds < 120 THEN 'a minute' WHEN seconds < 3600 THEN concat(seconds DIV 60, ' minutes')
       WHEN seconds < 7200 THEN 'an hour' WHEN seconds < 86400 THEN concat(seconds DIV 3600, ' hours')
       WHEN seconds DIV 86400 = 1 THEN 'a day' ELSE concat(seconds DIV 86400, ' days') END"""

_TIMEAGO = """
CREATE OR REPLACE TEMPORARY FUNCTION timeago(moment TIMESTAMP, as_of TIMESTAMP) RETURNS STRING RETURN
  CASE WHEN moment IS NULL THEN ''
       WHEN unix_micros(as_of) - unix_micros(moment) >= 86400000000 THEN date_format(moment, 'yyyy-MM-dd HH:mm')
       WHEN abs(unix_micros(as_of) - unix_micros(moment)) < 1000000 THEN 'now'
       ELSE concat(age_words(abs(unix_micros(as_of) - unix_micros(moment)) DIV 1000000),
                   IF(moment > as_of, ' from now', ' ago')) END"""


def register(spark: SparkSession) -> None:
    """Make the helpers available to ``spark.sql`` and expression strings of a session.

    They are SQL functions, so they are inlined into the plan. Decoding of entities is Python;
    SQL text asks for it: ``cut_at_word(plain_text(decode_entities(html_tags_removed)), 400)``.
    Future times beyond a day are spelled in days.
    """
    spark.udf.register("decode_entities", _decode_entities)
    for statement in (_READING_TIME, _CUT, _PLAIN, _AGE, _TIMEAGO):
        spark.sql(statement)
