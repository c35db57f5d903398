"""Column functions over JSON metadata of snapshots and error bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.schemas import SUMMARY_METADATA

_EMPTY = "cast(map() as map<string,string>)"


def parse_metadata(col: Column) -> Column:
    return F.from_json(col, SUMMARY_METADATA)


def summaries(metadata: Column) -> Column:
    """Summaries by prompt; a lone old-style summary reads as the ``default`` one."""
    stored = F.coalesce(metadata["summaries"], F.expr(_EMPTY))
    legacy = metadata["summary"]
    use_legacy = (F.length(F.coalesce(legacy, F.lit(""))) > 0) & ~F.map_contains_key(
        stored, "default"
    )
    return F.when(
        use_legacy, F.map_concat(stored, F.create_map(F.lit("default"), legacy))
    ).otherwise(stored)


def merge_summaries(old: Column, new: Column) -> Column:
    """Union of two maps in which the new value wins."""
    old = F.coalesce(old, F.expr(_EMPTY))
    new = F.coalesce(new, F.expr(_EMPTY))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def first_key(m: Column) -> Column:
    """First key in the order a binary JSON object stores them: by length, then by bytes."""
    ordered = F.array_sort(
        F.transform(
            F.map_keys(m),
            lambda k: F.struct(F.octet_length(k).alias("n"), k.alias("key")),
        )
    )
    return F.get(ordered, F.lit(0))["key"]


def _filled(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def pick_summary(metadata: Column) -> Column:
    """Summary shown in the digest: the default one, else the first stored, else the old-style one."""
    stored = F.coalesce(metadata["summaries"], F.expr(_EMPTY))
    return F.coalesce(
        _filled(F.try_element_at(stored, F.lit("default"))),
        _filled(F.try_element_at(stored, first_key(stored))),
        _filled(metadata["summary"]),
    )


def error_text(body: Column) -> Column:
    """Message in an error response: a JSON field when the body is JSON, else the trimmed body."""
    parsed = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    field = F.coalesce(
        _filled(F.try_variant_get(parsed, "$.error_message", "string")),
        F.try_variant_get(parsed, "$.error", "string"),
    )
    return F.when(parsed.isNull(), _filled(F.btrim(body))).when(is_object, field)
