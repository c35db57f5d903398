"""Snapshot versions: latest state, change detection over polls, and differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.functions.text import source_hash, text_or_empty
from articleflow.operators.ordering import OrderedGroups, over_groups, top_per_group
from articleflow.session import cut_lineage
from articleflow.sources.tables import insert_absent


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest version of every entry; each task keeps one row per entry before the shuffle."""
    return top_per_group(snapshots, ["entry_id"], [F.desc("version")], 1)


def version_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("entry_id").agg(F.count(F.lit(1)).alias("versions"))


def changed_entries(snapshots: DataFrame) -> DataFrame:
    return version_counts(snapshots).where("versions > 1")


def next_versions(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("entry_id").agg((F.max("version") + 1).alias("next_version"))


def unique_snapshots(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New snapshots whose (entry, content) is not stored yet, the smallest row of equal ones; the
    append stays idempotent."""
    return insert_absent(stored, new, ["entry_id", "content_hash"])


def detect_changes(
    polls: DataFrame,
    stored: DataFrame | None = None,
    on_revert: str = "touch",
    segment_rows: int | None = None,
) -> DataFrame:
    """Decide for every poll of every entry what happens to its snapshots.

    ``polls``: entry_id, polled_at, source_hash, fetched (the extraction worked), content_hash;
    optionally ``force`` for on-demand fetches, which compare content only.
    ``stored``: snapshots table with entry_id, version, source_hash, content_hash.

    Adds ``action`` and ``version`` (of the snapshot the entry has after the poll, 0 for none):

    ================  ===========================================================
    skip              source unchanged since the last poll
    backfill          the stored snapshot had no source hash yet; no fetch
    failed_retry      extraction failed, nothing stored, next poll tries again
    failed_touch      extraction failed, the source hash is remembered
    unchanged_touch   source changed, content did not
    revert_touch      content equals an older version (``on_revert="touch"``)
    insert_new        first version
    insert_version    next version
    ================  ===========================================================

    An entry exists from its first successful extraction on, and every poll of an existing entry
    leaves its source hash behind. So the previous poll's hash decides about fetching, the first
    occurrence of a content hash decides about a new version, and version numbers are running
    counts: one shuffle by entry, of hashes only, serves all of these. Entries with very many polls
    are cut into segments (see ``ordering``).
    """
    if on_revert not in ("touch", "version"):
        raise ValueError("on_revert is 'touch' or 'version'")
    if "force" not in polls.columns:
        polls = polls.withColumn("force", F.lit(False))
    rows = polls.withColumns(
        {
            "_ok": F.coalesce("fetched", F.lit(False)),
            "_at": F.unix_micros(F.col("polled_at").cast("timestamp")),
        }
    )
    base = None
    if stored is not None:
        base = latest_snapshots(
            stored.select("entry_id", "version", "source_hash", "content_hash")
        ).select(
            "entry_id",
            F.col("version").alias("_base_version"),
            F.col("source_hash").alias("_base_source"),
            F.col("content_hash").alias("_base_content"),
        )
        rows = rows.join(base, "entry_id", "left")
    else:
        rows = rows.withColumns(
            {
                "_base_version": F.lit(None).cast("int"),
                "_base_source": F.lit(None).cast("string"),
                "_base_content": F.lit(None).cast("string"),
            }
        )
    order = ["_at", "source_hash", "_tie"]
    tie = F.concat_ws(":", F.coalesce("content_hash", F.lit("")), F.col("_ok").cast("string"))
    rows = rows.withColumns({"_tie": tie, "source_hash": text_or_empty(F.col("source_hash"))})
    keep = [c for c in polls.columns if c != "force"]
    return over_groups(
        rows,
        ["entry_id"],
        order,
        lambda groups: _decide(groups, stored, on_revert).select(*keep, "action", "version"),
        segment_rows,
    )


def _decide(groups: OrderedGroups, stored: DataFrame | None, on_revert: str) -> DataFrame:
    # Existence: a stored version or an earlier successful extraction. A failed on-demand fetch
    # leaves no trace, every other poll leaves its source hash.
    leaves = F.when(F.col("_ok") | ~F.col("force"), F.col("source_hash"))
    groups = groups.carry_last(leaves, "_prev_source").running_sum(F.col("_ok"), "_oks")
    df = groups.df
    existed = F.col("_base_version").isNotNull() | (F.col("_oks") - F.col("_ok").cast("bigint") > 0)
    df = df.withColumns(
        {"_existed": existed, "_remembered": F.coalesce("_prev_source", "_base_source")}
    )
    polled = F.col("_existed") & ~F.col("force")
    same_source = F.coalesce(F.col("_remembered") == F.col("source_hash"), F.lit(False))
    df = df.withColumns(
        {"_skip": polled & same_source, "_backfill": polled & F.col("_remembered").isNull()}
    )
    df = df.withColumn("_store", F.col("_ok") & ~F.col("_skip") & ~F.col("_backfill"))

    if on_revert == "touch":
        df = _mark_first(df, groups)
        if stored is not None:
            known = stored.select("entry_id", "content_hash", F.lit(True).alias("_known")).distinct()
            df = df.join(known, ["entry_id", "content_hash"], "left")
            df = df.withColumn("_earliest", F.col("_earliest") & F.col("_known").isNull())
        fresh = F.col("_store") & F.coalesce("_earliest", F.lit(False))
        groups = groups.with_rows(df.withColumn("_insert", fresh))
        groups = groups.carry_last(F.when(F.col("_insert"), F.col("content_hash")), "_last_content")
    else:
        groups = groups.with_rows(df)
        groups = groups.carry_last(F.when(F.col("_store"), F.col("content_hash")), "_last_content")
    last = F.coalesce("_last_content", "_base_content")
    df = groups.df.withColumn(
        "_same", F.coalesce(F.col("content_hash") == last, F.lit(False))
    )
    if on_revert == "version":
        df = df.withColumn("_insert", F.col("_store") & ~F.col("_same"))
    groups = groups.with_rows(df).running_sum(F.col("_insert"), "_inserts")
    df = groups.result()

    action = (
        F.when(F.col("_skip"), "skip")
        .when(F.col("_backfill"), "backfill")
        .when(~F.col("_ok") & F.col("_existed") & ~F.col("force"), "failed_touch")
        .when(~F.col("_ok"), "failed_retry")
        .when(F.col("_insert") & F.col("_existed"), "insert_version")
        .when(F.col("_insert"), "insert_new")
        .when(F.col("_same"), "unchanged_touch")
        .otherwise("revert_touch")
    )
    version = (F.coalesce("_base_version", F.lit(0)) + F.col("_inserts")).cast("int")
    return df.withColumns({"action": action, "version": version})


def _mark_first(df: DataFrame, groups: OrderedGroups) -> DataFrame:
    """Flag ``_earliest`` on the first stored poll of every content of an entry.

    For entries of moderate size a window does, on the partitioning by entry the rows
    already have. For large ones the first polls are aggregated per (entry, content), which combines
    before its shuffle, and joined back.
    """
    if not groups.segmented:
        w = Window.partitionBy("entry_id", "content_hash", "_store").orderBy(*groups.order)
        return df.withColumn("_earliest", F.row_number().over(w) == 1)
    df = cut_lineage(df)
    point = F.struct(*groups.order)
    firsts = df.where("_store").groupBy("entry_id", "content_hash").agg(F.min(point).alias("_first"))
    joined = df.join(firsts, ["entry_id", "content_hash"], "left")
    return joined.withColumn("_earliest", F.col("_first") == point)


def poll_hashes(polls: DataFrame) -> DataFrame:
    """Polls whose article body is the polled content itself: both hashes come from it."""
    return polls.select(
        "entry_id",
        "feed_id",
        "polled_at",
        source_hash(F.col("content")).alias("source_hash"),
        F.lit(True).alias("fetched"),
        source_hash(F.col("content")).alias("content_hash"),
    )


def throughput(decided: DataFrame) -> DataFrame:
    """Number of polls per action; inserts are the processed ones."""
    return decided.groupBy("action").agg(F.count(F.lit(1)).alias("polls"))


def version_pairs(snapshots: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Every version next to the one before it, where the text differs."""
    narrow = snapshots.select("entry_id", "version", "fetched_at", "content_text")
    before = {
        "from_version": ("version", -1),
        "from_fetched_at": ("fetched_at", -1),
        "from_text": ("content_text", -1),
    }
    return (
        over_groups(
            narrow, ["entry_id"], ["version"], lambda g: g.neighbours(before).result(), segment_rows
        )
        .where(F.col("from_version").isNotNull())
        .withColumnsRenamed(
            {"version": "to_version", "fetched_at": "to_fetched_at", "content_text": "to_text"}
        )
    )


def _diff_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            lines = difflib.unified_diff(
                (r.from_text or "").splitlines(keepends=True),
                (r.to_text or "").splitlines(keepends=True),
                fromfile=r.from_label,
                tofile=r.to_label,
            )
            rows.extend(
                (r.entry_id, r.from_version, r.to_version, i, line) for i, line in enumerate(lines)
            )
        yield pd.DataFrame(
            rows, columns=["entry_id", "from_version", "to_version", "line_no", "line"]
        )


def _label(version: str, at: str) -> Column:
    return F.format_string(
        "v%d (%s)", F.col(version), F.date_format(F.col(at), "yyyy-MM-dd HH:mm")
    )


def version_diff(snapshots: DataFrame) -> DataFrame:
    """Unified diff of adjacent versions, one row per line. Equal texts never reach Python."""
    changed = version_pairs(snapshots).where(~F.col("from_text").eqNullSafe(F.col("to_text")))
    labelled = changed.select(
        "entry_id",
        "from_version",
        "to_version",
        "from_text",
        "to_text",
        _label("from_version", "from_fetched_at").alias("from_label"),
        _label("to_version", "to_fetched_at").alias("to_label"),
    )
    return labelled.mapInPandas(
        _diff_rows,
        "entry_id bigint, from_version int, to_version int, line_no int, line string",
    )


def line_changes(snapshots: DataFrame) -> DataFrame:
    """Lines added and removed between adjacent versions, as a difference of line bags.

    Lines are counted per (entry, version, line), so neither a long text nor an entry with many
    versions is gathered in one place.
    """
    pairs = version_pairs(snapshots).select("entry_id", "from_version", "to_version", "from_text", "to_text")

    def lines(text: str, sign: int) -> DataFrame:
        body = F.regexp_replace(text_or_empty(F.col(text)), r"\n\z", "")
        items = F.when(F.length(text_or_empty(F.col(text))) > 0, F.split(body, "\n"))
        return pairs.select(
            "entry_id",
            "from_version",
            "to_version",
            F.explode_outer(items).alias("line"),
            F.lit(sign).alias("sign"),
        )

    delta = (
        lines("to_text", 1)
        .unionByName(lines("from_text", -1))
        .groupBy("entry_id", "from_version", "to_version", "line")
        .agg(F.sum(F.when(F.col("line").isNotNull(), F.col("sign")).otherwise(0)).alias("delta"))
    )
    # An empty text has no line but stays as a row without one, so no pair of versions is lost.
    return delta.groupBy("entry_id", "from_version", "to_version").agg(
        F.sum(F.greatest(F.col("delta"), F.lit(0))).alias("added"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("removed"),
    )
