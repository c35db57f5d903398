"""State of entries and feeds as the outcome of an action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.text import clamp, text_or_empty
from articleflow.session import cut_lineage
from articleflow.sources.tables import upsert_columns

# Action -> (column, kind, value). ``set`` writes a value, ``flip`` inverts a flag,
# ``text`` writes the action's own value unless it is blank.
ACTIONS: dict[str, tuple[str, str, str | None]] = {
    "mark_read": ("status", "set", "read"),
    "mark_unread": ("status", "set", "unread"),
    "star": ("starred", "set", "true"),
    "unstar": ("starred", "set", "false"),
    "toggle_star": ("starred", "flip", None),
    "pause": ("disabled", "set", "true"),
    "resume": ("disabled", "set", "false"),
    "set_proxy": ("fetch_via_proxy", "set", "true"),
    "toggle_proxy": ("fetch_via_proxy", "flip", None),
    "allow_self_signed": ("allow_self_signed_certificates", "set", "true"),
    "toggle_tls": ("allow_self_signed_certificates", "flip", None),
    "rename": ("title", "text", None),
    "set_feed_url": ("feed_url", "text", None),
    "set_site_url": ("site_url", "text", None),
    "set_title": ("title", "text", None),
}


def _pick(position: int) -> Column:
    out = F.lit(None).cast("string")
    for name, spec in ACTIONS.items():
        if spec[position] is not None:
            out = F.when(F.col("action") == name, F.lit(spec[position])).otherwise(out)
    return out


def fold_actions(actions: DataFrame) -> DataFrame:
    """Net effect per (id, column): the last value written and whether an odd number of flips
    follows it. ``actions``: id, action, value, ts, seq (orders actions of one instant).

    Two aggregations, both combining before their shuffle, so an id with a large part of the log
    costs no more than others. The first one's result, a row per id and column, is kept, so the log
    is read twice: for it, and for the flips of columns that were also written.
    """
    log = actions.select(
        "id",
        _pick(0).alias("field"),
        _pick(1).alias("kind"),
        F.coalesce(_pick(2), F.trim("value")).alias("value"),
        F.struct(F.col("ts").alias("ts"), F.col("seq").alias("seq")).alias("at"),
    ).where("field IS NOT NULL AND (kind <> 'text' OR coalesce(value, '') <> '')")
    is_flip = F.col("kind") == "flip"
    write_at = F.when(~is_flip, F.col("at"))
    writes = cut_lineage(
        log.groupBy("id", "field").agg(
            F.max_by("value", write_at).alias("value"),
            F.max(write_at).alias("written_at"),
            F.count_if(is_flip).alias("all_flips"),
        )
    )
    # Flips that a later write overrides are subtracted; the log is joined back only for columns
    # that see both kinds.
    mixed = writes.where("written_at IS NOT NULL AND all_flips > 0").select(
        "id", "field", "written_at"
    )
    overridden = (
        log.where(is_flip)
        .join(mixed, ["id", "field"])
        .where(F.col("at") <= F.col("written_at"))
        .groupBy("id", "field")
        .agg(F.count(F.lit(1)).alias("before"))
    )
    return writes.join(overridden, ["id", "field"], "left").select(
        "id",
        "field",
        "value",
        ((F.col("all_flips") - F.coalesce("before", F.lit(0))) % 2 == 1).alias("flip"),
    )


def apply_actions(state: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """State table after all actions; rows and columns without actions stay as they are."""
    fields = sorted({spec[0] for spec in ACTIONS.values()} & set(state.columns))
    effect = F.struct("value", "flip")
    net = (
        fold_actions(actions)
        .groupBy(F.col("id").alias(key))
        .agg(*[F.max(F.when(F.col("field") == f, effect)).alias(f"_{f}") for f in fields])
    )
    joined = state.join(net, key, "left")
    out = {}
    for f in fields:
        kind = state.schema[f].dataType
        value = F.coalesce(F.col(f"_{f}.value").cast(kind), F.col(f))
        if kind.simpleString() == "boolean":
            value = F.coalesce(value, F.lit(False)) != F.coalesce(f"_{f}.flip", F.lit(False))
        out[f] = value
    return joined.withColumns(out).drop(*[f"_{f}" for f in fields])


def bulk_result(attempts: DataFrame) -> DataFrame:
    """Outcome of a bulk change: how many of how many succeeded."""
    return attempts.agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total"))


def set_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Feed settings after changes: feed_id, at and any of priority, fetch_full_content,
    extract_rules. Every column takes its own latest value that is not null, so changes of different
    columns never undo each other; without one the old value stays. Priority is kept within 1..3."""
    if "priority" in changes.columns:
        changes = changes.withColumn("priority", clamp(F.col("priority"), 1, 3))
    defaults = {"priority": 2, "fetch_full_content": False}
    return upsert_columns(
        config, changes, ["feed_id"], F.col("at"), {k: v for k, v in defaults.items() if k in config.columns}
    )


def toggled(config: DataFrame, feed_ids: DataFrame, column: str = "fetch_full_content") -> DataFrame:
    """Settings with a flag inverted once per row of ``feed_ids``, so an even number of rows leaves it
    as it was; a feed without settings gets a row."""
    asked = feed_ids.groupBy("feed_id").agg((F.count(F.lit(1)) % 2 == 1).alias("_asked"))
    joined = config.join(asked, "feed_id", "full_outer")
    flag = F.coalesce(F.col(column), F.lit(False)) != F.coalesce("_asked", F.lit(False))
    out = joined.withColumn(column, flag).drop("_asked")
    if "priority" in config.columns and column != "priority":
        out = out.withColumn("priority", F.coalesce("priority", F.lit(2)))
    return out


def apply_discovered(feeds: DataFrame, updates: DataFrame) -> DataFrame:
    """Feeds after accepted discoveries: new address, and title and site where given.

    ``updates``: feed_id, new_url, new_title, new_site_url, and ``at`` if a feed may have several.
    They fold into one row per feed before the join: per column the latest value that is not blank,
    the greatest one where times are equal or missing. So feeds keep one row each.
    """

    def given(col: str) -> Column:
        trimmed = F.trim(text_or_empty(F.col(col)))
        return F.when(trimmed != "", trimmed)

    at = F.col("at") if "at" in updates.columns else F.lit(None).cast("timestamp")
    names = {"feed_url": "new_url", "title": "new_title", "site_url": "new_site_url"}
    latest = [
        F.max(F.when(given(n).isNotNull(), F.struct(at.alias("at"), given(n).alias("value"))))["value"].alias(f"_{n}")
        for n in names.values()
    ]
    joined = feeds.join(updates.groupBy("feed_id").agg(*latest), "feed_id", "left")
    taken = {c: F.coalesce(f"_{n}", c) for c, n in names.items()}
    return joined.withColumns(taken).drop(*[f"_{n}" for n in names.values()])
