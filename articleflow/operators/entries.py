"""Entry lists, pages, neighbours and tags."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions.text import text_or_empty
from articleflow.operators.ordering import all_of, over_groups, top_per_group
from articleflow.operators.sizing import attach
from articleflow.operators.versions import changed_entries

# Page size of the list, priority of feeds without one.
PAGE_SIZE = 50
DEFAULT_PRIORITY = 2
# A page is a bounded report; longer results should be read without a limit.
MAX_PAGE = 10_000


@dataclass(frozen=True)
class EntryQuery:
    feed_id: int | None = None
    status: str | None = None
    search: str | None = None
    starred: bool = False
    category_id: int | None = None
    after: datetime | None = None
    before: datetime | None = None
    time_filter: str | None = None
    tags: list[str] = field(default_factory=list)
    changed: bool = False
    order: str = "published_at"
    direction: str = "desc"
    limit: int | None = PAGE_SIZE
    offset: int = 0


def time_bound(name: str | None, as_of: datetime) -> datetime | None:
    """Lower bound of a named period in whole seconds; unknown names do not filter."""
    now = as_of.replace(microsecond=0)
    if name == "today":
        return now.replace(hour=0, minute=0, second=0)
    if name == "24h":
        return now - timedelta(hours=24)
    if name == "week":
        return now - timedelta(days=7)
    return None


def _instant(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def search_condition(text: str) -> Column:
    """All words of the query occur in title or content, ignoring case."""
    haystack = F.lower(
        F.concat_ws("\n", text_or_empty(F.col("title")), text_or_empty(F.col("content")))
    )
    return all_of([F.contains(haystack, F.lit(w.lower())) for w in text.split()])


def scan_entries(
    entries: DataFrame, q: EntryQuery, feeds: DataFrame | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Filters of a query, cheapest first; simple ones reach the Parquet scan."""
    df = entries
    if q.feed_id is not None:
        df = df.where(F.col("feed_id") == q.feed_id)
    if q.status:
        df = df.where(F.col("status") == q.status)
    if q.starred:
        df = df.where("starred")
    if q.after is not None:
        df = df.where(F.col("published_at") > _instant(q.after))
    if q.before is not None:
        df = df.where(F.col("published_at") < _instant(q.before))
    if q.time_filter and as_of is not None:
        bound = time_bound(q.time_filter, as_of)
        if bound is not None:
            df = df.where(F.col("published_at") > _instant(bound))
    if q.category_id is not None:
        if feeds is None:
            raise ValueError("a category filter needs the feeds")
        members = feeds.where(F.col("category_id") == q.category_id).select("feed_id")
        df = attach(df, members, "feed_id", "left_semi")
    if q.search:
        df = df.where(search_condition(q.search))
    return df


def count_entries(entries: DataFrame, q: EntryQuery, **kw) -> DataFrame:
    """Total of a query before paging."""
    return scan_entries(entries, q, **kw).agg(F.count(F.lit(1)).alias("total"))


def sort_columns(q: EntryQuery) -> list[Column]:
    col = F.col(q.order)
    first = col.desc_nulls_last() if q.direction == "desc" else col.asc_nulls_first()
    return [first, F.col("entry_id")]


def page(df: DataFrame, q: EntryQuery) -> DataFrame:
    ordered = df.orderBy(*sort_columns(q))
    if q.offset:
        ordered = ordered.offset(q.offset)
    return ordered if q.limit is None else ordered.limit(q.limit)


def page_after(
    df: DataFrame, last: tuple[int, datetime, int], size: int = PAGE_SIZE
) -> DataFrame:
    """Next page of a priority list behind ``(priority, published_at, entry_id)``.

    Deep pages cost the same as the first one, unlike an offset.
    """
    priority, published, entry_id = last
    at = _instant(published)
    behind = (F.col("priority") > priority) | (
        (F.col("priority") == priority)
        & (
            (F.col("published_at") < at)
            | F.col("published_at").isNull()
            | ((F.col("published_at") == at) & (F.col("entry_id") > entry_id))
        )
    )
    return df.where(behind).orderBy(*tier_order()).limit(size)


def tier_order() -> list[Column]:
    return [F.col("priority"), F.desc_nulls_last("published_at"), F.col("entry_id")]


def with_priority(entries: DataFrame, config: DataFrame) -> DataFrame:
    joined = attach(entries, config.select("feed_id", "priority"), "feed_id")
    return joined.withColumn("priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)))


def tags_per_entry(tags: DataFrame) -> DataFrame:
    """Sorted distinct tags of each entry; duplicates are dropped before the shuffle."""
    return tags.groupBy("entry_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def entries_with_tags(entries: DataFrame, tags: DataFrame) -> DataFrame:
    joined = entries.join(tags_per_entry(tags), "entry_id", "left")
    return joined.withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def tag_filter(entries: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Entries with at least one of the tags; the tag test reaches the scan of the tag table."""
    return entries.join(tags.where(F.col("tag").isin(wanted)), "entry_id", "left_semi")


def tags_overlap(entries: DataFrame, wanted: list[str]) -> DataFrame:
    """As :func:`tag_filter` for entries that already carry a ``tags`` array, with the matches."""
    want = F.array(*[F.lit(t) for t in wanted])
    return entries.where(F.arrays_overlap("tags", want)).withColumn(
        "matched", F.array_intersect("tags", want)
    )


def tag_cloud(entries: DataFrame, tags: DataFrame, contains: str | None = None) -> DataFrame:
    """Distinct tags over a set of entries with the number of entries, sorted by tag."""
    if contains:
        tags = tags.where(F.contains(F.lower("tag"), F.lit(contains.lower())))
    used = tags.join(entries.select("entry_id"), "entry_id", "left_semi")
    return (
        used.dropDuplicates(["entry_id", "tag"])
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("entries"))
        .orderBy("tag")
    )


def shown_tags(own: Column, model: Column, n: int = 5) -> tuple[Column, Column]:
    """First tags to show, the entry's own before the model's, and the number left over."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(own, empty), F.coalesce(model, empty))
    return F.slice(both, 1, n), F.greatest(F.size(both) - n, F.lit(0))


def _page_keys(df: DataFrame, q: EntryQuery, order: list[Column]) -> list:
    """Keys and priorities of one page, at most MAX_PAGE rows."""
    keys = df.select("entry_id", "priority", "published_at").orderBy(*order)
    if q.offset:
        keys = keys.offset(q.offset)
    return keys.limit(q.limit).select("entry_id", "priority").collect()


def entry_list(
    entries: DataFrame,
    config: DataFrame,
    tags: DataFrame,
    snapshots: DataFrame,
    q: EntryQuery,
    feeds: DataFrame | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The entry list: filters, priority tiers, newest first, tags and change marks.

    With a limit the page's keys are found first from narrow columns, and the wide columns, tags
    and versions are then read for those keys alone. Without one everything stays one plan.
    """
    if q.status == "all":
        q = EntryQuery(**{**q.__dict__, "status": None})
    elif q.status is None:
        q = EntryQuery(**{**q.__dict__, "status": "unread"})
    found = scan_entries(entries, q, feeds, as_of)
    if q.tags:
        found = tag_filter(found, tags, q.tags)
    changed = changed_entries(snapshots).select("entry_id")
    if q.changed:
        found = found.join(changed, "entry_id", "left_semi")
    if q.feed_id is None:
        found = with_priority(found, config)
    else:
        found = with_priority(found, config.where(F.col("feed_id") == q.feed_id))
    order = tier_order()
    if q.limit is not None:
        if q.limit > MAX_PAGE:
            raise ValueError(f"a page has at most {MAX_PAGE} entries")
        keys = _page_keys(found, q, order)
        on_page = F.col("entry_id").isin([r["entry_id"] for r in keys])
        priorities = entries.sparkSession.createDataFrame(
            [(r["entry_id"], r["priority"]) for r in keys], "entry_id bigint, priority int"
        )
        # Key values are constants now, so all three scans skip row groups without them.
        found = entries.where(on_page).join(F.broadcast(priorities), "entry_id")
        tags = tags.where(on_page)
        changed = changed_entries(snapshots.where(on_page)).select("entry_id")
    out = entries_with_tags(found.drop("tags") if "tags" in found.columns else found, tags)
    out = out.join(changed.withColumn("has_changes", F.lit(True)), "entry_id", "left")
    return out.withColumn("has_changes", F.coalesce("has_changes", F.lit(False))).orderBy(*order)


def has_next(rows_on_page: int, size: int = PAGE_SIZE) -> bool:
    return rows_on_page == size


def newest_per_feed(entries: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` newest entries of every feed."""
    order = [F.desc_nulls_last("published_at"), F.col("entry_id")]
    return top_per_group(entries, ["feed_id"], order, k, spread=32, rank="position")


def neighbours(entries: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Previous (newer) and next (older) entry of the same feed, safe for one dominating feed."""
    age = -F.unix_micros(F.col("published_at").cast("timestamp"))
    keyed = entries.where(F.col("published_at").isNotNull()).select(
        "feed_id", "entry_id", "published_at", age.alias("_age")
    )
    wanted = {"prev_entry_id": ("entry_id", -1), "next_entry_id": ("entry_id", 1)}
    return over_groups(
        keyed,
        ["feed_id"],
        ["_age", "entry_id"],
        lambda g: g.neighbours(wanted).result().drop("_age"),
        segment_rows,
    )


def latest_per_feed(entries: DataFrame) -> DataFrame:
    return entries.groupBy("feed_id").agg(F.max("published_at").alias("latest"))


def unread_per_feed(entries: DataFrame) -> DataFrame:
    return (
        entries.where("status = 'unread'")
        .groupBy("feed_id")
        .agg(F.count(F.lit(1)).alias("unread"))
    )


def unread_total(entries: DataFrame, since: datetime | None = None) -> DataFrame:
    df = entries.where("status = 'unread'")
    if since is not None:
        df = df.where(F.col("published_at") > _instant(since))
    return df.agg(F.count(F.lit(1)).alias("count"))


def audio_enclosure(enclosures: Column) -> Column:
    """First enclosure with an audio media type, or null."""
    audio = F.filter(
        enclosures,
        lambda e: F.startswith(text_or_empty(e["mime_type"]), F.lit("audio/")),
    )
    return F.get(audio, F.lit(0))


def enabled_entries(entries: DataFrame, config: DataFrame) -> DataFrame:
    """Entries with an address in feeds that fetch full content."""
    enabled = config.where("fetch_full_content").select("feed_id")
    with_url = entries.where(F.length(text_or_empty(F.col("url"))) > 0)
    return attach(with_url, enabled, "feed_id", "left_semi")
