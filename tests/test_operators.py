"""Operators on literal fixtures, and against brute force where SQL has no say."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from articleflow.operators import (
    discovery,
    enrich,
    entries,
    feeds,
    prompts,
    rules,
    sharing,
    similar,
    sitesettings,
    state,
    versions,
)
from articleflow.operators.entries import EntryQuery
from articleflow.operators.ordering import over_groups, top_per_group
from articleflow.operators.sizing import attach
from articleflow.sources import tables

T0 = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# --- ordering ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """Three quarters of the rows in one group, with ties in the first sort column."""
    rng = random.Random(3)
    data = [(0 if i % 4 else i % 7, rng.randint(0, 60), i, rng.random() < 0.3) for i in range(1200)]
    return spark.createDataFrame(data, "g int, t int, id int, hit boolean").cache()


def test_segments_are_cut(skewed):
    seen = []

    def work(groups):
        seen.append(groups)
        return groups.result()

    out = over_groups(skewed, ["g"], ["t", "id"], work, segment_rows=200)
    large, usual = seen
    sizes = large.df.groupBy("_segment").count().collect()
    assert {r["g"] for r in large.df.select("g").distinct().collect()} == {0}
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 600
    assert usual.df.where("g = 0").isEmpty() and out.count() == skewed.count()


def test_every_large_group_is_cut(spark):
    """Many groups above the limit, one of them of a null key."""
    data = [(None if g == 0 else g, i) for g in range(30) for i in range(120)]
    df = spark.createDataFrame(data, "g int, i int")
    seen = []

    def work(groups):
        seen.append(groups)
        return groups.running_sum(F.lit(1), "n").result()

    out = over_groups(df, ["g"], ["i"], work, segment_rows=70)
    assert seen[0].segmented and seen[0].df.count() == len(data) and seen[1].df.isEmpty()
    assert out.where("n <> i + 1").isEmpty() and out.count() == len(data)


@pytest.mark.parametrize("what", ["neighbours", "running_sum", "carry_last"])
def test_segments_change_nothing(skewed, what):
    def work(groups):
        if what == "neighbours":
            groups = groups.neighbours({"before": ("id", -1), "after": ("id", 1)})
        elif what == "running_sum":
            groups = groups.running_sum(F.col("hit"), "hits")
        else:
            groups = groups.carry_last(F.when(F.col("hit"), F.col("id")), "last_hit")
        return groups.result()

    def run(limit):
        out = over_groups(skewed, ["g"], ["t", "id"], work, limit)
        return sorted(repr(r) for r in out.select(sorted(out.columns)).collect())

    plain = run(10_000)
    assert plain and plain == run(40) == run(200)


@pytest.fixture
def sorted_repr():
    return lambda df: sorted(map(repr, df.collect()))


def test_top_per_group_with_spread(skewed, sorted_repr):
    order = [F.desc("t"), F.col("id")]
    a = top_per_group(skewed.repartition(6), ["g"], order, 5, rank="n")
    b = top_per_group(skewed.repartition(6), ["g"], order, 5, spread=4, rank="n")
    assert sorted_repr(a) == sorted_repr(b) and a.count() > 5


def test_attach_beyond_bound(spark):
    facts = spark.range(100).withColumn("k", F.col("id") % 10)
    dim = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = attach(facts, dim, "k"), attach(facts, dim, "k", max_rows=3)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    plans = [d._jdf.queryExecution().logical().toString().lower() for d in (a, b)]
    assert "hint" in plans[0] and "hint" not in plans[1]


def test_neighbours_with_hot_feed(spark, sorted_repr):
    data = [(0 if i % 3 else i % 5, i, T0 + timedelta(hours=i % 17)) for i in range(400)]
    df = spark.createDataFrame(data, "feed_id bigint, entry_id bigint, published_at timestamp_ntz")
    assert sorted_repr(entries.neighbours(df)) == sorted_repr(entries.neighbours(df, segment_rows=50))


# --- change detection ------------------------------------------------------------------------


def _polls(spark, data):
    return spark.createDataFrame(
        data,
        "entry_id bigint, polled_at timestamp_ntz, source_hash string, fetched boolean, content_hash string, force boolean",
    )


def _poll(entry, minute, source, content, force=False):
    return (entry, T0 + timedelta(minutes=minute), source, content is not None, content, force)


CASES = [
    # name, stored (version, source_hash, content_hash) or None, polls, expected (action, version)
    ("skip", (3, "s", "c"), [("s", "x")], [("skip", 3)]),
    ("backfill", (3, None, "c"), [("s", "x"), ("s", "x")], [("backfill", 3), ("skip", 3)]),
    ("failed_touch", (1, "s", "c"), [("t", None), ("t", "x")], [("failed_touch", 1), ("skip", 1)]),
    ("failed_retry", None, [("s", None), ("s", None), ("s", "c")], [("failed_retry", 0), ("failed_retry", 0), ("insert_new", 1)]),
    ("unchanged", (1, "s", "c"), [("t", "c")], [("unchanged_touch", 1)]),
    ("version", (1, "s", "c"), [("t", "d"), ("u", "e")], [("insert_version", 2), ("insert_version", 3)]),
    ("new", None, [("s", "c"), ("s", "c")], [("insert_new", 1), ("skip", 1)]),
    ("revert", None, [("1", "a"), ("2", "b"), ("3", "a"), ("4", "b"), ("5", "c")],
     [("insert_new", 1), ("insert_version", 2), ("revert_touch", 2), ("unchanged_touch", 2), ("insert_version", 3)]),
]


@pytest.mark.parametrize("name,stored,polls,expected", CASES, ids=[c[0] for c in CASES])
def test_decision_table(spark, name, stored, polls, expected):
    df = _polls(spark, [_poll(1, i, s, c) for i, (s, c) in enumerate(polls)])
    base = None
    if stored:
        base = spark.createDataFrame([(1, *stored)], "entry_id bigint, version int, source_hash string, content_hash string")
    out = versions.detect_changes(df, base).orderBy("polled_at").collect()
    assert [(r["action"], r["version"]) for r in out] == expected


def test_revert_as_version(spark):
    df = _polls(spark, [_poll(1, i, str(i), c) for i, c in enumerate("aba")])
    out = versions.detect_changes(df, on_revert="version").orderBy("polled_at").collect()
    assert [(r["action"], r["version"]) for r in out] == [("insert_new", 1), ("insert_version", 2), ("insert_version", 3)]


def test_forced_fetch_compares_content_only(spark):
    df = _polls(
        spark,
        [
            _poll(1, 0, "s", "c"),
            _poll(1, 1, "s", "c", True),
            _poll(1, 2, "s", "d", True),
            _poll(1, 3, "t", None, True),
            _poll(1, 4, "s", "x"),
        ],
    )
    out = versions.detect_changes(df).orderBy("polled_at").collect()
    assert [r["action"] for r in out] == ["insert_new", "unchanged_touch", "insert_version", "failed_retry", "skip"]


def _sequential(polls, stored, on_revert):
    """One poll after the other, as the decision table reads."""
    state, seen, out = {}, {}, []
    for entry, version, source, content in stored:
        if entry not in state or version > state[entry][2]:
            state[entry] = (source, content, version)
        seen.setdefault(entry, set()).add(content)
    for entry, at, source, ok, content, _ in sorted(polls, key=lambda p: p[1]):
        have = state.get(entry)
        if have and have[0] == source:
            action = "skip"
        elif have and have[0] is None:
            action, state[entry] = "backfill", (source, *have[1:])
        elif not ok:
            action = "failed_touch" if have else "failed_retry"
            if have:
                state[entry] = (source, *have[1:])
        elif have and have[1] == content:
            action, state[entry] = "unchanged_touch", (source, *have[1:])
        elif have and on_revert == "touch" and content in seen.get(entry, ()):
            action, state[entry] = "revert_touch", (source, *have[1:])
        else:
            action = "insert_version" if have else "insert_new"
            state[entry] = (source, content, (have[2] if have else 0) + 1)
            seen.setdefault(entry, set()).add(content)
        out.append((entry, at, action, state[entry][2] if entry in state else 0))
    return sorted(out)


@pytest.mark.parametrize("on_revert", ["touch", "version"])
@pytest.mark.parametrize("segment_rows", [100_000, 20])
def test_detection_equals_sequential_run(spark, on_revert, segment_rows):
    rng = random.Random(17)
    polls, stored = [], []
    for i in range(500):
        entry = 0 if rng.random() < 0.4 else rng.randint(1, 30)
        content = None if rng.random() < 0.2 else rng.choice("abcd")
        polls.append(_poll(entry, i, rng.choice("stuv"), content))
    for entry in range(0, 31, 3):
        for v in range(1, rng.randint(2, 4)):
            stored.append((entry, v, rng.choice(["s", None, "z"]), "abcd"[v - 1]))
    base = spark.createDataFrame(stored, "entry_id bigint, version int, source_hash string, content_hash string")
    out = versions.detect_changes(_polls(spark, polls), base, on_revert, segment_rows)
    assert rows(out, "entry_id", "polled_at", "action", "version") == _sequential(polls, stored, on_revert)


def test_detection_is_idempotent(spark):
    polls = _polls(spark, [_poll(e, 0, f"s{e}", f"c{e}") for e in range(5)])
    first = versions.detect_changes(polls)
    stored = first.where("action LIKE 'insert%'").select("entry_id", "version", "source_hash", "content_hash")
    assert {r["action"] for r in versions.detect_changes(polls, stored).collect()} == {"skip"}


def test_version_diff_lines(spark):
    data = [(1, 1, T0, "a\nb\nc\n"), (1, 2, T0 + timedelta(hours=1), "a\nB\nc\n"), (1, 3, T0, "a\nB\nc\n")]
    df = spark.createDataFrame(data, "entry_id bigint, version int, fetched_at timestamp_ntz, content_text string")
    lines = [r["line"] for r in versions.version_diff(df).orderBy("to_version", "line_no").collect()]
    assert lines == ["--- v1 (2024-01-01 00:00)\n", "+++ v2 (2024-01-01 01:00)\n", "@@ -1,3 +1,3 @@\n", " a\n", "-b\n", "+B\n", " c\n"]
    changes = rows(versions.line_changes(df), "from_version", "to_version", "added", "removed")
    assert changes == [(1, 2, 1, 1), (2, 3, 0, 0)]


# --- rules and state -------------------------------------------------------------------------

FILTER_CASES = [
    ('[{"field":"title","op":"contains","value":"SPARK"}]', True),
    ('[{"field":"title","op":"not_contains","value":"spark"}]', False),
    ('[{"field":"author","op":"equals","value":"ann"}]', True),
    ('[{"field":"url","op":"starts_with","value":"HTTPS://"}]', True),
    ('[{"field":"feed_title","op":"equals","value":"daily"}]', True),
    ('[{"field":"content","op":"contains","value":"x"}]', False),
    ('[{"field":"content","op":"equals","value":""}]', True),
    ('[{"field":"nowhere","op":"equals","value":""}]', True),
    ('[{"field":"title","op":"resembles","value":"q"}]', True),
    ('[{"field":"title","op":"contains","value":"spark"},{"field":"author","op":"equals","value":"bob"}]', False),
]


@pytest.mark.parametrize("compiled_up_to", [0, 50])
def test_filters(spark, compiled_up_to):
    entry = spark.createDataFrame(
        [(1, "Apache Spark", None, "Ann", "https://x", "Daily")],
        "entry_id bigint, title string, content string, author string, url string, feed_title string",
    )
    saved = [rules.SavedFilter(i, str(i), rules.parse_rules(j), "star") for i, (j, _) in enumerate(FILTER_CASES)]
    saved += [rules.SavedFilter(98, "empty", (), "star"), rules.SavedFilter(99, "idle", rules.parse_rules(FILTER_CASES[0][0]), "")]
    hits = {r["filter_id"] for r in rules.match_filters(entry, saved, compiled_up_to).collect()}
    assert hits == {i for i, (_, hit) in enumerate(FILTER_CASES) if hit}


def test_many_filters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rules, "FILTERS_PER_BLOCK", 7)
    df = spark.range(40).select(F.col("id").alias("entry_id"), F.concat(F.lit("t"), "id").alias("title"))
    saved = [rules.SavedFilter(i, "", ({"field": "title", "op": "equals", "value": f"T{i}"},), "mark_read") for i in range(60)]
    assert rows(rules.match_filters(df, saved), "entry_id", "filter_id") == [(i, i) for i in range(40)]


def test_read_filters(spark):
    data = [(2, "b", [("title", "contains", "x")], "star"), (1, "a", [], "star"), (3, "c", [("title", "contains", "x")], None)]
    df = spark.createDataFrame(data, "id bigint, name string, rules array<struct<field:string,op:string,value:string>>, auto_action string")
    assert [f.id for f in rules.read_filters(df)] == [2]


def _replay(start, actions):
    status, starred, title = start
    for _, action, value, _, _ in sorted(actions, key=lambda a: (a[3], a[4])):
        if action in ("mark_read", "mark_unread"):
            status = "read" if action == "mark_read" else "unread"
        elif action in ("star", "unstar"):
            starred = action == "star"
        elif action == "toggle_star":
            starred = not starred
        elif action == "rename" and (value or "").strip():
            title = value.strip()
    return status, starred, title


def test_actions_equal_replay(spark):
    rng = random.Random(23)
    names = ["mark_read", "mark_unread", "star", "unstar", "toggle_star", "rename", "unknown"]
    log = []
    for seq in range(600):
        action = rng.choice(names)
        value = rng.choice(["New", " Padded ", "", None]) if action == "rename" else None
        who = 0 if rng.random() < 0.5 else rng.randint(1, 25)
        log.append((who, action, value, T0 + timedelta(minutes=rng.randint(0, 90)), seq))
    start = {i: (rng.choice(["read", "unread"]), rng.random() < 0.5, f"T{i}") for i in range(30)}
    current = spark.createDataFrame([(i, *s) for i, s in start.items()], "entry_id bigint, status string, starred boolean, title string")
    actions = spark.createDataFrame(log, "id bigint, action string, value string, ts timestamp_ntz, seq bigint")
    out = rows(state.apply_actions(current, actions, "entry_id"), "entry_id", "status", "starred", "title")
    assert out == sorted((i, *_replay(s, [a for a in log if a[0] == i])) for i, s in start.items())


def test_upsert_is_repeatable(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    once = tables.upsert(base, changes, ["k"], [F.desc("n")])
    assert rows(once) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(tables.upsert(once, changes, ["k"], [F.desc("n")])) == rows(once)
    path = str(tmp_path / "t")
    once.write.parquet(path)
    stored = spark.read.parquet(path)
    tables.replace_table(tables.delete_keys(stored, stored.where("k = 1"), ["k"]), path)
    again = spark.read.parquet(path)
    assert rows(again) == [(2, "y"), (3, "z")]
    assert rows(tables.insert_absent(again, base, ["k"])) == [(1, "a")]
    assert rows(tables.lookup(again, "k", 3)) == [(3, "z")] and rows(tables.lookup(again, "k", 2, 3)) == rows(again)


def test_config_changes(spark):
    config = spark.createDataFrame([(1, 2, True), (2, 1, False)], "feed_id bigint, priority int, fetch_full_content boolean")
    changes = spark.createDataFrame([(1, 9, 1), (1, 0, 2), (3, None, 1)], "feed_id bigint, priority int, at int")
    assert rows(state.set_config(config, changes)) == [(1, 1, True), (2, 1, False), (3, 2, False)]
    flipped = state.toggled(config, spark.createDataFrame([(2,), (4,), (4,)], "feed_id bigint"))
    assert rows(flipped, "feed_id", "priority", "fetch_full_content") == [(1, 2, True), (2, 1, True), (4, 2, False)]


def test_config_columns_change_apart(spark):
    config = spark.createDataFrame([(1, 2, False)], "feed_id bigint, priority int, fetch_full_content boolean")
    log = [(1, 1, None, 1), (1, None, True, 2), (5, 3, None, 2), (5, None, None, 3)]
    changes = spark.createDataFrame(log, "feed_id bigint, priority int, fetch_full_content boolean, at int")
    assert rows(state.set_config(config, changes)) == [(1, 1, True), (5, 3, False)]


def test_discovered_updates_keep_one_row_per_feed(spark):
    known = spark.createDataFrame([(1, "a", "A", "s"), (2, "b", "B", None)], "feed_id bigint, feed_url string, title string, site_url string")
    log = [(1, 1, "u1", "T1", None), (1, 2, "u2", "  ", "s2"), (1, 3, "", None, " ")]
    updates = spark.createDataFrame(log, "feed_id bigint, at int, new_url string, new_title string, new_site_url string")
    out = rows(state.apply_discovered(known, updates), "feed_id", "feed_url", "title", "site_url")
    assert out == [(1, "u2", "T1", "s2"), (2, "b", "B", None)]
    assert state.apply_discovered(known, updates.drop("at")).count() == 2


def test_survivors_are_the_smallest_rows(spark):
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 1)], "k int, v string, n int")
    assert rows(tables.insert_absent(new.where("k = 2"), new, ["k"])) == [(1, "a", 3)]


def test_schema_evolution(spark, tmp_path):
    path = str(tmp_path / "config")
    spark.createDataFrame([(1, True)], "feed_id bigint, dropped boolean").write.parquet(path)
    df = tables.read_table(spark, "feed_config", path)
    row = df.first()
    assert "dropped" not in df.columns and row["priority"] == 2 and row["fetch_full_content"] is False


# --- feeds -----------------------------------------------------------------------------------


def test_addresses(spark):
    day = [T0 + timedelta(days=i) for i in range(9)]
    history = [
        (1, "a", "b", "s", day[1]), (1, "b", "c", "s", day[2]), (1, "c", "d", "s", day[3]),
        (2, "x", "y", "s", day[1]), (2, "y", "x", "s", day[2]),
        (3, "p", "q", "s", day[4]), (3, "q", "r", "s", day[1]),
        (4, "same", "same", "s", day[1]), (4, None, "n", "s", day[1]), (4, "", "n", "s", day[1]),
        (5, "k", "old", "s", day[1]), (6, "k", "new", "s", day[5]),
    ]
    df = spark.createDataFrame(history, "feed_id bigint, old_url string, new_url string, source string, changed_at timestamp_ntz")
    found = {r["old_url"]: (r["current_url"], r["feed_id"]) for r in feeds.resolve_addresses(df).collect()}
    assert found == {
        "a": ("d", 1), "b": ("d", 1), "c": ("d", 1),
        "x": ("x", 2), "y": ("x", 2),
        "p": ("q", 3), "q": ("r", 3),
        "k": ("new", 6),
    }


def test_health_flags(spark):
    data = [
        (1, "B", datetime(2024, 1, 30, 11), 0, "", False),
        (2, "a", datetime(2024, 1, 29, 11), 0, "", False),
        (3, "c", None, 5, "server error", False),
        (4, "d", datetime(2024, 1, 1), 3, "x", True),
        (5, "e", datetime(2024, 1, 1), 3, None, False),
        (6, "f", datetime(2024, 1, 30), 1, "dial tcp", None),
    ]
    df = spark.createDataFrame(data, "feed_id bigint, title string, checked_at timestamp_ntz, parsing_error_count int, parsing_error_message string, disabled boolean")
    now = F.lit(datetime(2024, 1, 30, 12)).cast("timestamp_ntz")
    buckets = dict(rows(feeds.with_health(df, now), "feed_id", "bucket"))
    assert buckets == {1: "ok", 2: "stale", 3: "server_5xx", 4: "paused", 5: "stale", 6: "connect_fail"}
    assert tuple(feeds.health_summary(df, now).first()) == (2, 1, 1)
    order = [r["feed_id"] for r in feeds.health_sections(df, now).collect()]
    assert order == [3, 6, 2, 5, 4, 1]
    text = df.withColumn("checked_at", F.lit("not a date"))
    assert {r["checked_ago"] for r in feeds.with_health(text, now).collect()} == {None}


def test_site_settings(spark):
    urls = spark.createDataFrame([(1, "https://www.a.org/x"), (2, "https://b.org"), (3, "https://www.b.org"), (4, "https://c.org"), (5, "junk")], "id int, url string")
    saved = spark.createDataFrame([("www.a.org", {"k": "exact"}), ("a.org", {"k": "bare"}), ("b.org", {"k": "b"})], "domain string, settings map<string,string>")
    out = {r["id"]: (r["settings"] or {}).get("k") for r in sitesettings.settings_for(urls, saved).collect()}
    assert out == {1: "exact", 2: "b", 3: "b", 4: None, 5: None}


def test_shares(spark):
    now = datetime(2024, 1, 30)
    links = spark.createDataFrame(
        [(1, "live", now + timedelta(days=1)), (2, "dead", now - timedelta(seconds=1)), (3, "ever", None)],
        "entry_id bigint, token string, expires_at timestamp_ntz",
    )
    asked = spark.createDataFrame([("live",), ("dead",), ("ever",), ("none",)], "token string")
    articles = spark.createDataFrame([(1, "feed1"), (2, "feed2"), (3, "feed3")], "entry_id bigint, content string")
    snaps = spark.createDataFrame([(1, 1, "v1"), (1, 2, "v2")], "entry_id bigint, version int, content_html string")
    out = sharing.resolve_shares(asked, links, articles, snaps, F.lit(now).cast("timestamp_ntz"))
    assert sorted(map(str, rows(out.na.fill("-"), "token", "status", "content"))) == sorted(
        map(str, [("live", "ok", "v2"), ("dead", "expired", "-"), ("ever", "ok", "feed3"), ("none", "not_found", "-")])
    )


# --- discovery -------------------------------------------------------------------------------


def test_links(spark):
    page = """<html><head>
      <link rel="alternate" type="application/atom+xml" href="a.atom" title=" T ">
      <link rel="alternate" type="application/rss+xml" href="/rss"/>
      <LINK REL=alternate TYPE="APPLICATION/RSS+XML" HREF="https://h.org/rss">
      <link rel="alternate" href=" "><link rel="alternate">
      <link rel="feed" href="/feed"><link rel="alternate" type="text/html" href="/en">
      <link rel="alternate stylesheet" href="/x.xml"><link rel='alternate' href='/broken.xml"""
    df = spark.createDataFrame([("https://h.org/d/p", page), ("https://e.org", "<p>none</p>"), ("https://n.org", None)], "url string, html string")
    got = [(r["feed_url"], r["title"], r["type"]) for r in discovery.discover_links(df).orderBy("pos").collect()]
    assert got == [("https://h.org/d/a.atom", "T", "atom"), ("https://h.org/rss", "", "rss"), ("https://h.org/feed", "", "rss")]


def test_fetch_stages(spark):
    tries = spark.createDataFrame(
        [("u", 1, False, None), ("u", 3, True, "three"), ("u", 2, True, "two"), ("v", 1, False, None)],
        "url string, stage int, ok boolean, body string",
    )
    asked = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    out = {r["url"]: (r["stage"], r["body"]) for r in discovery.resolve_fetch(asked, tries).collect()}
    assert out == {"u": (2, "two"), "v": (None, None), "w": (None, None)}


# --- prompts, models, similarity ----------------------------------------------------------------


def _sequential_slugs(names, taken):
    used, out = set(taken), []
    for seq, base in names:
        slug, n = base, 2
        while slug in used:
            slug, n = f"{base}_{n}", n + 1
        used.add(slug)
        out.append((seq, slug))
    return out


def test_unique_slugs(spark):
    rng = random.Random(1)
    names = [(i, rng.choice(["a", "b", "c", "long name", "a 7x"])) for i in range(60)]
    taken = ["a", "a_3", "b_2", "long_name_2", "c_10", "zz"]
    out = prompts.unique_slugs(
        spark.createDataFrame(names, "seq int, name string"), spark.createDataFrame([(t,) for t in taken], "slug string")
    )
    expected = _sequential_slugs([(i, n.replace(" ", "_")) for i, n in names], taken)
    assert rows(out, "seq", "slug") == sorted(expected)


def test_unique_slugs_stay_unique_across_bases(spark):
    names = [(1, "a"), (2, "a"), (3, "a 2"), (4, "a"), (5, "a 2"), (6, "a 2 2")]
    out = prompts.unique_slugs(spark.createDataFrame(names, "seq int, name string"), spark.createDataFrame([], "slug string"))
    slugs = [s for _, s in rows(out, "seq", "slug")]
    assert len(set(slugs)) == len(names)


def test_builtin_prompts(spark):
    library = prompts.builtin_prompts(spark)
    assert [r["id"] for r in prompts.list_prompts(library).collect()] == ["bullets", "default", "eli5", "skeptic"]
    with pytest.raises(ValueError):
        prompts.summary_requests(spark.createDataFrame([(1, 1, "t")], "entry_id bigint, version int, content_text string"), library, ["nope"])


def test_model_failures_are_isolated(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return ["Tag One, two"] * len(texts)

    data = [(1, "good " * 20), (2, "bad " * 20), (3, "short"), (4, None), (5, "fine " * 20)]
    out = enrich.classify(spark.createDataFrame(data, "id int, content_text string").coalesce(1), model)
    got = {r["id"]: (r["tags"], r["tags_error"]) for r in out.collect()}
    assert got[1] == got[5] == (["tag one", "two"], None)
    assert got[2] == ([], "RuntimeError: no answer")
    assert got[3] == got[4] == ([], None)


def test_summaries_and_embeddings(spark):
    snaps = spark.createDataFrame([(1, 2, "words " * 60), (2, 1, "tiny"), (3, 1, "")], "entry_id bigint, version int, content_text string")
    asked = prompts.summary_requests(snaps, prompts.builtin_prompts(spark), ["default", "eli5"])
    out = enrich.summarise(asked, lambda prompts_: [str(len(p.split("\n\n")[1].split())) for p in prompts_])
    assert sorted(map(str, rows(out, "entry_id", "prompt_id", "summary"))) == sorted(
        map(str, [(1, "default", "60"), (1, "eli5", "60"), (2, "default", None), (2, "eli5", None)])
    )
    vectors = enrich.embed(snaps, lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert [r["embedding"] for r in vectors.orderBy("entry_id").collect()] == [[359.0, 1.0], [4.0, 1.0], None]


def test_keyword_tags(spark):
    data = [(1, "alpha alpha alpha common"), (2, "beta beta common"), (3, "gamma common"), (4, "")]
    out = enrich.keyword_tags(spark.createDataFrame(data, "entry_id bigint, content string"), n=1)
    assert rows(out, "entry_id", "tag", "rank") == [(1, "alpha", 1), (2, "beta", 1), (3, "gamma", 1)]


def test_keyword_tags_count_words_not_buckets(spark):
    bucket = lambda ws: pd.util.hash_array(np.array(ws, dtype=object)) % np.uint64(1 << 17)
    letters = "abcdefghijklmnopqrst"
    names = ["zz" + "".join(letters[(i // 20**k) % 20] for k in range(5)) for i in range(1_000_000)]
    rare = names[np.flatnonzero(bucket(names) == bucket(["common"])[0])[0]]
    data = [(1, f"{rare} other common"), (2, "other common")] + [(i, "common") for i in range(3, 40)]
    out = enrich.keyword_tags(spark.createDataFrame(data * 2, "entry_id bigint, content string"), n=1)
    got = rows(out.where("entry_id = 1"), "entry_id", "tag", "rank")
    assert got == [(1, rare, 1)] * 2


def _brute(data, threshold, limit):
    ids = [d[0] for d in data]
    x = np.array([d[1] for d in data])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 12)
    out = set()
    for i, a in enumerate(ids):
        near = sorted((-sims[i, j], b) for j, b in enumerate(ids) if b != a and sims[i, j] >= threshold)
        out |= {(a, b) for _, b in near[:limit]}
    return out


@pytest.fixture(scope="module")
def clustered():
    """Clusters of near vectors, and one vector held by a third of all entries."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    data = [(i, (centres[i % 12] + 0.25 * rng.standard_normal(16)).tolist()) for i in range(200)]
    data += [(1000 + i, centres[0].tolist()) for i in range(100)]
    return data


@pytest.mark.parametrize("tile_rows,pivots", [(2048, None), (16, 8), (7, 1)])
def test_similar_entries_exact(spark, clustered, tile_rows, pivots):
    df = spark.createDataFrame(clustered, "entry_id bigint, embedding array<double>")
    out = similar.similar_entries(df, 0.85, 5, pivots=pivots, tile_rows=tile_rows)
    assert set(rows(out, "entry_id", "other_id")) == _brute(clustered, 0.85, 5)


def test_similar_entries_hashed_recall(spark, clustered):
    df = spark.createDataFrame(clustered, "entry_id bigint, embedding array<double>")
    out = similar.similar_entries(df, 0.85, 5, method="hashed", bands=16, bits=4)
    everything = {(a, b) for a, b in _brute(clustered, 0.85, 10_000)}
    found = set(rows(out, "entry_id", "other_id"))
    assert found <= everything
    assert len(found & _brute(clustered, 0.85, 5)) > 0.9 * len(_brute(clustered, 0.85, 5))


def test_similar_to_one(spark, clustered):
    df = spark.createDataFrame(clustered + [(5000, [0.0] * 16)], "entry_id bigint, embedding array<double>")
    vector = similar.vector_of(df, 3)
    found = [r["entry_id"] for r in similar.similar_to(df, 3, vector).collect()]
    assert set(found) == {b for a, b in _brute(clustered, 0.85, 5) if a == 3}
    assert similar.vector_of(df, -1) is None


# --- entries ---------------------------------------------------------------------------------


def test_pages_join_up(spark):
    """Offset pages and keyset pages walk the same list without gaps or repeats."""
    data = [(i, i % 7, "t", "c", "unread", False, T0 + timedelta(hours=i % 11)) for i in range(60)]
    df = spark.createDataFrame(data, "entry_id bigint, feed_id bigint, title string, content string, status string, starred boolean, published_at timestamp_ntz")
    config = spark.createDataFrame([(0, 1), (1, 3)], "feed_id bigint, priority int")
    tags = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "entry_id bigint, tag string")
    snaps = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "entry_id bigint, version int")
    whole = [r["entry_id"] for r in entries.entry_list(df, config, tags, snaps, EntryQuery(limit=None)).collect()]
    paged = []
    for offset in range(0, 60, 25):
        page = entries.entry_list(df, config, tags, snaps, EntryQuery(limit=25, offset=offset)).collect()
        paged += [r["entry_id"] for r in page]
    assert paged == whole and len(set(whole)) == 60
    listed, last, keyset = entries.with_priority(df, config), None, []
    first = listed.orderBy(*entries.tier_order()).limit(25).collect()
    while first:
        keyset += [r["entry_id"] for r in first]
        last = first[-1]
        first = entries.page_after(listed, (last["priority"], last["published_at"], last["entry_id"]), 25).collect()
    assert keyset == whole
    one = entries.entry_list(df, config, tags, snaps, EntryQuery(feed_id=1, limit=50)).collect()
    assert {r["feed_id"] for r in one} == {1}
    assert [(r["tags"], r["has_changes"]) for r in one if r["entry_id"] == 1] == [(["x"], True)]
    assert entries.entry_list(df, config, tags, snaps, EntryQuery(search="nothing such")).collect() == []
    assert entries.has_next(50) and not entries.has_next(49)


def test_filter_table_gives_what_compiled_filters_give(spark):
    import itertools
    import json
    import random

    from articleflow.operators import rules

    rng = random.Random(7)
    texts = ["", "a", "ab", "News Today", "today is new", "ÉTÉ à Paris", "x" * 400 + "needle" + "y" * 300, None, "😀 smile", "a\nb"]
    entries = [(i, rng.choice(texts), rng.choice(texts), f"https://h{i}.org/p") for i in range(60)] + [(3, "News again", "b", "u")]
    entries = spark.createDataFrame(entries, "entry_id long, title string, content string, url string")
    values = ["", None, "a", "AB", "new", "News Today", "été", "needle", "😀", "zzz", "h1", "a\nb"]
    made = []
    kinds = ["contains", "not_contains", "equals", "starts_with", "matches", None]
    for op, field in itertools.product(kinds, ["title", "content", "url", "author", "other", None]):
        for n in (1, 2, 3):
            made.append([{"field": field if k == 0 else rng.choice(["title", "content"]), "op": op if k == 0 else rng.choice(kinds), "value": rng.choice(values)} for k in range(n)])
    rows = [(i, r, rng.choice(["star", "mark_read", "", None])) for i, r in enumerate([*made, [], None])]
    kind = "id long, rules array<struct<field string, op string, value string>>, auto_action string"
    table = spark.createDataFrame(rows, kind)
    filters = [rules.SavedFilter(i, "", rules.parse_rules(json.dumps(r or [])), a) for i, r, a in rows]
    want = {tuple(r) for r in rules.match_filters(entries, filters).collect()}
    got = [tuple(r) for r in rules.match_filter_table(entries, table).collect()]
    assert set(got) == want and len(want) > 100
    assert not rules.match_filter_table(entries, table.limit(0)).collect()


def test_two_new_summaries_of_one_version_give_one_row(spark):
    from articleflow.operators import digest

    snapshots = spark.createDataFrame([(1, 1, None), (2, 1, '{"summary":"s"}')], "entry_id long, version int, metadata string")
    new = [(1, 1, {"a": "x"}), (1, 1, {"b": "y", "a": "w"}), (2, 1, {})]
    new = spark.createDataFrame(new, "entry_id long, version int, summaries map<string,string>")
    out = {r.entry_id: r.metadata for r in digest.store_summary(snapshots, new).collect()}
    assert len(out) == 2 and '"a":"x"' in out[1] and '"b":"y"' in out[1] and '"summary":"s"' in out[2]


def test_line_changes_keep_pairs_of_empty_texts(spark):
    from articleflow.operators import versions

    rows = [(1, 1, ""), (1, 2, None), (2, 1, "a\nb"), (2, 2, ""), (2, 3, "b\nc")]
    snapshots = spark.createDataFrame(rows, "entry_id long, version int, content_text string")
    out = versions.line_changes(snapshots.withColumn("fetched_at", F.current_timestamp()))
    got = {(r.entry_id, r.to_version): (r.added, r.removed) for r in out.collect()}
    assert got == {(1, 2): (0, 0), (2, 2): (0, 2), (2, 3): (2, 0)}


def test_filters_that_differ_late_meet_only_their_entries(spark, monkeypatch):
    from articleflow.operators import rules

    met = []
    attach = rules.attach

    def counted(facts, dimension, on, **kw):
        if on == "filter_id":
            met.append(facts.count())
        return attach(facts, dimension, on, **kw)

    monkeypatch.setattr(rules, "attach", counted)
    entries = spark.range(1000, 2000).selectExpr("id AS entry_id", "concat('https://feeds.example.com/articles/', id) AS url")
    short = "named_struct('field', 'url', 'op', 'contains', 'value', concat('ES/', id))"
    long = "named_struct('field', 'url', 'op', 'starts_with', 'value', concat('https://feeds.example.com/articles/', id))"
    table = spark.range(1000, 2000).selectExpr("id", f"array(IF(id % 2 = 0, {short}, {long})) AS rules", "'star' AS auto_action")
    got = rules.match_filter_table(entries, table).collect()
    assert sorted((r["entry_id"], r["filter_id"]) for r in got) == [(i, i) for i in range(1000, 2000)]
    assert met == [1000]
