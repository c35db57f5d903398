"""Change detection on a stream of polls, with the entry's snapshot state kept by Spark."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "entry_id bigint, feed_id bigint, polled_at timestamp, source_hash string, "
    "content_hash string, action string, version int"
)

_Decision = Row("entry_id", "feed_id", "polled_at", "source_hash", "content_hash", "action", "version")

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SnapshotState(StatefulProcessor):
    """State of one entry: its source hash, latest content and version, and all contents seen.

    Decides like ``versions.detect_changes``; see the table there. With ``remember_ms`` a content that
    was not seen again for so long is forgotten, so state stops growing with an entry's history.

    Every call of the state store is a round trip to the JVM. So the contents of a batch are gathered and
    written once each, and an entry without state is not asked for contents, of which it has none.
    """

    def __init__(self, on_revert: str = "touch", remember_ms: int | None = None):
        self.on_revert = on_revert
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState(
            "latest", "source_hash string, content_hash string, version int"
        )
        self.seen = handle.getMapState("seen", "content_hash string", "version int", self.remember_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Start from stored snapshots, one a call: the newest is the entry's state, all contents are seen."""
        row = initialState
        if row.content_hash is not None:
            self.seen.updateValue((row.content_hash,), (row.version,))
        if not self.latest.exists() or row.version > self.latest.get()[2]:
            self.latest.update((row.source_hash, row.content_hash, row.version))

    def _is_seen(self, content, gathered: dict, stored: bool) -> bool:
        return content in gathered or (stored and self.seen.containsKey((content,)))

    def _decide(self, poll, state, gathered: dict, stored: bool):
        """``gathered``: contents to write with their versions; ``stored``: whether the entry had state before."""
        exists = state is not None
        source, content, version = state if exists else (None, None, 0)
        forced = bool(poll.force)
        if exists and not forced:
            if source is None:
                return "backfill", (poll.source_hash, content, version)
            if source == poll.source_hash:
                return "skip", state
        if not poll.fetched:
            if exists and not forced:
                return "failed_touch", (poll.source_hash, content, version)
            return "failed_retry", state
        if exists and poll.content_hash == content:
            return "unchanged_touch", (poll.source_hash, content, version)
        if exists and self.on_revert == "touch" and self._is_seen(poll.content_hash, gathered, stored):
            if self.remember_ms is not None and poll.content_hash not in gathered:
                gathered[poll.content_hash] = self.seen.getValue((poll.content_hash,))[0]
            return "revert_touch", (poll.source_hash, content, version)
        gathered[poll.content_hash] = version + 1
        action = "insert_version" if exists else "insert_new"
        return action, (poll.source_hash, poll.content_hash, version + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.latest.get() if self.latest.exists() else None
        state, gathered = before, {}
        polls = deque(sorted(rows, key=_poll_order))
        while polls:
            poll = polls.popleft()
            action, state = self._decide(poll, state, gathered, before is not None)
            version = 0 if state is None else state[2]
            yield _Decision(
                key[0], poll.feed_id, poll.polled_at, poll.source_hash, poll.content_hash, action, version
            )
        for content, version in gathered.items():
            self.seen.updateValue((content,), (version,))
        if state != before:
            self.latest.update(state)

    def close(self) -> None:
        pass


def _poll_order(poll: Row) -> tuple:
    """Time, then source hash and content hash; nulls first."""
    at, source, content = poll.polled_at, poll.source_hash, poll.content_hash
    return (at is not None, at, source is not None, source, content is not None, content)


def stream_changes(
    polls: DataFrame,
    on_revert: str = "touch",
    stored: DataFrame | None = None,
    remember: timedelta | None = None,
) -> DataFrame:
    """Decisions for a stream of polls (entry_id, feed_id, polled_at, source_hash, fetched,
    content_hash, optional force). Needs the RocksDB state store.

    ``stored``: snapshots (entry_id, version, source_hash, content_hash) the first run starts from; a
    restarted query goes on from its own checkpoint instead. ``remember``: how long a content hash is
    kept after it was last seen; without it, for ever. A content that was forgotten counts as new.

    Only hashes pass through the stateful step; articles are joined to inserts afterwards.
    """
    if "force" not in polls.columns:
        polls = polls.withColumn("force", F.lit(False))
    # Spark inspects the processor in a driver-side worker that does not see files shipped to
    # executors, so the class travels with the plan.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    narrow = polls.select(
        "entry_id",
        "feed_id",
        F.col("polled_at").cast("timestamp").alias("polled_at"),
        "source_hash",
        "fetched",
        "content_hash",
        "force",
    )
    initial = None
    if stored is not None:
        known = stored.select("entry_id", F.col("version").cast("int").alias("version"), "source_hash", "content_hash")
        initial = known.where("entry_id is not null and version is not null").groupBy("entry_id")
    span = None if remember is None else int(remember.total_seconds() * 1000)
    return narrow.groupBy("entry_id").transformWithState(
        statefulProcessor=SnapshotState(on_revert, span),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if span is None else "ProcessingTime",
        initialState=initial,
    )
