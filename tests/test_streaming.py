"""Streams give what the batch operators give, also across restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from articleflow.operators import versions
from articleflow.operators.rules import SavedFilter, parse_rules
from articleflow.streaming import reads
from articleflow.streaming.ingest import IngestJob
from articleflow.streaming.versions import STATE_STORE, SnapshotState

T0 = datetime(2024, 1, 1)
POLL = "entry_id bigint, feed_id bigint, polled_at timestamp, source_hash string, fetched boolean, content_hash string, force boolean, url string, content_text string"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STATE_STORE)
    yield
    spark.conf.unset(key)


def poll(entry, minute, source, content, force=False):
    return (entry, entry % 3, T0 + timedelta(minutes=minute), source, content is not None, content, force, f"https://h{entry}.org", f"text {content}")


FIRST = [poll(1, 0, "a", "x"), poll(1, 1, "a", "x"), poll(2, 0, "a", None), poll(3, 0, "s", "k"), poll(1, 2, "b", "y"), poll(1, 3, "c", "x")]
SECOND = [poll(2, 5, "a", "z"), poll(3, 5, "t", None), poll(3, 6, "t", "q"), poll(1, 5, "d", "y"), poll(1, 6, "d", "w", True), poll(4, 5, "n", "m")]


def _job(spark, folder, **kw):
    source = str(folder / "in")
    return IngestJob(
        polls=spark.readStream.schema(POLL).parquet(source),
        articles=lambda s: s.read.schema(POLL).parquet(source).drop("fetched", "force"),
        out=str(folder / "out"),
        checkpoint=str(folder / "checkpoint"),
        **kw,
    )


def _run(spark, folder, data, **kw):
    spark.createDataFrame(data, POLL).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    _job(spark, folder, **kw).start(once=True).awaitTermination()


def test_stream_equals_batch_over_restarts(spark, tmp_path, rocksdb):
    _run(spark, tmp_path, FIRST)
    _run(spark, tmp_path, SECOND)
    columns = ["entry_id", "polled_at", "action", "version"]
    streamed = spark.read.parquet(str(tmp_path / "out" / "decisions")).select(*columns)
    batch = versions.detect_changes(spark.createDataFrame(FIRST + SECOND, POLL)).select(*columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    # Nothing new arrives: a further run changes nothing.
    _job(spark, tmp_path).start(once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "decisions")).count() == len(FIRST + SECOND)
    stored = spark.read.parquet(str(tmp_path / "out" / "snapshots"))
    numbers = stored.groupBy("entry_id").agg(F.sort_array(F.collect_list("version")).alias("v")).collect()
    assert {r["entry_id"]: r["v"] for r in numbers} == {1: [1, 2, 3], 2: [1], 3: [1], 4: [1]}
    assert stored.where("entry_id = 4").first()["content_text"] == "text m"


def test_repeated_batch_overwrites_itself(spark, tmp_path, rocksdb):
    _run(spark, tmp_path, FIRST)
    job = _job(spark, tmp_path)
    stored = spark.read.parquet(str(tmp_path / "out" / "decisions")).drop("batch_id")
    decided = spark.createDataFrame([tuple(r) for r in stored.collect()], stored.schema)
    before = spark.read.parquet(str(tmp_path / "out" / "snapshots")).count()
    job._process(decided, 0)
    assert spark.read.parquet(str(tmp_path / "out" / "snapshots")).count() == before


def test_filters_and_enrichment_see_new_articles(spark, tmp_path, rocksdb):
    filters = [SavedFilter(7, "h", parse_rules('[{"field":"url","op":"contains","value":"H"}]'), "mark_read")]
    enrich = {"lengths": lambda df: df.select("entry_id", "version", F.length("content_text").alias("n"))}
    _run(spark, tmp_path, FIRST, filters=filters, enrich=enrich)
    _run(spark, tmp_path, SECOND, filters=filters, enrich=enrich)
    out = str(tmp_path / "out")
    actions = spark.read.parquet(f"{out}/actions")
    assert sorted((r["id"], r["action"]) for r in actions.collect()) == [(e, "mark_read") for e in (1, 2, 3, 4)]
    assert spark.read.parquet(f"{out}/lengths").count() == spark.read.parquet(f"{out}/snapshots").count() == 6


def test_daily_reads(spark, tmp_path):
    data = [(i, T0 + timedelta(hours=7 * i)) for i in range(20)]
    schema = "id bigint, read_at timestamp"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for part in (data[:12], data[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        reads.write_updates(reads.daily_reads(stream), log, str(tmp_path / "cp")).awaitTermination()
    got = reads.latest_updates(spark.read.parquet(log), ["day"])
    batch = spark.createDataFrame(data, schema).groupBy(F.to_date("read_at").alias("day")).count()
    assert sorted(map(tuple, got.select("day", "cnt").collect())) == sorted(map(tuple, batch.collect()))


def test_unread_deltas(spark):
    log = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 4), (5, 6)], "poll bigint, count bigint")
    out = reads.unread_deltas(log).orderBy("poll").collect()
    assert [r["new"] for r in out] == [0, 4, 0, 0, 2]


def test_unread_deltas_of_a_log_in_segments(spark, monkeypatch):
    monkeypatch.setattr("articleflow.operators.ordering.SEGMENT_ROWS", 20)
    counts = [(i * 37) % 101 for i in range(300)]
    log = spark.createDataFrame(list(enumerate(counts)), "poll bigint, count bigint")
    out = reads.unread_deltas(log).orderBy("poll").collect()
    assert [r["new"] for r in out] == [0] + [max(b - a, 0) for a, b in zip(counts, counts[1:])]


STORED = "entry_id bigint, version int, source_hash string, content_hash string"


def _decisions(spark, folder):
    rows = spark.read.parquet(str(folder / "out" / "decisions")).select("entry_id", "polled_at", "action", "version").collect()
    return sorted(map(tuple, rows))


def test_stream_goes_on_from_stored_snapshots(spark, tmp_path, rocksdb):
    rows = [(1, 4, "a", "x"), (1, 3, "o", "y"), (2, 2, None, "old"), (3, 9, "q", "k"), (7, 1, "u", "v")]
    stored = spark.createDataFrame(rows, STORED)
    _run(spark, tmp_path, FIRST, stored=stored)
    _run(spark, tmp_path, SECOND, stored=stored)
    batch = versions.detect_changes(spark.createDataFrame(FIRST + SECOND, POLL), stored)
    want = sorted(map(tuple, batch.select("entry_id", "polled_at", "action", "version").collect()))
    got = _decisions(spark, tmp_path)
    assert got == want
    assert [r[2] for r in got if r[0] == 2] == ["backfill", "skip"] and max(r[3] for r in got if r[0] == 1) == 5


def test_forgotten_contents_leave_the_state(spark, tmp_path, rocksdb):
    again = [poll(1, 9, "e", "x")]
    for name, remember, action in (("short", timedelta(milliseconds=1), "insert_version"), ("long", timedelta(days=9), "revert_touch")):
        folder = tmp_path / name
        _run(spark, folder, FIRST, remember=remember)
        _run(spark, folder, [poll(1, 8, "d", "y")], remember=remember)
        _run(spark, folder, again, remember=remember)
        assert {r[1]: r[2] for r in _decisions(spark, folder) if r[0] == 1}[again[0][2]] == action


def test_late_articles_are_stored_by_replay(spark, tmp_path, rocksdb):
    here = {"entries": [1]}
    filters = [SavedFilter(7, "h", parse_rules('[{"field":"url","op":"contains","value":"H"}]'), "mark_read")]

    def job():
        made = _job(spark, tmp_path, filters=filters)
        every = made.articles
        twice = lambda s: every(s).union(every(s).withColumn("content_text", F.concat(F.lit("zz"), "content_text")))
        made.articles = lambda s: twice(s).where(F.col("entry_id").isin(here["entries"]))
        return made

    spark.createDataFrame(FIRST, POLL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job().start(once=True).awaitTermination()
    read = lambda t: spark.read.parquet(str(tmp_path / "out" / t))
    keys = lambda: sorted((r.entry_id, r.version, r.content_text) for r in read("snapshots").collect())
    assert keys() == [(1, 1, "text x"), (1, 2, "text y")]
    job().replay(spark)
    assert len(keys()) == 2
    here["entries"] = [1, 3]
    spark.createDataFrame(SECOND, POLL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job().start(once=True).awaitTermination()
    job().replay(spark)
    assert (3, 1, "text k") in keys() and not [k for k in keys() if k[0] in (2, 4)]
    here["entries"] = [1, 2, 3, 4]
    for _ in range(3):
        job().replay(spark)
    assert keys() == [(1, 1, "text x"), (1, 2, "text y"), (1, 3, "text w"), (2, 1, "text z"), (3, 1, "text k"), (4, 1, "text m")]
    assert sorted(r.id for r in read("actions").collect()) == [1, 2, 3, 4]


def test_enrichment_asks_once_and_keeps_failures_apart(spark, tmp_path):
    from articleflow.streaming.enrichment import EnrichJob

    calls = tmp_path / "calls"
    calls.mkdir()
    schema = "entry_id bigint, version int, content_hash string, content_text string"

    def fn(texts):
        import uuid

        if len(texts) > 1:
            raise ValueError("one at a time")
        (calls / f"{texts[0]}-{uuid.uuid4().hex}").touch()
        if texts[0].startswith("bad"):
            raise ValueError("bad text")
        return [texts[0].upper()]

    asked = lambda: sorted(p.name.rsplit("-", 1)[0] for p in calls.iterdir())

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        job = EnrichJob(stream, fn, F.col("content_text"), str(tmp_path / "out"), str(tmp_path / "cp"))
        job.start().awaitTermination()
        return job

    job = run([(1, 1, "h1", "one"), (2, 1, "h1", "one"), (3, 1, "h2", "bad2"), (4, 1, None, "no hash"), (5, 1, "h5", None)])
    assert asked() == ["bad2", "one"]
    job = run([(1, 2, "h3", "three"), (6, 1, "h1", "one"), (6, 2, "h2", "bad2")])
    assert asked() == ["bad2", "one", "three"]
    # A batch that is repeated asks nobody.
    job._process(spark.createDataFrame([("h1", "one"), ("h2", "bad2")], "content_hash string, prompt string"), 0)
    assert len(asked()) == 3
    for _ in range(4):
        job.retry(spark)
    assert asked().count("bad2") == 3
    table = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3"), (4, "h9"), (5, None)], "entry_id bigint, content_hash string")
    got = {r.entry_id: (r.value, r.attempts, r.error) for r in job.enriched(table).collect()}
    none = (None, None, None)
    assert got == {1: ("ONE", None, None), 2: (None, 3, "ValueError: bad text"), 3: ("THREE", None, None), 4: none, 5: none}


class _Store:
    """The state of one entry as a dictionary; ``calls`` are the round trips a state store would make."""

    def __init__(self):
        self.kept, self.calls = {}, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def exists(self):
        return "latest" in self.kept

    def get(self):
        return self.kept["latest"]

    def update(self, value):
        self.calls.append("update")
        self.kept["latest"] = value

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.kept

    def getValue(self, key):
        return self.kept[key]

    def updateValue(self, key, value):
        self.calls.append("put")
        self.kept[key] = value


def test_a_batch_makes_one_state_call_per_new_content():
    store, state = _Store(), SnapshotState()
    state.init(store)

    def actions(*polls):
        store.calls.clear()
        rows = [Row(feed_id=1, polled_at=T0 + timedelta(minutes=m), source_hash=s, fetched=True, content_hash=c, force=False) for m, s, c in polls]
        return [(r.action, r.version) for r in state.handleInputRows((1,), iter(reversed(rows)), None)]

    new = [("insert_new", 1), ("insert_version", 2), ("revert_touch", 2), ("insert_version", 3), ("skip", 3)]
    assert actions((0, "a", "x"), (1, "b", "y"), (2, "c", "x"), (3, "d", "z"), (4, "d", "z")) == new
    assert sorted(store.calls) == ["put", "put", "put", "update"]
    assert actions((5, "e", "x"), (6, "f", "w"), (7, "g", "w")) == [("revert_touch", 3), ("insert_version", 4), ("unchanged_touch", 4)]
    assert sorted(store.calls) == ["contains", "contains", "put", "update"]
    assert actions((8, "g", "w")) == [("skip", 4)] and store.calls == []


def test_large_ids_beside_nulls_stay_whole(spark, tmp_path, rocksdb):
    big = 2**53
    rows = [(entry, feed, *poll(1, 0, "a", "x")[2:]) for entry, feed in ((big, big), (big + 1, big + 1), (big + 2, None), (None, big + 3))]
    _run(spark, tmp_path, rows)
    got = spark.read.parquet(str(tmp_path / "out" / "decisions")).select("entry_id", "feed_id", "action", "version").collect()
    assert {tuple(r) for r in got} == {(r[0], r[1], "insert_new", 1) for r in rows}
