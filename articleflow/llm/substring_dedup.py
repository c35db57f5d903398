"""Substring dedup: passages that recur are found by hashes, confirmed, and located by automata.

Every run of ``words`` words has a minimizer: the shorter run inside it with the smallest hash.
Equal runs have equal minimizers, so only minimizers are shuffled to learn what may recur. Runs
around recurring minimizers are then counted by their own hash: those that also start in a document
with a larger id are the passages to remove. They are compiled into Aho-Corasick automata, one per
shard, and the documents that may hold them are streamed through, which compares real words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import WORD_SLICE_BYTES, discard, map_slices, shared, slices
from articleflow.llm.wordhash import Words, runs, split_words
from articleflow.operators.sizing import attach


@dataclass(frozen=True)
class SubstringDedup:
    """``minimizer``: words of the shorter run. ``shard``: recurring runs an automaton holds, about;
    ``stream``: characters one copy of it reads, about."""

    words: int = 13
    minimizer: int = 6
    shard: int = 20_000
    stream: int = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8: runs of bytes other than space and the control characters 9 to 13, as ``bytes.split`` cuts."""
    return (text or b"").split()


def _windows(words: Words, options: SubstringDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, minimizer's hash) of every run of the batch."""
    hashes, at = runs(words, options.words)
    small, small_at = runs(words, options.minimizer)
    # Places of short runs are ascending and gapless inside a row.
    place = np.searchsorted(small_at, at)
    least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for j in range(options.words - options.minimizer + 1 if len(at) else 0):
        least = np.minimum(least, small[place + j])
    return hashes, at, least


def _lists(rows: np.ndarray, values: np.ndarray, count: int) -> pa.ListArray:
    """Values, ordered by row, as one list per row."""
    offsets = np.searchsorted(rows, np.arange(count + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), ordered."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _keyed(texts: DataFrame) -> DataFrame:
    """``texts`` with ``v``, which tells the texts of one id apart: 0 where an id has one text only."""
    prints = F.xxhash64("text")
    known = texts.where("doc_id is not null and text is not null")
    several = known.groupBy("doc_id").agg(F.min(prints).alias("low"), F.max(prints).alias("high"))
    several = shared(several.where("low < high").select("doc_id", F.lit(True).alias("several")))
    if several.isEmpty():
        return texts.withColumn("v", F.lit(0).cast("long"))
    marked = attach(texts, several, "doc_id")
    return marked.withColumn("v", F.when(F.col("several"), prints).otherwise(F.lit(0))).drop("several")


def passages(docs: DataFrame, options: SubstringDedup) -> DataFrame:
    """``doc_id``, ``v``, ``shard``, ``windows``, ``streams``: for every text, the shards it has to do
    with, the runs it gives to their automata (those that start in no earlier document but in a later
    one), and whether it must be streamed through them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def minimizers(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"))
        _, at, least = _windows(words, options)
        rows, least = _per_row(words.rows[at], least)
        ids, v = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "v"))
        return pa.RecordBatch.from_arrays([ids, v, pa.array(least.view(np.int64))], names=["doc_id", "v", "least"])

    keyed = f"doc_id {kind}, v long"
    small = shared(map_slices(docs, minimizers, f"{keyed}, least long", size=WORD_SLICE_BYTES))
    spread = small.groupBy("least").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    often = shared(spread.where("low < high").select("least"))
    held = small.join(often, "least").groupBy("doc_id", "v").agg(F.collect_set("least").alias("marks"))
    held = shared(held)
    discard(small)

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"))
        hashes, at, least = _windows(words, options)
        row = words.rows[at]
        keep = np.zeros(len(at), bool)
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for n, marks in enumerate(batch.column("marks")):
            part = slice(first[n], first[n + 1])
            keep[part] = np.isin(least[part].view(np.int64), marks.values.to_numpy())
        rows, hashes = _per_row(row[keep], hashes[keep])
        ids, v = (batch.column(c).take(pa.array(rows)) for c in ("doc_id", "v"))
        return pa.RecordBatch.from_arrays([ids, v, pa.array(hashes.view(np.int64))], names=["doc_id", "v", "window"])

    texts = docs.join(held, ["doc_id", "v"])
    windows = shared(map_slices(texts, marked, f"{keyed}, window long", size=WORD_SLICE_BYTES))
    firsts = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = shared(firsts.where("first < last").select("window", "first"))
    shards = max(1, -(-firsts.count() // options.shard))
    # A source's passages stay together, so a copy meets one shard; only a source above a shard's size is cut.
    large = firsts.groupBy("first").count().where(F.col("count") > options.shard)
    large = shared(large.select("first", F.ceil(F.col("count") / options.shard).alias("pieces")))
    placed = attach(firsts, large, "first")
    piece = F.pmod(F.xxhash64("window"), F.coalesce("pieces", F.lit(1)))
    placed = placed.select("window", "first", F.pmod(F.xxhash64("first", piece), F.lit(shards)).alias("shard"))
    met = windows.join(placed, "window").groupBy("doc_id", "v", "shard")
    met = met.agg(
        F.collect_set(F.when(F.col("first") == F.col("doc_id"), F.col("window"))).alias("windows"),
        F.bool_or(F.col("first") < F.col("doc_id")).alias("streams"),
    )
    met = shared(met)
    discard(windows)
    return met


def dedup(
    docs: DataFrame,
    options: SubstringDedup = SubstringDedup(),
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """Per row of ``docs``: a struct ``row`` of the columns ``carry`` (if any), the ``text`` as it was (with
    ``keep_text``), id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``kept_sha256``.

    A word goes if it lies in a run of ``words`` words that also starts in a document of a smaller id,
    judged on the input. A null or empty text has no words. Rows of one id are one document as to
    order, so none of them makes another lose words; rows of a null id lose none and cause no loss.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    texts = _keyed(docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    row_kind = texts.schema["row"].dataType.simpleString()
    known = texts.where("doc_id is not null and text is not null").select("doc_id", "v", "text")
    plan = passages(known, options).groupBy("doc_id", "v")
    plan = plan.agg(F.collect_list(F.struct("shard", "windows", "streams")).alias("plan"))
    streams = F.filter("plan", lambda p: p["streams"])
    joined = texts.join(plan, ["doc_id", "v"], "left").select(
        F.monotonically_increasing_id().alias("uid"), "row", "doc_id", "text",
        F.coalesce(F.transform(streams, lambda p: p["shard"]), F.array().cast("array<bigint>")).alias("to"),
        F.filter("plan", lambda p: F.size(p["windows"]) > 0).alias("gives"),
    )
    joined = shared(joined)
    size = options.words

    def stretches(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, bodies = [], batch.column("text").cast(pa.binary()).to_pylist()
        for k in range(batch.num_rows):
            words, first = words_of(bodies[k]), batch.column("doc_id")[k].as_py()
            hashes, at = runs(split_words(batch.column("text").slice(k, 1)), size)
            for given in batch.column("gives")[k].as_py():
                starts = at[np.isin(hashes.view(np.int64), np.array(given["windows"], np.int64))]
                cuts = np.flatnonzero(np.diff(starts) > 1) + 1
                lines = [b" ".join(words[part[0] : part[-1] + size]) for part in np.split(starts, cuts) if len(part)]
                out.append((given["shard"], first, b"\n".join(lines)))
        if not out:
            return None
        shards, firsts, lines = zip(*out, strict=True)
        arrays = [pa.array(shards, pa.int64()), pa.array(firsts, batch.schema.field("doc_id").type)]
        arrays.append(pa.array(lines, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "doc_id", "text"])

    sources = joined.where("size(gives) > 0").select("doc_id", "text", "gives")
    sources = map_slices(sources, stretches, f"shard long, doc_id {kind}, text string", size=WORD_SLICE_BYTES)
    streamed = joined.where("size(to) > 0").select("uid", "row", "doc_id", "text", F.posexplode("to").alias("place", "shard"))
    bulk = streamed.groupBy("shard").agg(F.sum(F.length("text")).alias("n"))
    salts = shared(bulk.select("shard", F.ceil((F.col("n") + 1) / options.stream).cast("int").alias("salts")))
    copies = sources.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    copies = copies.select(
        "shard", "salt", F.lit(False).alias("reads"), F.lit(None).cast("long").alias("uid"),
        F.lit(None).cast(row_kind).alias("row"), "doc_id", "text", F.lit(False).alias("home"),
    )
    readers = streamed.join(salts, "shard").select(
        "shard", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("reads"), "uid",
        F.when(F.col("place") == 0, F.col("row")).alias("row"), "doc_id", "text", (F.col("place") == 0).alias("home"),
    )
    # A shard's passages come first, then the documents, which pass one by one.
    lines = copies.unionByName(readers).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "reads")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, automaton, ready = None, {}, None, False
        seen: list[np.ndarray] = []
        for batch in (part for whole in batches for part in slices([whole], "text", WORD_SLICE_BYTES)):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "salt", "reads")), strict=True))
            turns = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for begin, end in zip(turns, [*turns[1:], len(keys)], strict=True):
                part, reads = batch.take(pa.array(np.arange(begin, end))), keys[begin][2]
                if keys[begin][:2] != at:
                    at, number, ready, seen = keys[begin][:2], {}, False, []
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                ids, bodies = part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()
                if not reads:
                    for own, body in zip(ids, bodies, strict=True):
                        for line in body.split(b"\n"):
                            codes = [number.setdefault(w, len(number) + 1) for w in line.split(b" ")]
                            for s in range(len(codes) - size + 1):
                                key = tuple(codes[s : s + size])
                                automaton.add_word(key, min(own, automaton.get(key, own)))
                    lines_ = pc.split_pattern(part.column("text"), "\n").flatten()
                    seen.append(np.unique(runs(split_words(lines_), size)[0]))
                    continue
                if not ready and number:
                    automaton.make_automaton()
                    seen, ready = [np.unique(np.concatenate(seen))], True
                # Only where a run has the hash of a passage's run are its words read through the automaton.
                words = split_words(part.column("text"))
                hashes, place = runs(words, size)
                place = place[np.isin(hashes, seen[0])] if number else place[:0]
                row = words.rows[place]
                edge = np.searchsorted(row, np.arange(len(ids) + 1))
                starts, ends = [], []
                for k, own in enumerate(ids):
                    spans: list[list[int]] = []
                    near = place[edge[k] : edge[k + 1]] - words.first[k]
                    listed = words_of(bodies[k]) if len(near) else []
                    for piece in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1) if len(near) else ():
                        first = int(piece[0])
                        codes = tuple(number.get(w, 0) for w in listed[first : int(piece[-1]) + size])
                        for last, source in automaton.iter(codes):
                            if source >= own:
                                continue
                            stop = first + last + 1
                            if spans and stop - size <= spans[-1][1]:
                                spans[-1][1] = stop
                            else:
                                spans.append([stop - size, stop])
                    starts.append([s for s, _ in spans])
                    ends.append([e for _, e in spans])
                home = pc.if_else(part.column("home"), part.column("text"), pa.scalar(None, part.column("text").type))
                places = pa.list_(pa.int32())
                arrays = [part.column("uid"), part.column("row"), part.column("doc_id"), home]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(starts, places), pa.array(ends, places)],
                    names=["uid", "row", "doc_id", "text", "starts", "ends"],
                )

    schema = f"uid long, row {row_kind}, doc_id {kind}, text string, starts array<int>, ends array<int>"
    found = lines.mapInArrow(locate, schema).groupBy("uid").agg(
        F.first("row", ignorenulls=True).alias("row"), F.first("doc_id").alias("doc_id"), F.first("text", ignorenulls=True).alias("text"),
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
    )
    none = F.lit(None).cast("array<int>")
    rest = joined.where("size(to) = 0").select("row", "doc_id", "text", none.alias("starts"), none.alias("ends"))
    whole = rest.unionByName(found.drop("uid"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, kept = [], [], []
        bodies = batch.column("text").cast(pa.binary()).to_pylist()
        for text, starts, ends in zip(bodies, *(batch.column(c).to_pylist() for c in ("starts", "ends")), strict=True):
            words = words_of(text)
            total.append(len(words))
            gone = np.zeros(len(words), bool)
            for s, e in zip(starts or (), ends or (), strict=True):
                gone[s:e] = True
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words))
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        arrays = [pa.array(v, pa.int64()) for v in (total, removed)]
        arrays += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())]
        names = ["n_words", "n_removed", "kept_text", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*map(batch.column, own), *arrays], names=own + names)

    own = [*(["row"] if carry else []), *(["text"] if keep_text else []), "doc_id"]
    kinds = {"row": row_kind, "text": "string", "doc_id": kind}
    schema = ", ".join(f"{c} {kinds[c]}" for c in own)
    schema += ", n_words long, n_removed long, kept_text string, kept_sha256 string"
    return map_slices(whole, cut, schema, size=WORD_SLICE_BYTES).withColumnRenamed("doc_id", id_col)
