"""Near-duplicate documents by weighted Jaccard similarity of word shingles (BagMinHash).

Every shingle owns Poisson processes over its weight axis, one per dyadic interval (0,1], (1,2],
(2,4] and so on. A point has a time, a register and a weight level; a document that holds the
shingle w times sees the points at levels up to w. Each register keeps its earliest point. Two
documents agree in a register with probability equal to their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import WORD_SLICE_BYTES, map_slices, shared
from articleflow.llm.components import components
from articleflow.llm.wordhash import mix, shingles, split_words, weighted

# Points drawn at once where few lines are left, and of one line at most.
POINTS = 1 << 14
AHEAD = 256


@dataclass(frozen=True)
class NearDuplicates:
    """``bands`` bands of ``rows`` registers; a pair of similarity s shares a band with probability
    1 - (1 - s^rows)^bands: 1 - 2e-5 at the threshold with the values given, 0.43 at 0.5. ``tile``:
    documents, and ``shingles``: shingles of a crowded bucket that are compared in one task, about."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 36
    rows: int = 6
    tile: int = 1024
    shingles: int = 1_000_000


def signatures(
    hashes: np.ndarray, rows: np.ndarray, times: np.ndarray, count: int, registers: int
) -> np.ndarray:
    """Register values of each row, as (count, registers); rows without shingles keep zeros."""
    total = np.bincount(rows, weights=times, minlength=count)
    limit = np.zeros(count)
    held = total > 0
    limit[held] = registers * (math.log(registers) + 2) / total[held]
    # One line per shingle and interval below its weight: (0,1], then (2^(j-1), 2^j].
    line, low, length = [np.arange(len(hashes))], [np.zeros(len(hashes))], [np.ones(len(hashes))]
    level = 1
    while (more := np.flatnonzero(times > level)).size:
        line.append(more)
        low.append(np.full(len(more), float(level)))
        length.append(np.full(len(more), float(level)))
        level *= 2
    line, low, length = map(np.concatenate, (line, low, length))
    seed = mix(hashes[line], 3) ^ mix(low.astype(np.uint64), 5)
    earliest = np.full(count * registers, np.inf)
    value = np.zeros(count * registers, np.uint64)
    # Of each line also the time of its last point and the number of its next one.
    lines = [seed, rows[line], times[line], low, length, np.zeros(len(line)), np.zeros(len(line), np.int64)]
    while True:
        lines = _arrivals(lines, limit, registers, earliest, value)
        missing = np.isinf(earliest.reshape(count, registers)).any(axis=1) & held
        if not missing.any():
            return value.reshape(count, registers)
        # A few rows still miss a register: go on in time, for them alone and from where they were.
        lines = [x[missing[lines[1]]] for x in lines]
        limit[missing] *= 1.5


def _arrivals(
    lines: list[np.ndarray], limit: np.ndarray, registers: int, earliest: np.ndarray, value: np.ndarray
) -> list[np.ndarray]:
    """Give the points of all lines up to their row's limit to the registers; the lines as they are then.

    A line has few points in a long text and thousands in a text of a few words. So the fewer lines
    are left, the more points of each are drawn at once.
    """
    done = [[x[:0] for x in lines]]
    while len(lines[0]):
        seed, row, weight, low, length, time, step = lines
        ahead = min(max(1, POINTS // len(seed)), AHEAD)
        # One line per column.
        drawn = _points(seed, step + np.arange(ahead)[:, None])
        time = np.cumsum(np.concatenate([time[None], -np.log(_unit(drawn)) / length]), axis=0)
        due = time[1:] <= limit[row]
        taken = np.count_nonzero(due, axis=0)
        of, point, at_time = np.nonzero(due)[1], drawn[due], time[1:][due]
        seen = low[of] + np.floor(_unit(mix(point, 11)) * length[of]) < weight[of]
        of, point, at_time = of[seen], point[seen], at_time[seen]
        at = row[of] * registers + (mix(point, 7) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, at_time)
        won = at_time == earliest[at]
        value[at[won]] = point[won]
        now = [*lines[:5], time[taken, np.arange(len(seed))], step + taken]
        goes_on = taken == ahead
        done.append([x[~goes_on] for x in now])
        lines = [x[goes_on] for x in now]
    return [np.concatenate(parts) for parts in zip(*done, strict=True)]


def _points(seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    return mix(seed + np.asarray(step).astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 13)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def sketch(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """``doc_id``, ``weight`` (shingles), ``node`` (the multiset's fingerprint), ``keys`` of its bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    registers = options.bands * options.rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = batch.num_rows
        hashes, rows, times = weighted(*shingles(split_words(batch.column("text")), options.words))
        weight = np.bincount(rows, weights=times, minlength=count).astype(np.int64)
        nodes = _fingerprints(hashes, rows, times, count)
        values = signatures(hashes, rows, times, count, registers)
        keys = np.zeros((count, options.bands), np.uint64)
        for j in range(options.rows):
            keys = mix(keys ^ values[:, j :: options.rows], 23)
        keys = mix(keys + np.arange(options.bands, dtype=np.uint64), 29).view(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(count + 1) * options.bands, pa.int32()), pa.array(keys.ravel())
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(weight), nodes, lists], names=["doc_id", "weight", "node", "keys"]
        )

    schema = f"doc_id {kind}, weight long, node binary, keys array<long>"
    return map_slices(docs.select("doc_id", "text"), run, schema, size=WORD_SLICE_BYTES)


def _fingerprints(hashes: np.ndarray, rows: np.ndarray, times: np.ndarray, count: int) -> pa.Array:
    """128 bits of every row's multiset of shingles."""
    sums = np.zeros((count, 2), np.uint64)
    for k, salt in enumerate((17, 19)):
        np.add.at(sums[:, k], rows, mix(hashes, salt) * times.astype(np.uint64))
    return pa.array([v.tobytes() for v in sums], pa.binary())


def bags(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """``node``, ``hashes`` (ascending), ``times`` and ``weight`` of the shingles of every row with words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = batch.num_rows
        hashes, rows, times = weighted(*shingles(split_words(batch.column("text")), options.words))
        weight = np.bincount(rows, weights=times, minlength=count).astype(np.int64)
        at = pa.array(np.searchsorted(rows, np.arange(count + 1)), pa.int32())
        # Signed numbers in the order of the unsigned ones.
        signed = (hashes ^ np.uint64(1 << 63)).view(np.int64)
        arrays = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (signed, times.astype(np.int32))]
        table = [_fingerprints(hashes, rows, times, count), *arrays, pa.array(weight)]
        return pa.RecordBatch.from_arrays(table, names=["node", "hashes", "times", "weight"])

    return map_slices(docs.select("text"), run, "node binary, hashes array<long>, times array<int>, weight long", size=WORD_SLICE_BYTES)


def near_duplicates(
    docs: DataFrame,
    options: NearDuplicates = NearDuplicates(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (smallest id of its class), ``kept``.

    A class is all texts that links of at least the threshold connect. Texts without words (null,
    empty, blank) stand alone; texts of fewer words than a shingle are one shingle. Rows are told apart
    by their text, so rows of one id may be in several classes; rows of a null id take the class of an
    equal text, else null.

    Equal multisets fold into one node first. In every bucket of a band all nodes are compared with the
    bucket's first one: work that grows with the bucket. Only where a bucket's nodes are then still in
    several components, those outside its largest component meet all others, in tiles of bounded size that
    hold the shingles themselves; a tile passes on one link for any two components. So no candidate pair
    between components stays untested, and pairs inside a component, which can change nothing, are never made.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = shared(sketch(texts, options))
    own = sketches.select("doc_id", "weight", "node")
    nodes = sketches.where("weight > 0 and doc_id is not null").groupBy("node")
    nodes = shared(nodes.agg(F.min("doc_id").alias("low"), F.max("weight").alias("weight"), F.first("keys").alias("keys")))
    rows = nodes.select("node", "weight", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    crowded = sizes.where("first < last").select("key", "first")
    members = shared(rows.join(crowded, "key"))
    needed = shared(members.select("node").distinct().join(nodes.select("node", "low"), "node"))
    candidates = texts.join(needed.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = bags(candidates, options).join(needed.select("node"), "node", "left_semi")
    held = shared(held.dropDuplicates(["node"]))
    pairs = members.where("first < node").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    links = shared(_linked(pairs, held, options))
    label = components(links)
    across = shared(_across(members, label, held, options))
    if not across.isEmpty():
        label = components(links.union(across))

    placed = nodes.select("node", "low").join(label.withColumnRenamed("id", "node"), "node", "left")
    placed = shared(placed.select("node", "low", F.coalesce("component", "node").alias("component")))
    least = placed.groupBy("component").agg(F.min("low").alias("class_id"))
    classes = placed.select("node", "component").join(least, "component").select("node", "class_id")
    result = own.join(classes, "node", "left")
    class_id = F.when(F.col("weight") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return result.select(
        F.col("doc_id").alias(id_col),
        class_id.alias("class_id"),
        F.coalesce(class_id == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def _linked(pairs: DataFrame, held: DataFrame, options: NearDuplicates) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes that reach the threshold."""
    rows = pairs
    for side in ("a", "b"):
        named = held.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("hashes", "times", "weight")])
        rows = rows.join(named, side)
        if side == "b":
            rows = rows.where(F.least("weight_a", "weight_b") >= options.threshold * F.greatest("weight_a", "weight_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for k in range(batch.num_rows):
            (ha, ta), (hb, tb) = ([batch.column(f"{c}_{s}")[k].values.to_numpy() for c in ("hashes", "times")] for s in "ab")
            _, left, right = np.intersect1d(ha, hb, True, return_indices=True)
            common = int(np.minimum(ta[left], tb[right]).sum())
            good.append(common / (int(ta.sum()) + int(tb.sum()) - common) >= options.threshold)
        at = pa.array(np.flatnonzero(good))
        return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in "ab"], names=["a", "b"])

    return map_slices(rows.select("a", "b", "hashes_a", "times_a", "hashes_b", "times_b"), run, "a binary, b binary", "hashes_a")


def _across(members: DataFrame, label: DataFrame, held: DataFrame, options: NearDuplicates) -> DataFrame:
    """Links between nodes of a bucket that ``label`` leaves in different components."""
    placed = members.join(label.withColumnRenamed("id", "node"), "node", "left")
    placed = shared(placed.select("key", "node", "weight", F.coalesce("component", "node").alias("component")))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *marks)
    mixed = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"),
        F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("w").alias("w"),
        F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"),
    ).where("parts > 1")
    # Buckets of the same nodes, which near copies share in many bands, are compared once.
    once = mixed.groupBy("n", "m1", "m2").agg(F.min_by(F.struct("key", "main", "most", "w"), "key").alias("b"))
    slices = lambda n, w: F.greatest(F.ceil(n / options.tile), F.ceil(w / options.shingles)).cast("int")
    share = F.col("b.w") * (F.col("n") - F.col("b.most")) / F.col("n")
    once = once.select(
        "b.key", "b.main", slices(F.col("n"), F.col("b.w")).alias("right"), slices(F.col("n") - F.col("b.most"), share).alias("left")
    )
    rows = shared(placed.join(once, "key"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    resident = rows.select("key", "node", "component", every("left").alias("i"), own("right", 3).alias("j"), F.lit(False).alias("visits"))
    visitor = rows.where("component <> main").withColumn("i", own("left", 4)).select(
        "key", "node", "component", "i", every("right").alias("j"), F.lit(True).alias("visits")
    )
    tiles = resident.unionByName(visitor).join(held.select("node", "hashes", "times"), "node")

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches).combine_chunks()
        visits = part["visits"].to_numpy(zero_copy_only=False)
        mine, theirs = np.flatnonzero(visits), np.flatnonzero(~visits)
        if not len(mine) or not len(theirs):
            return
        nodes, names = part["node"].to_pylist(), part["component"].to_pylist()
        number = {name: k for k, name in enumerate(dict.fromkeys(names))}
        component = np.array([number[name] for name in names])
        hashes, times = part["hashes"].combine_chunks(), part["times"].combine_chunks()
        weight = np.array([times[k].values.to_numpy().sum() for k in range(part.num_rows)], np.int64)
        chosen = hashes.take(pa.array(theirs))
        postings, amounts = chosen.flatten().to_numpy(), times.take(pa.array(theirs)).flatten().to_numpy()
        owner = np.repeat(np.arange(len(theirs)), chosen.value_lengths().to_numpy())
        order = np.argsort(postings, kind="stable")
        postings, amounts, owner = postings[order], amounts[order], owner[order]
        joined = np.arange(len(number))
        found: list[tuple[bytes, bytes]] = []
        for v in mine:
            asked, own_times = hashes[v].values.to_numpy(), times[v].values.to_numpy()
            low, high = (np.searchsorted(postings, asked, side) for side in ("left", "right"))
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            both = np.minimum(np.repeat(own_times, count), amounts[at])
            common = np.bincount(owner[at], weights=both, minlength=len(theirs))
            total = weight[v] + weight[theirs] - common
            near = np.flatnonzero((common / total >= options.threshold) & (joined[component[theirs]] != joined[component[v]]))
            for k in near:
                a, b = joined[component[v]], joined[component[theirs[k]]]
                if a != b:
                    joined[joined == b] = a
                    found.append((nodes[v], nodes[theirs[k]]))
        if found:
            arrays = [pa.array(c, pa.binary()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return tiles.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")
