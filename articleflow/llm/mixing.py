"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Each source gets a target number of words. Blocks of equal size are dealt to sources by the highest
quotients target / (2 seats + 1), then to the shards of each source by their sizes, so every shard
has a whole number of blocks to give. A shard lays its documents end to end in seeded order, cuts
that line into blocks and gives the blocks a seeded order picks, each at most ``repeats`` times.
Parties meet in a tree of bounded width, so no apportionment holds more than ``fan`` of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import shared
from articleflow.operators.sizing import fits

_WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixing:
    """``weights`` of the sources in code-point order, repeating. ``share``: words of the mix as a
    fraction of all words. ``repeats``: times a document may be taken. ``block``: words dealt at once.
    ``shard``: words (and documents) of a shard, about. ``fan``: parties of one apportionment."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: Fraction = Fraction(3, 2)
    repeats: int = 2
    block: int = 16
    shard: int = 1 << 16
    fan: int = 1024
    seed: int = 11


def apportion(votes: list[float], limits: list[int], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 seats + 1); a party at its limit gets no more, ties go to
    the earlier party. Seats beyond all limits stay empty."""
    live = [v if v > 0 and m > 0 else 0 for v, m in zip(votes, limits, strict=True)]
    seats = min(seats, sum(m for v, m in zip(live, limits, strict=True) if v))
    if seats <= 0:
        return [0] * len(votes)
    size, most = np.array(live, np.float64), np.array(limits, np.float64)

    def dealt(price: float) -> np.ndarray:
        return np.minimum(most, np.floor(size / price + 0.5))

    # A price at which at most the seats at hand are dealt; all quotients above it are taken.
    low, high = 0.0, 2 * size.max() * 2 + 1
    for _ in range(200):
        middle = low + (high - low) / 2
        if middle <= low or middle >= high:
            break
        if dealt(middle).sum() > seats:
            low = middle
        else:
            high = middle
    held = dealt(high * (1 + 1e-12)).astype(np.int64).tolist()
    waiting = [(-Fraction(v) / (2 * s + 1), k) for k, (v, s, m) in enumerate(zip(live, held, limits, strict=True)) if v and s < m]
    heapq.heapify(waiting)
    for _ in range(seats - sum(held)):
        _, k = heapq.heappop(waiting)
        held[k] += 1
        if held[k] < limits[k]:
            heapq.heappush(waiting, (-Fraction(live[k]) / (2 * held[k] + 1), k))
    return held


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with ``rank`` (from 0, by code point, null last), without one task for all of them."""
    order = [F.col("source").isNull(), F.col("source")]
    cores = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    sorted_ = sources.repartitionByRange(cores, *order).sortWithinPartitions(*order)
    # The upper bits number the partition, the lower ones the row in it.
    at = F.monotonically_increasing_id()
    placed = shared(sorted_.withColumn("part", F.shiftright(at, 33)).withColumn("row", at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(starts), "part").select("source", "source_size", (F.col("before") + F.col("row")).alias("rank"))


def targets(sources: DataFrame, options: Mixing = Mixing()) -> DataFrame:
    """``source``, ``source_size``, ``rank`` and ``target`` of every source.

    Shares by weight that exceed ``repeats`` times a source's size stop there, and the excess is
    shared again until none is above: the level (words per unit of weight) rises from round to round
    and each round is one sum over the sources.
    """
    rows = ranked(sources)
    weights = F.array(*[F.lit(w) for w in options.weights])
    weight = F.element_at(weights, (F.col("rank") % len(options.weights) + 1).cast("int"))
    rows = shared(rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * options.repeats))
    total = rows.agg(F.sum("source_size").alias("n")).first().n or 0
    wanted = min(options.share, Fraction(options.repeats)) * total
    level, full = Fraction(0), -1
    while True:
        # Compared in whole numbers: most * denominator < weight * numerator.
        over = _above(F.col("most"), F.col("weight"), level)
        part = rows.agg(
            F.count(F.when(over, 1)).alias("full"),
            F.sum(F.when(over, F.col("most")).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if part.full == full or not part.open:
            break
        full, level = part.full, (wanted - part.held) / part.open
    over = _above(F.col("most"), F.col("weight"), level)
    target = F.when(over, F.col("most").cast("double")).otherwise(
        F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    )
    return rows.select("source", "source_size", "rank", target.alias("target"))


def _above(most: Column, weight: Column, level: Fraction) -> Column:
    """Whether weight * level exceeds ``most``; all three are whole numbers or ratios of them."""
    wide = lambda x: F.lit(x).cast("decimal(19,0)")
    return weight.cast("decimal(19,0)") * wide(str(level.numerator)) > most.cast("decimal(19,0)") * wide(str(level.denominator))


def _dealt(parties: DataFrame, keys: list[str], position: str, most: int, options: Mixing) -> DataFrame:
    """``parties`` (``keys``, ``position`` within them, ``votes``, ``limit``, and ``seats`` of their
    whole group) with ``given``, their own seats, dealt level by level in a tree over the positions."""
    levels = 1
    while options.fan**levels <= most:
        levels += 1
    group = parties.select(*keys, "seats").distinct()
    given = group.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col(position) / F.lit(options.fan**level)).cast("long")
        children = parties.withColumn("node", node).groupBy(*keys, "node")
        children = children.agg(F.sum("votes").alias("votes"), F.sum("limit").alias("limit"))
        children = children.withColumn("parent", F.floor(F.col("node") / F.lit(options.fan)).cast("long"))
        above = given.select(*[F.col(k).alias(f"up_{k}") for k in keys], F.col("node").alias("up"), "seats")
        same = children.parent == above.up
        for k in keys:
            same &= children[k].eqNullSafe(above[f"up_{k}"])
        offered = children.join(above, same).select(*keys, "parent", "node", "votes", "limit", "seats")

        def share(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(batches).sort_by("node").combine_chunks()
            held = apportion(part["votes"].to_pylist(), part["limit"].to_pylist(), part["seats"][0].as_py())
            columns = [part[c].combine_chunks() for c in (*keys, "node")] + [pa.array(held, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "node", "seats"])

        kinds = ", ".join(f"{k} {offered.schema[k].dataType.simpleString()}" for k in keys)
        schema = f"{kinds}, node long, seats long" if keys else "node long, seats long"
        given = shared(offered.groupBy(*keys, "parent").applyInArrow(share, schema))
    return given.withColumnRenamed("node", position).withColumnRenamed("seats", "given")


def mix(
    docs: DataFrame,
    options: Mixing = Mixing(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (words; 0 for a null text), ``source_size``, ``target``
    (its source's words in the mix) and ``taken`` (words the mix takes of it, repeats counted).

    A document gives at most ``repeats`` times its size. What a source gives differs from its target by
    a few blocks: half a block of rounding, and the last block of a shard, which may be short. Null
    sources are a source of their own, the last. Rows of one id, source and size are counted together and
    cut into portions, so one id may hold any part of the table. The same table and seed give the same rows,
    however it is partitioned. Other columns of the table play no part.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.col(source_col).cast("string").alias("source"))
    folded = shared(rows.groupBy("id", "size", "source").agg(F.count("*").alias("times")))
    totals = folded.groupBy("source").agg(
        F.sum(F.col("size") * F.col("times")).alias("source_size"),
        F.sum((F.col("size") + 1) * F.col("times")).alias("bulk"),
    )
    totals = shared(totals)
    known = shared(targets(totals.select("source", "source_size"), options))
    last = known.agg(F.max("rank").alias("r")).first().r
    kind = folded.schema["id"].dataType.simpleString()
    if last is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, size long, source_size long, target double, taken long")
    whole = known.agg(F.round(F.sum("target") / options.block).cast("long").alias("n")).first().n
    parties = known.select(
        "rank", F.col("target").alias("votes"), F.lit(whole).alias("seats"),
        F.ceil(F.col("source_size") * options.repeats / options.block).cast("long").alias("limit"),
    )
    quotas = _dealt(parties, [], "rank", last, options)

    named = known.join(totals.select(F.col("source").alias("own"), "bulk"), F.col("source").eqNullSafe(F.col("own")))
    named = named.select(F.col("source").alias("own"), "rank", "source_size", "target", F.ceil(F.col("bulk") / options.shard).cast("int").alias("shards"))
    named = shared(named)
    placed = folded.join(F.broadcast(named) if fits(named) else named, F.col("source").eqNullSafe(F.col("own")))
    # A row's copies travel in portions of at most a shard's bulk.
    portion = F.greatest(F.lit(1), F.floor(F.lit(options.shard) / (F.col("size") + 1))).cast("long")
    placed = placed.withColumn("portion", portion)
    count = F.ceil(F.col("times") / F.col("portion")).cast("long")
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    copies = F.least(F.col("portion"), F.col("times") - F.col("k") * F.col("portion"))
    order = F.xxhash64("id", "size", "k", F.lit(options.seed))
    placed = shared(
        placed.select(
            "id", "size", "rank", "source_size", "target", copies.alias("copies"), F.col("k").alias("portion"),
            order.alias("order"), F.pmod(F.xxhash64(order, F.lit(1)), F.col("shards")).cast("long").alias("shard"),
        )
    )
    words = F.sum(F.col("size") * F.col("copies"))
    shards = placed.groupBy("rank", "shard").agg(words.alias("words"))
    blocks = F.ceil(F.col("words") / options.block).cast("long")
    shards = shards.select("rank", "shard", F.col("words").alias("votes"), (blocks * options.repeats).alias("limit"))
    shards = shards.join(quotas.withColumnRenamed("given", "seats"), "rank")
    most = named.agg(F.max("shards").alias("m")).first().m
    plan = _dealt(shared(shards), ["rank"], "shard", most - 1, options)
    block, repeats, seed = options.block, options.repeats, options.seed

    def choose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        part = part.sort_by([(c, "ascending") for c in ("order", "id", "size", "portion")]).combine_chunks()
        at = np.repeat(np.arange(part.num_rows), part["copies"].to_numpy())
        sizes = part["size"].to_numpy()[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        count = -(-int(ends[-1]) // block)
        seats = min(part["given"][0].as_py(), count * repeats)
        times = np.zeros(count, np.int64)
        if count:
            times += seats // count
            spare = np.random.default_rng([seed, *(abs(k.as_py()) for k in key)]).permutation(count)
            times[spare[: seats % count]] += 1
        # Words taken before a place of the line: whole blocks, then part of one.
        before = np.concatenate([[0], np.cumsum(times * block)])
        upto = before[ends // block] + (ends % block) * np.append(times, 0)[ends // block]
        columns = [part[c].combine_chunks().take(pa.array(at)) for c in ("id", "size", "source_size", "target")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.diff(upto))], names=["id", "size", "source_size", "target", "taken"]
        )

    schema = f"id {kind}, size long, source_size long, target double, taken long"
    given = placed.join(plan, ["rank", "shard"])
    taken = given.groupBy("rank", "shard").applyInArrow(choose, schema)
    return taken.withColumnRenamed("id", id_col)
