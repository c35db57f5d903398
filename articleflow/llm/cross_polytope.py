"""Approximate nearest neighbours: cross-polytope hashing with multiprobe tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from articleflow.llm.common import map_slices, shared
from articleflow.llm.vectors import matrix, numbers, unit, usable
from articleflow.operators.sizing import attach

# Inner products that a task holds at once: queries of a block times its rows.
PRODUCTS = 1 << 22
# Bytes of vectors that are turned at once; the products of larger slices leave the processor's cache.
TURNED_BYTES = 1 << 18


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` pseudo-rotations, each followed by the nearest signed axis; a query looks at its
    ``probes`` nearest axes in each table. ``block``: rows of one cell compared at once."""

    neighbours: int = 20
    tables: int = 8
    probes: int = 16
    block: int = 8192
    queries_block: int = 4096
    seed: int = 5


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    count, length = rows.shape
    half = 1
    while half < length:
        pair = rows.reshape(count, length // (2 * half), 2, half)
        rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2)
        rows = rows.reshape(count, length)
        half *= 2
    return rows


def axes(rows: np.ndarray, options: CrossPolytope, table: int) -> np.ndarray:
    """Products of every rotated row with all signed axes, as (rows, 2 * padded length)."""
    length = padded(rows.shape[1])
    turned = np.zeros((len(rows), length))
    turned[:, : rows.shape[1]] = rows
    rng = np.random.default_rng((options.seed, table))
    for _ in range(3):
        turned = hadamard(turned * rng.choice([-1.0, 1.0], length)) / np.sqrt(length)
    return np.concatenate([turned, -turned], axis=1)


def padded(length: int) -> int:
    """The power of two that vectors of a length are filled up to."""
    return 1 << max(0, length - 1).bit_length()


def nearest_axes(vectors: np.ndarray, probes: int, options: CrossPolytope) -> np.ndarray:
    """The ``probes`` nearest axes of every vector, per table, numbered over all tables."""
    found = []
    for t in range(options.tables):
        products = axes(vectors, options, t)
        wide = products.shape[1]
        if probes == 1:
            near = products.argmax(axis=1)[:, None]
        else:
            near = np.argpartition(-products, min(probes, wide) - 1, axis=1)[:, :probes]
        found.append(t * wide + near)
    return np.concatenate(found, axis=1)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions by the keys of the grouping that follows, which then needs no shuffle of
    its own. Spark would merge partitions of few bytes, but these bytes take much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_cells(rows: DataFrame, options: CrossPolytope) -> DataFrame:
    """``rows`` (``vector``, ``query``) with the ``cells`` a vector lies in, one per table, and those a
    query looks at, its ``probes``. Every vector is turned once, before it is copied to its blocks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = []
        lengths = pc.list_value_length(batch["vector"])
        for length in pc.unique(lengths).to_pylist():
            part = batch.filter(pc.equal(lengths, length))
            vectors = unit(matrix(part["vector"], length))
            asks = part["query"].to_numpy(zero_copy_only=False)
            cells = nearest_axes(vectors, 1, options)
            probes = nearest_axes(vectors[asks], options.probes, options)
            part = part.append_column("cells", lists(cells, np.ones(len(vectors), bool)))
            done.append(part.append_column("probes", lists(probes, asks)))
        return pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    kinds = [f"{name} {kind}" for name, kind in rows.dtypes]
    return map_slices(rows, run, ", ".join([*kinds, "cells array<int>", "probes array<int>"]), "vector", TURNED_BYTES)


def lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists, one for each place that is present; the other places are empty."""
    ends = np.cumsum(np.where(present, values.shape[1], 0))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.ravel(), pa.int32()))


def meets(cells: np.ndarray, probes: np.ndarray, axes_in_all: int) -> np.ndarray:
    """Whether a query probes one of a row's cells, as (queries, rows)."""
    probed = np.zeros((axes_in_all, len(probes)), bool)
    probed[probes, np.arange(len(probes))[:, None]] = True
    met = probed[cells[:, 0]]
    for t in range(1, cells.shape[1]):
        met |= probed[cells[:, t]]
    return np.ascontiguousarray(met.T)


def may_be_best(queries: np.ndarray, rows: np.ndarray, met: np.ndarray, k: int) -> np.ndarray:
    """Which met rows may be among the ``k`` best of each query, as (queries, rows).

    A matrix product sums in an order of its own, so its scores tell only what is certainly not among
    them: rows below the ``k``-th by more than both ways of summing can differ.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        products = queries @ rows.T
        if rows.shape[0] <= k or not np.isfinite(products).all():
            return met
        least = np.partition(np.where(met, products, -np.inf), -k, axis=1)[:, -k]
        longest = np.sqrt((rows * rows).sum(axis=1).max() * (queries * queries).sum(axis=1))
        least -= 4 * rows.shape[1] * (np.finfo(float).eps * longest + np.finfo(float).tiny)
        return met & ~(products < least[:, None])


def search(
    table: DataFrame,
    is_query: Column,
    options: CrossPolytope = CrossPolytope(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, the neighbour's id and ``score`` (inner product) for every query row.

    Every row but the query's own is a candidate; ties go to the smaller id. Vectors that are null,
    empty, zero or not finite, and rows of a null id, take no part. An inner product needs vectors of
    one length, so those of each length are searched apart. Repeated rows of an id are one vector (of
    unequal ones, the smallest).

    The hash of a vector is a direction, so candidates are collected by angle and ranked by inner
    product. A query that its probes give fewer candidates than asked for goes against all rows, in
    blocks. Every candidate block passes on at most ``neighbours`` rows per query.
    """
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(
        F.col(id_col).alias("id"), numbers(table, vector_col).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = dealt(rows, "id").groupBy("id").agg(F.min("vector").alias("vector"), F.max("query").alias("query"))
    rows = shared(with_cells(rows.withColumn("length", F.size("vector")), options))
    # One row per length of vectors.
    sizes = rows.groupBy("length").agg(
        F.count("*").alias("total"),
        F.ceil(F.count("*") / options.block).cast("int").alias("row_blocks"),
        F.ceil(F.count_if("query") / options.queries_block).cast("int").alias("query_blocks"),
    )
    rows = attach(rows, shared(sizes), "length").where("query_blocks > 0")
    k = options.neighbours

    # Queries and rows are cut into blocks; a row meets a query only where a probe names its cell.
    asked = rows.where("query")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    right = rows.select(
        "id", "vector", F.lit(False).alias("asks"), "cells", "length",
        of("row_blocks", 9).alias("r"), blocks("query_blocks").alias("q"),
    )

    def with_rows(queries: DataFrame) -> DataFrame:
        left = queries.select(
            "id", "vector", F.lit(True).alias("asks"), F.col("probes").alias("cells"), "length",
            blocks("row_blocks").alias("r"), of("query_blocks", 3).alias("q"),
        )
        return dealt(left.unionByName(right), "length", "q", "r").groupBy("length", "q", "r")

    scored = f"query_id {kind}, id {kind}, score double"

    def rerank(hashed: bool):
        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(batches).combine_chunks()
            length = key[0].as_py()
            asks = part["asks"].to_numpy(zero_copy_only=False)
            ids, vectors = part["id"].combine_chunks(), matrix(part["vector"], length)
            mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(mine) or not len(theirs):
                return
            order = ids.to_numpy(zero_copy_only=False)
            theirs = theirs[np.argsort(order[theirs], kind="stable")]
            held = vectors[theirs]
            if hashed:
                cells, probes = (
                    part["cells"].take(pa.array(x)).combine_chunks().flatten().to_numpy().reshape(len(x), -1)
                    for x in (theirs, mine)
                )
            out_q, out_r, out_s = [], [], []
            step = max(1, PRODUCTS // len(theirs))
            for start in range(0, len(mine), step):
                some = mine[start : start + step]
                met = np.ones((len(some), len(theirs)), bool)
                if hashed:
                    met = meets(cells, probes[start : start + step], options.tables * 2 * padded(length))
                # One more than asked for: the query may meet itself.
                near = may_be_best(vectors[some], held, met, k + 1)
                for n, q in enumerate(some):
                    found = theirs[np.flatnonzero(near[n])]
                    found = found[order[found] != order[q]]
                    scores = (vectors[found] * vectors[q]).sum(axis=1)
                    best = np.argsort(-scores, kind="stable")[:k]
                    out_q.append(np.full(len(best), q))
                    out_r.append(found[best])
                    out_s.append(scores[best])
            take = lambda x: ids.take(pa.array(np.concatenate(x), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [take(out_q), take(out_r), pa.array(np.concatenate(out_s))],
                names=["query_id", "id", "score"],
            )

        return run

    found = shared(with_rows(asked).applyInArrow(rerank(True), scored))
    enough = found.groupBy(F.col("query_id").alias("id")).count()
    short = asked.join(enough, "id", "left").where(
        F.coalesce("count", F.lit(0)) < F.least(F.lit(k), F.col("total") - 1)
    )
    short = shared(short.select("id", "vector", "probes", "length", "row_blocks", "query_blocks"))
    if not short.isEmpty():
        again = with_rows(short).applyInArrow(rerank(False), scored)
        ids = short.select(F.col("id").alias("query_id"))
        found = found.join(ids, "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")

