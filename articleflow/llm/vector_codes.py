"""Vector codes: k-means codebooks for the parts of a vector, sped up by adaptive distance bounds.

Every part of every vector keeps, from one assignment to the next, its entry, the ``b`` next closest
entries with a lower bound of the distance to each, and one bound for all entries further out. When
entries move, bounds shrink by the move. A part whose entry is nearer than its first bound keeps
it without a look at any other; else only the listed entries before the first bound that is
large enough are measured, in whole numbers; only if the outer bound gives way, all are. ``b``
follows how many were needed (Drake and Hamerly, 2012).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import shared, slices
from articleflow.llm.whitening import by_length, finite, integers, whole
from articleflow.operators.sizing import fits

_LONG = (1 << 63) - 1
# Bounds are stored as whole steps of 1/16, always rounded down; the top value stands for all above.
_STEPS, _TOP = 16, (1 << 16) - 1


@dataclass(frozen=True)
class VectorCodes:
    """``parts`` of a vector, ``entries`` of a codebook, ``rounds`` of updates. ``kept``: entries a part
    lists at first; later as many as all but ``rare`` of the vectors needed, ``least`` at least."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    kept: int = 16
    least: int = 8
    rare: float = 0.01


Codebooks = dict[int, list[np.ndarray]]


def edges(length: int, options: VectorCodes) -> list[int]:
    """Where the parts of a vector begin; parts differ by one entry at most if it doesn't divide."""
    return [length * p // options.parts for p in range(options.parts + 1)]


def _exact(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows and entries as they are if all squared distances fit a long, else as Python's integers."""
    most = max((np.abs(v.astype(np.float64)).max() for v in (x, *books) if v.size), default=0.0)
    if 4 * most * most * max(1, x.shape[1]) < _LONG / 2:
        return x, books
    return x.astype(object), [book.astype(object) for book in books]


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to all entries, as (rows, entries)."""
    out = np.zeros((len(x), len(book)), x.dtype)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - book[None, :, j]
        out += gap * gap
    return out


def _down(distance_squared: np.ndarray) -> np.ndarray:
    """Stored lower bounds: the square root in steps, rounded down below any rounding error."""
    root = np.sqrt(distance_squared.astype(np.float64)) * (1 - 1e-12) * _STEPS
    return np.minimum(np.floor(root), _TOP).astype(np.uint16)


def _nearest(x: np.ndarray, book: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries by distance and index, their stored bounds after the first, distance to the first)."""
    far = squares(x, book)
    order = np.argsort(far, axis=1, kind="stable")[:, : kept + 2]
    sorted_ = np.take_along_axis(far, order, 1)
    near = np.zeros((len(x), kept + 1), np.uint8)
    low = np.full((len(x), kept + 1), _TOP, np.uint16)
    near[:, : order.shape[1]] = order[:, : kept + 1]
    bounds = _down(sorted_[:, 1:])
    low[:, : bounds.shape[1]] = bounds
    return near, low, sorted_[:, 0]


def assign_anew(x: np.ndarray, books: list[np.ndarray], kept: int, options: VectorCodes):
    """(near, low, distance, needed) of every part, from all distances."""
    cut, count = edges(x.shape[1], options), len(x)
    x, books = _exact(x, books)
    near = np.zeros((count, options.parts, kept + 1), np.uint8)
    low = np.zeros((count, options.parts, kept + 1), np.uint16)
    far = np.zeros((count, options.parts), x.dtype)
    for p, book in enumerate(books):
        near[:, p], low[:, p], far[:, p] = _nearest(x[:, cut[p] : cut[p + 1]], book, kept)
    return near, low, far, np.full(count, kept + 1, np.int32)


def assign_again(
    x: np.ndarray, books: list[np.ndarray], moves: list[np.ndarray], near: np.ndarray, low: np.ndarray, kept: int,
    options: VectorCodes,
):
    """The same from the bounds before the entries moved; ``moves``: stored moves, rounded up.

    ``needed`` is the number of listed entries whose distance had to be known.
    """
    cut, count, held = edges(x.shape[1], options), len(x), near.shape[2] - 1
    x, books = _exact(x, books)
    new_near = np.zeros((count, options.parts, kept + 1), np.uint8)
    new_low = np.zeros((count, options.parts, kept + 1), np.uint16)
    far = np.zeros((count, options.parts), x.dtype)
    needed = np.zeros(count, np.int32)
    for p, book in enumerate(books):
        part, own = x[:, cut[p] : cut[p + 1]], near[:, p, 0]
        gap = part - book[own]
        mine = (gap * gap).sum(axis=1)
        # An upper bound of the distance to the own entry, in steps.
        upper = np.ceil(np.sqrt(mine.astype(np.float64)) * (1 + 1e-12) * _STEPS)
        shrunk = np.zeros((count, held + 1))
        shrunk[:, :held] = low[:, p, :held] - moves[p][near[:, p, 1:]].astype(np.float64)
        shrunk[:, held] = low[:, p, held] - float(moves[p].max())
        shrunk = np.maximum(shrunk, 0)
        # Entries stay listed in their old order, so each bound also holds for all behind it.
        ordered = np.minimum.accumulate(shrunk[:, ::-1], axis=1)[:, ::-1]
        if len(book) <= held + 1:
            # Every entry is listed: nothing lies further out.
            ordered = np.where(np.arange(held + 1) >= len(book) - 1, np.inf, ordered)
        stop = (upper[:, None] < ordered).argmax(axis=1)
        stop[~(upper[:, None] < ordered).any(axis=1)] = held + 1
        needed = np.maximum(needed, stop)
        kept_low = np.minimum(ordered, _TOP).astype(np.uint16)
        far[:, p] = mine
        # Certain: own entry first, the others as listed; an outer bound moves in when the list shrinks.
        width = min(held, kept)
        new_near[:, p, : width + 1] = near[:, p, : width + 1]
        new_low[:, p, : width] = kept_low[:, :width]
        new_low[:, p, width:] = kept_low[:, width, None]
        unsure = np.flatnonzero((stop > 0) & (stop <= held))
        for size in np.unique(stop[unsure]).tolist():
            rows = unsure[stop[unsure] == size]
            some = near[rows, p, : size + 1]
            gap = part[rows][:, None, :] - book[some]
            distance = (gap * gap).sum(axis=2)
            # By index first, then, keeping that order, by distance.
            by = np.argsort(some, axis=1, kind="stable")
            by = np.take_along_axis(by, np.argsort(np.take_along_axis(distance, by, 1), axis=1, kind="stable"), 1)
            distance = np.take_along_axis(distance, by, 1)
            far[rows, p] = distance[:, 0]
            within = min(size, kept)
            new_near[rows, p, : within + 1] = np.take_along_axis(some, by, 1)[:, : within + 1]
            fresh = np.minimum(_down(distance[:, 1:]), kept_low[rows, size, None])
            new_low[rows, p, :within] = fresh[:, :within]
            if size > kept:
                new_low[rows, p, kept] = fresh[:, kept]
        lost = np.flatnonzero(stop > held)
        if len(lost):
            new_near[lost, p], new_low[lost, p], far[lost, p] = _nearest(part[lost], book, kept)
    return new_near, new_low, far, needed


def _state(batch: pa.RecordBatch, near: np.ndarray, low: np.ndarray, far: np.ndarray, needed: np.ndarray) -> pa.RecordBatch:
    total = [v if v <= _LONG else None for v in far.sum(axis=1).tolist()]
    arrays = [batch.column(c) for c in ("id", "label", "x")]
    arrays += [pa.array([v.tobytes() for v in a], pa.binary()) for a in (near[:, :, 0], near, low)]
    arrays += [pa.array(needed, pa.int32()), pa.array(total, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "label", "x", "code", "near", "low", "needed", "error"])


def first_books(rows: DataFrame, options: VectorCodes) -> Codebooks:
    """Per length, the parts of the vectors of the smallest ids: ``entries`` rows of each length."""
    lengths = [r.n for r in rows.select(F.size("x").alias("n")).distinct().collect()]
    out = {}
    for length in sorted(lengths):
        own = rows.where(F.size("x") == length).orderBy(F.col("id").asc_nulls_last(), "x").limit(options.entries)
        x = np.array([r.x for r in own.select("x").collect()], np.int64).reshape(-1, length) if length else np.zeros((own.count(), 0), np.int64)
        cut = edges(length, options)
        out[length] = [x[:, cut[p] : cut[p + 1]] for p in range(options.parts)]
    return out


def updated(state: DataFrame, books: Codebooks, options: VectorCodes) -> Codebooks:
    """Entries moved to the floored means of their parts; sums are made in the tasks, then in Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for whole_batch in slices(batches, "x"):
            for length, batch in by_length(whole_batch):
                x, cut = integers(batch.column("x"), length), edges(length, options)
                own = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), options.parts)
                if length not in sums:
                    sums[length] = np.zeros((options.entries, length), object)
                    counts[length] = np.zeros((options.parts, options.entries), np.int64)
                wide = x.size and np.abs(x.astype(np.float64)).max() * len(x) >= _LONG / 4
                for p in range(options.parts):
                    added = np.zeros((options.entries, cut[p + 1] - cut[p]), object if wide else np.int64)
                    np.add.at(added, own[:, p], x[:, cut[p] : cut[p + 1]])
                    sums[length][:, cut[p] : cut[p + 1]] += added.astype(object)
                    counts[length][p] += np.bincount(own[:, p], minlength=options.entries)
        for length, total in sums.items():
            cut = edges(length, options)
            for p in range(options.parts):
                used = np.flatnonzero(counts[length][p])
                lists = [[str(v) for v in total[e, cut[p] : cut[p + 1]]] for e in used]
                arrays = [pa.array(np.full(len(used), v, np.int32)) for v in (length, p)]
                arrays += [pa.array(used.astype(np.int32)), pa.array(counts[length][p][used]), pa.array(lists, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["length", "part", "entry", "n", "sums"])

    parts = state.select("x", "code").mapInArrow(partial, "length int, part int, entry int, n long, sums array<string>")
    cells = parts.select("length", "part", "entry", "n", F.posexplode("sums").alias("j", "v"))
    cells = cells.groupBy("length", "part", "entry", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    )
    out = {length: [book.copy() for book in own] for length, own in books.items()}
    for r in cells.collect():
        out[r.length][r.part][r.entry, r.j] = int(r.v) // r.n
    return out


def _moves(old: Codebooks, new: Codebooks) -> Codebooks:
    """How far each entry moved, in steps, rounded up."""
    out: Codebooks = {}
    for length, books in old.items():
        out[length] = []
        for before, after in zip(books, new[length], strict=True):
            gap = before.astype(object) - after.astype(object)
            moved = (gap * gap).sum(axis=1).astype(np.float64) if gap.size else np.zeros(len(gap))
            out[length].append(np.ceil(np.sqrt(moved) * (1 + 1e-12) * _STEPS))
    return out


def encode(
    table: DataFrame,
    options: VectorCodes = VectorCodes(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """(rows, final codebooks by length of the vectors). The rows, one per vector that takes part, hold
    id, ``label``, ``code`` (two hex digits per part), ``error`` (squared distances summed; null where
    that exceeds a long) and ``length``.

    Vectors that are null or hold null or non-finite entries are left out. Vectors of each length have
    codebooks of their own; a length that the parts don't divide is cut as evenly as can be. Null ids come
    last, equal ids in order of their vectors; all of them get codes. Fewer vectors than entries make a
    shorter codebook. An empty table has no rows and no codebooks.
    """
    if options.entries > 256:
        raise ValueError("an entry's number is one byte")
    named = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = named.where(finite(F.col("vector"))).select("id", "label", whole(F.col("vector"), options.scale).alias("x"))
    context = rows.sparkSession.sparkContext
    books = first_books(rows, options)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, x array<long>, code binary, near binary, low binary, needed int, error long"
    kept = min(options.kept, options.entries - 1)
    sent = context.broadcast((books, None, kept))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, wide = sent.value
        for whole_batch in slices(batches, "x"):
            for length, batch in by_length(whole_batch):
                x = integers(batch.column("x"), length)
                yield _state(batch, *assign_anew(x, own[length], wide, options))

    state = shared(rows.mapInArrow(first, schema))
    for turn in range(options.rounds):
        moved = updated(state, books, options)
        kept = kept if not turn else _adapted(state, kept, options)
        known = context.broadcast((moved, _moves(books, moved), kept))

        def again(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            own, moves, wide = known.value
            for whole_batch in slices(batches, "x"):
                for length, batch in by_length(whole_batch):
                    x = integers(batch.column("x"), length)
                    shape = (len(x), options.parts, -1)
                    near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(shape)
                    low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint16).reshape(shape)
                    yield _state(batch, *assign_again(x, own[length], moves[length], near, low, wide, options))

        state = shared(state.mapInArrow(again, schema))
        books = moved
    made = state.select("id", "label", F.lower(F.hex("code")).alias("code"), "error", F.size("x").alias("length"))
    return made.withColumnsRenamed({"id": id_col, "label": label_col}), books


def _adapted(state: DataFrame, kept: int, options: VectorCodes) -> int:
    """Entries to list from now on; one row per number of entries needed reaches the driver."""
    counts = {r.needed: r["count"] for r in state.groupBy("needed").count().collect()}
    total, over = sum(counts.values()), 0
    for needed in sorted(counts, reverse=True):
        over += counts[needed]
        if over > options.rare * total:
            return max(min(options.least, kept), min(kept, needed))
    return kept


def digest(books: Codebooks) -> dict[int, str]:
    """Per length, the hash of all entries as decimal numbers by part, entry and place."""
    out = {}
    for length, own in books.items():
        values = [str(v) for book in own for entry in book.tolist() for v in entry]
        out[length] = hashlib.sha256(",".join(values).encode()).hexdigest()
    return out


def report(
    table: DataFrame,
    options: VectorCodes = VectorCodes(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per vector that takes part: id, ``code``, ``error``, ``label_error`` (errors summed over its label,
    nulls together) and ``codebooks_sha256`` (of the codebooks for its length)."""
    made, books = encode(table, options, id_col, vector_col, label_col)
    sums = made.groupBy(F.col(label_col).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    sums = shared(sums.select("_label", F.expr("try_cast(_sum as bigint)").alias("label_error")))
    same = made[label_col].eqNullSafe(sums["_label"])
    joined = made.join(F.broadcast(sums) if fits(sums) else sums, same, "left")
    hashes = [F.lit(v) for pair in digest(books).items() for v in pair]
    own = F.element_at(F.create_map(*hashes), F.col("length")) if hashes else F.lit(None)
    return joined.select(id_col, "code", "error", "label_error", own.cast("string").alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same report as SQL over ``embeddings``, for vectors of one length that the parts divide."""
    square = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, len(v) + 1)])"
    steps = [
        f"""WITH kept AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
parts AS (
  SELECT vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM kept, range({parts}) AS r(p)),
book0 AS (
  SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts) WHERE e < {entries})"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""own{k} AS (
  SELECT vec_id, p, any_value(v) AS v, min({square} * {entries} + e) AS best FROM parts JOIN book{k} USING (p) GROUP BY vec_id, p)"""
        )
        if k < rounds:
            steps.append(
                f"""cells{k} AS (
  SELECT p, best % {entries} AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m
  FROM own{k}, range(1, 1 + (SELECT max(len(v)) FROM parts)) AS r(i) GROUP BY ALL),
moved{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM cells{k} GROUP BY ALL),
book{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e)"""
            )
    last = rounds
    steps.append(
        f"""coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM own{last} GROUP BY vec_id),
hashed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), hashed"""
    )
    return ",\n".join(steps)
