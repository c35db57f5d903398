"""Embedding whitening: distributed centred covariance, leading eigenpairs, broadcast projection.

Every entry c of a vector is taken as the whole number floor(256 * c). The statistics are those of
the distinct whole vectors, so copies don't pull the components. The covariance is summed in Spark
after centring; what reaches the driver is one matrix, whose size depends on the vectors' length
and not on the number of rows. Its leading eigenpairs come from a Householder tridiagonalisation,
bisection by Sturm counts and inverse iteration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import shared, slices

_EPS = float(np.finfo(np.float64).eps)
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``components``: how many leading ones, at most. ``scale``: steps of a whole number in 1.
    ``flat``: share of the largest eigenvalue at or below which a direction counts as constant."""

    components: int = 4
    scale: int = 256
    flat: float = 1e-12


@dataclass(frozen=True)
class Fit:
    """Of the distinct vectors of one length: their number, sums per entry, leading eigenvalues,
    eigenvectors (rows) and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite entries only; an empty one does."""
    entries = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & entries, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of every entry as long; beyond the range of a long, its nearest bound."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def integers(column: pa.Array, length: int) -> np.ndarray:
    """A column of whole vectors of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, its rows) of a batch of vectors of several lengths."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(sizes).tolist():
        yield length, batch.take(pa.array(np.flatnonzero(sizes == length)))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Householder vectors (rows) that turn a symmetric matrix into it."""
    a = matrix.copy()
    size = len(a)
    turns = np.zeros((max(0, size - 2), size))
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or np.abs(v[1:]).max() == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        turns[k, k + 1 :] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= v * (v @ p)
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues of a tridiagonal matrix below each of the given numbers."""
    tiny = np.finfo(np.float64).tiny
    q = np.full(len(at), 1.0)
    count = np.zeros(len(at), np.int64)
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling: intervals halved until they are one number wide."""
    size = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off)) if size > 1 else np.zeros(1)
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    pad = 2 * _EPS * max(abs(low[0]), abs(high[0]), np.finfo(np.float64).tiny)
    low, high = low - pad, high + pad
    wanted = size - 1 - np.arange(count)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        below = sturm_count(diagonal, off, middle) > wanted
        high, low = np.where(open_ & below, middle, high), np.where(open_ & ~below, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; pivots are ``least`` at least."""
    size = len(diagonal)
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    y = right.copy()
    for k in range(size - 1):
        under = off[k]
        if abs(under) > abs(main[k]):
            # The next row becomes the pivot row.
            factor = main[k] / under
            main[k], old_upper = under, upper[k]
            upper[k], second[k] = main[k + 1], upper[k + 1]
            main[k + 1] = old_upper - factor * upper[k]
            upper[k + 1] = -factor * second[k]
            y[k], y[k + 1] = y[k + 1], y[k] - factor * y[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            factor = under / main[k]
            main[k + 1] -= factor * upper[k]
            y[k + 1] -= factor * y[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(size - 1, -1, -1):
        if k + 1 < size:
            y[k] -= upper[k] * y[k + 1]
        if k + 2 < size:
            y[k] -= second[k] * y[k + 2]
        y[k] /= main[k]
        big = abs(y[k])
        if big > 1e150:
            y /= big
    return y


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors (rows)."""
    size = len(matrix)
    count = min(count, size)
    top = float(np.abs(matrix).max()) if size else 0.0
    if not count or top == 0:
        return np.zeros(count), np.eye(size)[:count]
    diagonal, off, turns = tridiagonal(matrix / top)
    values = largest(diagonal, off, count)
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if len(off) else 0))
    rng = np.random.default_rng(1)
    found: list[np.ndarray] = []
    start = 0
    for k, value in enumerate(values):
        # Eigenvalues closer than this to their neighbour form a cluster, kept orthogonal as a whole.
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        y = rng.normal(size=size)
        for _ in range(6):
            for other in found[start:]:
                y -= other * (other @ y)
            y = _solve(diagonal, off, value - (k - start) * 4 * _EPS * norm, y / np.linalg.norm(y), _EPS * norm)
            y /= np.abs(y).max()
        for _ in range(2):
            for other in found[start:]:
                y -= other * (other @ y)
            y /= np.linalg.norm(y)
        found.append(y)
    vectors = np.array(found)
    for v in turns[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    return values * top, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def whole_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x``, the whole numbers, of every row that takes part."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.where(finite(F.col("vector"))).select("id", whole(F.col("vector"), scale).alias("x"))


def fit(distinct: DataFrame, options: Whitening = Whitening()) -> dict[int, Fit]:
    """Means and leading components of the distinct vectors ``x`` of every length."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for whole_batch in batches:
            for length, part in by_length(whole_batch):
                x = integers(part.column("x"), length)
                safe = x.size == 0 or np.abs(x.astype(np.float64)).max() * len(x) < _LONG / 4
                own = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
                counts[length] = counts.get(length, 0) + len(x)
                sums[length] = sums.get(length, 0) + own
        for length, n in counts.items():
            values = [str(v) for v in (sums[length].tolist() if length else [])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([length], pa.int32()), pa.array([n]), pa.array([values], pa.list_(pa.string()))],
                names=["length", "n", "sums"],
            )

    parts = shared(distinct.mapInArrow(totals, "length int, n long, sums array<string>"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries = parts.select("length", F.posexplode("sums").alias("i", "v"))
    entries = entries.groupBy("length", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums: dict[int, list[int]] = {length: [0] * length for length in counts}
    for r in entries.collect():
        sums[r.length][r.i] = int(r.v)
    means = {length: np.array([s / counts[length] for s in sums[length]]) for length in counts if length}
    sent = distinct.sparkSession.sparkContext.broadcast(means)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole_batch in batches:
            for length, part in by_length(whole_batch):
                if length:
                    centred = integers(part.column("x"), length) - sent.value[length]
                    total[length] = total.get(length, 0) + centred.T @ centred
        for length, square in total.items():
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(length + 1) * length, pa.int32()), pa.array(square.ravel())
            )
            arrays = [pa.array(np.full(length, length, np.int32)), pa.array(np.arange(length, dtype=np.int32)), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["length", "i", "line"])

    lines = distinct.mapInArrow(moments, "length int, i int, line array<double>")
    cells = lines.select("length", "i", F.posexplode("line").alias("j", "v")).where("j >= i")
    cells = cells.groupBy("length", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = {}
    for length, n in counts.items():
        if not length:
            continue
        own = cells.filter(pc.equal(cells["length"], length))
        square = np.zeros((length, length))
        i, j = own["i"].to_numpy(), own["j"].to_numpy()
        square[i, j] = square[j, i] = own["v"].to_numpy() / n
        values, vectors = leading(square, options.components)
        real = values > max(options.flat * values[0], 0.0)
        out[length] = Fit(n, tuple(sums[length]), values[real], vectors[real], float(np.trace(square)))
    return out


def project(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """``id``, ``n``, ``deviation``, ``explained`` and ``whitened`` (lists over the components) of
    every row of whole vectors."""
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in slices(batches, "x"):
            for length, part in by_length(whole_batch):
                model = sent.value.get(length)
                if model is None or not len(model.values):
                    continue
                x = integers(part.column("x"), length)
                sums = np.array(model.sums, object)
                most = model.n * float(np.abs(x.astype(np.float64)).max()) + max(abs(s) for s in model.sums)
                if most * most * length < _LONG / 2:
                    far = ((model.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    far = [v if v <= _LONG else None for v in ((model.n * x.astype(object) - sums) ** 2).sum(axis=1)]
                mean = np.array([s / model.n for s in model.sums])
                scores = (x - mean) @ model.vectors.T / np.sqrt(model.values)
                count = len(model.values)
                at = pa.array(np.arange(len(x) + 1) * count, pa.int32())
                share = np.tile(model.values / model.trace, len(x))
                arrays = [part.column("id"), pa.array(np.full(len(x), model.n)), pa.array(far, pa.int64())]
                arrays += [pa.ListArray.from_arrays(at, pa.array(v)) for v in (share, scores.ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "deviation", "explained", "whitened"])

    schema = f"id {kind}, n long, deviation long, explained array<double>, whitened array<double>"
    return rows.mapInArrow(run, schema)


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length, the largest entry of the whitened distinct vectors' covariance minus the identity."""
    sizes = {length: len(f.values) for length, f in fits.items() if len(f.values)}
    most = max(sizes.values(), default=0)
    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    if not pairs:
        return {}
    scores = project(distinct.select(F.size("x").alias("id"), "x"), fits)
    value = lambda k: F.get("whitened", F.lit(k))
    moments = scores.groupBy("id").agg(*[F.covar_pop(value(a), value(b)).alias(f"c{a}_{b}") for a, b in pairs])
    out = {}
    for r in moments.collect():
        size = sizes[r.id]
        out[r.id] = max(abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if b < size)
    return out


def whiten(
    table: DataFrame,
    options: Whitening = Whitening(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector and leading component: id, ``component`` (from 1, by falling variance),
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null or non-finite entries are left out; every other row is
    projected, repeated rows and rows of a null id too. ``n`` is the number of distinct whole vectors
    the components are fitted on, ``deviation`` the sum over the entries of (n x - S)^2 with their sums
    S, in whole numbers, and null where that exceeds a long; ``explained`` the component's share of the
    variance; ``identity_error`` the largest entry of the covariance of all whitened distinct vectors
    minus the identity, measured. Equal eigenvalues give any orthonormal components.

    Vectors of each length are a table of their own. There are as many components as entries vary:
    none for an empty vector, or where all vectors are equal, so such rows give no result rows.
    Other columns of the table play no part.
    """
    rows = whole_vectors(table, options.scale, id_col, vector_col)
    distinct = shared(rows.select("x").distinct())
    fits = fit(distinct, options)
    errors = identity_errors(distinct, fits)
    worst = F.lit(None).cast("double")
    if errors:
        worst = F.element_at(F.create_map(*[F.lit(v) for pair in errors.items() for v in pair]), F.col("length"))
    made = project(rows.select(F.struct("id", F.size("x").alias("length")).alias("id"), "x"), fits)
    flat = made.select("id.*", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "v"))
    return flat.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained",
        worst.cast("double").alias("identity_error"),
    )
