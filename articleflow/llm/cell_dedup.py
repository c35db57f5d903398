"""Embedding near-duplicates: spherical k-means cells, cosine products of every two cells within reach."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import map_slices, shared
from articleflow.llm.components import components
from articleflow.llm.vectors import matrix, numbers, unit, usable


# Blocks of vectors that travel together; a cell holds about as many.
PACK = 8


@dataclass(frozen=True)
class CellDedup:
    """A cell for every ``PACK`` blocks; the centres are fitted on a sample of about ``sample`` distinct
    vectors. Links are counted exactly whatever the cells are. ``nearest``: centres whose bisectors
    tell which cells a vector can't reach. ``block``: vectors multiplied at once."""

    threshold: float = 0.95
    nearest: int = 4
    sample: int = 16384
    most_cells: int = 4096
    rounds: int = 5
    block: int = 512


def _centres(distinct: DataFrame, count: int, options: CellDedup) -> np.ndarray:
    """Unit centres by k-means under the cosine distance, for vectors of one length."""
    cells = min(options.most_cells, -(-count // (PACK * options.block)))
    step = max(1, count // options.sample)
    part = distinct.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(step)) == 0)
    largest = F.array_max(F.transform("vector", F.abs)).cast("double")
    scaled = F.transform("vector", lambda x: x.cast("double") / largest)
    features = part.select(array_to_vector(scaled).alias("features"))
    model = KMeans(
        k=cells, distanceMeasure="cosine", maxIter=options.rounds, seed=11, initMode="random"
    ).fit(features)
    return unit(np.array(model.clusterCenters()))


def near_duplicates(
    table: DataFrame,
    options: CellDedup = CellDedup(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per row of ``table``: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or not finite link with nothing and are kept. A cosine needs
    vectors of one length, so each length has cells of its own. Every row is a vector of its own, so a
    repeated row links with its copy; rows of a null id take no part (no links, null component, not kept).

    Exact copies fold into one vector with its number of rows. A vector lives in the cell of its
    nearest centre and visits every other cell in which an angle bound leaves room for a link, so no
    pair at the threshold is missed. Cells are cut into groups of about ``PACK`` blocks; a pair of
    groups is the unit of work, so a crowd spreads over many tasks. A group goes only to pairs in which
    some vector visits the other's cell. A pair gives counts and a spanning forest of its links,
    never the links.
    """
    rows = table.select(F.col(id_col).alias("id"), numbers(table, vector_col).alias("vector"))
    good = usable(F.col("vector")) & F.col("id").isNotNull()
    # -0.0 + 0.0 is 0.0, so equal numbers have equal digests.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    digest = F.when(good, F.sha2(F.array_join(plain, ",").cast("binary"), 256))
    keyed = shared(rows.select("id", F.when(good, F.col("vector")).alias("vector"), digest.alias("digest")))
    counted = keyed.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("key"), F.count("*").alias("times"), F.first("vector").alias("vector")
    )
    counted = shared(counted.withColumn("length", F.size("vector")))
    kind = rows.schema["id"].dataType.simpleString()
    # Lengths that fill more than one cell.
    wide = counted.groupBy("length").count().where(F.col("count") > PACK * options.block).collect()
    centres = {
        r.length: _centres(counted.where(F.col("length") == r.length), r["count"], options) for r in wide
    }
    found = shared(_linked(counted, centres, kind, options))
    linked = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    label = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "key")
    known = counted.select("digest", "key", "times").join(linked, "key", "left").join(label, "key", "left")
    known = known.select(
        "digest",
        (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "key").alias("component_id"),
    )
    out = keyed.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def _linked(
    counted: DataFrame, centres: dict[int, np.ndarray], kind: str, options: CellDedup
) -> DataFrame:
    """(a, b, n): ``n`` rows linked to ``a`` where ``b`` is null, else a link of the spanning forest.

    Every two vectors meet once: in their own group, or as resident and visitor of two groups.
    """
    vector_kind = counted.schema["vector"].dataType.simpleString()
    reach, slack = math.acos(max(-1.0, min(1.0, options.threshold))), 1e-9

    def of_length(length: int) -> np.ndarray:
        return centres.get(length, np.zeros((1, length)))

    def angles(products: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(products, -1.0, 1.0))

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = batch.column("length").to_numpy()
        cell, angle = np.zeros(len(lengths), np.int32), np.zeros(len(lengths))
        for length in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == length)
            near = unit(matrix(batch.column("vector").take(pa.array(some)), length)) @ of_length(length).T
            cell[some], angle[some] = near.argmax(axis=1), angles(near.max(axis=1))
        names = ["key", "times", "vector", "length"]
        arrays = [*(batch.column(n) for n in names), pa.array(cell), pa.array(angle)]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "cell", "angle"])

    settled = f"key {kind}, times long, vector {vector_kind}, length int, cell int, angle double"
    settled = shared(map_slices(counted.select("key", "times", "vector", "length"), settle, settled, "vector"))
    # One row per cell; there are at most ``most_cells`` of a length.
    cells = settled.groupBy("length", "cell").agg(
        F.ceil(F.count("*") / (PACK * options.block)).cast("int").alias("parts"), F.max("angle").alias("radius")
    )
    known = cells.orderBy("length", "radius", "cell").collect()
    # Groups in order of their cells' radius: a pair's visitors come from the wider cell.
    owner = [at for at, r in enumerate(known) for _ in range(r.parts)]
    begin = [0]
    for r in known:
        begin.append(begin[-1] + r.parts)
    first_cell = {r.length: at for at, r in reversed(list(enumerate(known)))}
    bounds = settled.sparkSession.createDataFrame(
        [(r.length, r.cell, begin[at], r.parts) for at, r in enumerate(known)],
        "length int, cell int, begin int, parts int",
    )
    own = (F.col("begin") + F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts"))).cast("int")
    placed = settled.join(F.broadcast(bounds), ["length", "cell"])
    members = shared(placed.select("key", "times", "vector", own.alias("own")))

    def visits(vectors: np.ndarray, products: np.ndarray, at: int) -> np.ndarray:
        """Whether residents of other cells may link with one of this cell."""
        cell, points = known[at].cell, of_length(known[at].length)
        out = angles(products[:, cell]) <= known[at].radius + reach + slack
        if reach < math.pi / 2:
            near = np.argsort(-products, axis=1)[:, : options.nearest]
            for j in range(near.shape[1]):
                # Residents are on this cell's side of the bisector.
                apart = np.sqrt(((points[near[:, j]] - points[cell]) ** 2).sum(axis=1))
                beyond = np.take_along_axis(products, near[:, j : j + 1], 1)[:, 0] - products[:, cell]
                out &= beyond <= math.sin(reach) * apart + slack
        return out

    def visited(me: int, raw: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """The narrower cells that vectors of a group visit, and which vectors do."""
        length = known[owner[me]].length
        vectors = unit(matrix(raw, length))
        products = vectors @ of_length(length).T
        for at in range(first_cell[length], owner[me]):
            found = np.flatnonzero(visits(vectors, products, at))
            if len(found):
                yield at, found

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = key[0].as_py()
        raw = pa.Table.from_batches(batches)["vector"].combine_chunks()
        for at, _ in visited(me, raw):
            homes = np.arange(begin[at], begin[at + 1], dtype=np.int32)
            host = np.full(len(homes), me, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(homes), pa.array(host)], names=["own", "other"])

    # Narrow: the groups that have visitors from another one. They travel as rows without a vector.
    asked = members.groupBy("own").applyInArrow(meet, "own int, other int")
    members = members.withColumn("other", F.lit(None).cast("int")).unionByName(asked, allowMissingColumns=True)

    def send(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = key[0].as_py()
        part = pa.Table.from_batches(batches)
        hosts = part["other"].drop_null().to_pylist()
        part = part.filter(pc.is_valid(part["times"])).combine_chunks()
        keys, times = part["key"].combine_chunks(), part["times"].combine_chunks()
        raw = part["vector"].combine_chunks()

        def side(low: int, high: int, keep: pa.Array | None) -> pa.RecordBatch:
            arrays = [pa.array([v], pa.int32()) for v in (low, high, me)]
            values = [keys, times, raw] if keep is None else [v.take(keep) for v in (keys, times, raw)]
            for some in (values[0], values[1], values[2].flatten()):
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some))
            return pa.RecordBatch.from_arrays(arrays, names=["low", "high", "own", "keys", "times", "vectors"])

        # All of a group meet its own cell's other groups, and the visitors from wider cells.
        for other in (*range(begin[owner[me]], begin[owner[me] + 1]), *hosts):
            yield side(min(me, other), max(me, other), None)
        for at, found in visited(me, raw):
            for other in range(begin[at], begin[at + 1]):
                yield side(other, me, pa.array(found))

    sent = f"low int, high int, own int, keys array<{kind}>, times array<bigint>, vectors {vector_kind}"
    tiles = members.groupBy("own").applyInArrow(send, sent)
    threshold, step = options.threshold, options.block

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (k.as_py() for k in key)
        length = known[owner[low]].length
        sides = {b.column("own")[i].as_py(): b.slice(i, 1) for b in batches for i in range(b.num_rows)}
        if len(sides) < (1 if low == high else 2):
            return
        order = [low] if low == high else [low, high]
        ids = pa.concat_arrays([sides[k].column("keys").flatten() for k in order])
        times = np.concatenate([sides[k].column("times").flatten().to_numpy() for k in order])
        vectors = unit(np.concatenate([matrix(sides[k].column("vectors"), length) for k in order]))
        count = len(sides[low].column("keys").flatten())
        start = 0 if low == high else count
        gained, joined = np.zeros(len(times), np.int64), []
        parent = np.arange(len(times))
        for at in range(0, count, step):
            some = np.arange(at, min(at + step, count))
            first = at if low == high else start
            hits = vectors[some] @ vectors[first:].T >= threshold
            if low == high:
                hits &= np.arange(first, len(times)) > some[:, None]
            if not hits.any():
                continue
            gained[some] += hits @ times[first:]
            gained[first:] += times[some] @ hits
            a, b = np.nonzero(hits)
            joined.extend(_forest(parent, a + at, b + first))
        hit = np.flatnonzero(gained)
        take = lambda at: ids.take(pa.array(at, pa.int64()))
        none = pa.nulls(len(hit), ids.type)
        if len(hit):
            yield pa.RecordBatch.from_arrays([take(hit), none, pa.array(gained[hit])], names=["a", "b", "n"])
        if joined:
            a, b = zip(*joined, strict=True)
            yield pa.RecordBatch.from_arrays(
                [take(a), take(b), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "n"]
            )

    return tiles.groupBy("low", "high").applyInArrow(compare, f"a {kind}, b {kind}, n long")


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join parts that were still apart."""
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # In bulk first: most links of a dense block lead to a vector's first partner.
    first = np.unique(a, return_index=True)[1]
    for pick in (first, np.unique(b, return_index=True)[1], None):
        if pick is None:
            tops = np.array([root(x) for x in range(len(parent))])
            pick = np.flatnonzero(tops[a] != tops[b])
        for x, y in zip(a[pick].tolist(), b[pick].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    return out
