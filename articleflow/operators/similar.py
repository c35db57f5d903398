"""Similar entries by cosine of their embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.functions.vectors import cosine, norm, vector_literal
from articleflow.operators.ordering import top_per_group

# Similarity from which entries count as similar, and how many are shown.
THRESHOLD = 0.85
LIMIT = 5

TILE_ROWS = 2_048

# Column blocks a cell is cut into before its tiles grow, how many times ``TILE_ROWS`` they grow to, and how many
# products a task holds at once. Each vector travels once per block, so blocks that grow keep the shuffle down.
BLOCKS, GROWTH = 8, 8
PRODUCTS = 4_194_304

# Vectors dealt to cells at once: each may go to many, and all those copies are held together.
DEAL_ROWS = 256


def similar_to(
    embeddings: DataFrame,
    entry_id: int | None,
    vector: Sequence[float],
    threshold: float = THRESHOLD,
    limit: int = LIMIT,
) -> DataFrame:
    """Entries most similar to one vector, without the entry itself: one scan, no join."""
    others = embeddings if entry_id is None else embeddings.where(F.col("entry_id") != entry_id)
    scored = others.select(
        "entry_id", cosine(F.col("embedding"), vector_literal(vector)).alias("similarity")
    )
    return (
        scored.where(F.col("similarity") >= threshold)
        .orderBy(F.desc("similarity"), "entry_id")
        .limit(limit)
    )


def vector_of(embeddings: DataFrame, entry_id: int) -> list[float] | None:
    row = embeddings.where(F.col("entry_id") == entry_id).select("embedding").first()
    return None if row is None else list(row["embedding"])


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): every distinct vector once, and each entry with its group.

    A group is named by its smallest entry. Equal vectors fold before the shuffle, so copies of
    one article, however many, cost one row from here on.
    """
    valid = embeddings.where(norm(F.col("embedding")) > 0)
    keyed = valid.withColumn("_h", F.xxhash64("embedding"))
    groups = keyed.groupBy("_h", "embedding").agg(F.min("entry_id").alias("group_id"))
    members = keyed.join(groups, ["_h", "embedding"]).select("entry_id", "group_id")
    return groups.select("group_id", "embedding"), members


def _unit(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), DEAL_ROWS):
            yield batch.iloc[start : start + DEAL_ROWS]


def _pivots(groups: DataFrame, count: int) -> np.ndarray:
    """Sample of at most ``count`` unit vectors; how good they are affects speed, not the result."""
    rows = groups.orderBy(F.xxhash64("group_id"), "group_id").select("embedding").limit(count).collect()
    return _unit(pd.Series([r["embedding"] for r in rows]))


def _cells_exact(groups: DataFrame, threshold: float, pivots: np.ndarray) -> DataFrame:
    """(cell, role, group_id, embedding) such that every similar pair meets in the first one's cell.

    A vector lives in the cell of its nearest pivot and visits each cell whose pivot is at most
    ``2r`` farther, ``r`` being the distance that belongs to the threshold: by the triangle
    inequality no vector within ``r`` of a resident can stay away.
    """
    radius = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            x = _unit(batch["embedding"])
            width = max(x.shape[1], pivots.shape[1])
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ p.T))
            home = d.argmin(axis=1)
            visits = d <= d[np.arange(len(d)), home][:, None] + 2 * radius
            row, cell = np.nonzero(visits)
            yield pd.DataFrame(
                {
                    "cell": cell.astype("int64"),
                    "resident": home[row] == cell,
                    "group_id": batch["group_id"].to_numpy()[row],
                    "embedding": batch["embedding"].to_numpy()[row],
                }
            )

    return groups.mapInPandas(
        assign, "cell bigint, resident boolean, group_id bigint, embedding array<double>"
    )


def _cells_hashed(groups: DataFrame, bands: int, bits: int, width: int, seed: int) -> DataFrame:
    """Buckets of random-hyperplane signs: similar vectors probably share one of the bands."""
    planes = np.random.default_rng(seed).standard_normal((width, bands * bits))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            x = _unit(batch["embedding"])[:, :width]
            signs = (x @ planes[: x.shape[1]] > 0).reshape(len(x), bands, bits)
            code = signs @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
            yield pd.DataFrame(
                {
                    "cell": code.reshape(-1).astype("int64"),
                    "resident": True,
                    "group_id": np.repeat(batch["group_id"].to_numpy(), bands),
                    "embedding": np.repeat(batch["embedding"].to_numpy(), bands),
                }
            )

    return groups.mapInPandas(
        assign, "cell bigint, resident boolean, group_id bigint, embedding array<double>"
    )


def _tiles(cells: DataFrame, tile_rows: int) -> DataFrame:
    """Cells cut into tiles of bounded size: (cell, a, b, side, group_id, embedding).

    Residents form the rows (side 0, block a), residents and visitors the columns (side 1, block
    b). A crowded cell becomes many tiles, each with about ``tile_rows`` rows and columns; where that were
    more than ``BLOCKS`` column blocks, tiles grow up to ``GROWTH`` times that.
    """
    counted = cells.groupBy("cell").agg(F.count_if("resident").alias("residents"), F.count(F.lit(1)).alias("all"))
    side = F.least(F.greatest(F.col("all") / BLOCKS, F.lit(tile_rows)), F.lit(GROWTH * tile_rows))
    sizes = counted.select(
        "cell",
        F.ceil(F.col("residents") / side).cast("int").alias("blocks_a"),
        F.ceil(F.col("all") / side).cast("int").alias("blocks_b"),
    )
    # One row per pivot or hash bucket, a number fixed by the caller.
    sized = cells.join(F.broadcast(sizes), "cell").where("blocks_a > 0")
    spot = F.xxhash64("group_id")
    every_a = F.transform(
        F.sequence(F.lit(0), F.col("blocks_a") - 1),
        lambda a: F.struct(
            a.alias("a"), F.pmod(spot, F.col("blocks_b")).cast("int").alias("b"), F.lit(1).alias("side")
        ),
    )
    every_b = F.transform(
        F.sequence(F.lit(0), F.col("blocks_b") - 1),
        lambda b: F.struct(
            F.pmod(spot, F.col("blocks_a")).cast("int").alias("a"), b.alias("b"), F.lit(0).alias("side")
        ),
    )
    places = F.when(F.col("resident"), F.concat(every_a, every_b)).otherwise(every_a)
    return sized.withColumn("t", F.explode(places)).select(
        "cell", "t.a", "t.b", "t.side", "group_id", "embedding"
    )


def _best_in_tile(threshold: float, limit: int):
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        empty = pd.DataFrame(
            {
                "group_id": pd.Series(dtype="int64"),
                "other_id": pd.Series(dtype="int64"),
                "similarity": pd.Series(dtype="float64"),
            }
        )
        if left.empty or right.empty:
            return empty
        x, y = _unit(left["embedding"]), _unit(right["embedding"])
        width = max(x.shape[1], y.shape[1])
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        y = np.pad(y, ((0, 0), (0, width - y.shape[1])))
        ids, others = left["group_id"].to_numpy(), right["group_id"].to_numpy()
        order = np.argsort(others, kind="stable")
        others, y = others[order], y[order]
        kept = []
        step = max(1, PRODUCTS // len(others))
        for start in range(0, len(ids), step):
            mine = ids[start : start + step]
            sims = x[start : start + step] @ y.T
            sims[mine[:, None] == others[None, :]] = -2.0
            for i in range(len(mine)):
                near = np.nonzero(sims[i] >= threshold - 1e-12)[0]
                near = near[np.argsort(-sims[i][near], kind="stable")[:limit]]
                kept.append((np.full(len(near), mine[i]), others[near], sims[i][near]))
        return pd.DataFrame(
            {
                "group_id": np.concatenate([k[0] for k in kept]),
                "other_id": np.concatenate([k[1] for k in kept]),
                "similarity": np.concatenate([k[2] for k in kept]),
            }
        )

    return best


def similar_entries(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    limit: int = LIMIT,
    pivots: int | None = None,
    method: str = "exact",
    bands: int = 16,
    bits: int = 8,
    tile_rows: int = TILE_ROWS,
    seed: int = 11,
) -> DataFrame:
    """The ``limit`` most similar entries of every entry: entry_id, other_id, similarity.

    Works on distinct vectors. Vectors that can be similar meet in cells; crowded cells are split
    into tiles that fit a task, and a tile passes on at most ``limit`` neighbours per vector, so no
    task ever emits all pairs. Copies are expanded at the end, where each entry needs only the
    first ``limit + 1`` entries of a group. ``method="exact"`` misses nothing; ``"hashed"`` trades
    recall for fewer comparisons (random hyperplanes; found pairs are scored exactly).

    All stored vectors have the same length here; shorter ones count as padded with zeros.
    """
    groups, members = distinct_vectors(embeddings)
    if method == "exact":
        # Visiting pays off only while the allowed detour is below the usual distance of vectors.
        detour = 2 * np.sqrt(max(0.0, 2.0 - 2.0 * threshold))
        count = pivots if pivots is not None else (64 if detour < 1.2 else 1)
        picked = _pivots(groups, count)
        if not len(picked):
            return embeddings.sparkSession.createDataFrame(
                [], "entry_id bigint, other_id bigint, similarity double"
            )
        cells = _cells_exact(groups, threshold, picked)
    elif method == "hashed":
        width = groups.select(F.max(F.size("embedding"))).first()[0] or 1
        cells = _cells_hashed(groups, bands, bits, width, seed)
    else:
        raise ValueError("method is 'exact' or 'hashed'")
    found = _tiles(cells, tile_rows).groupBy("cell", "a", "b").applyInPandas(
        _best_in_tile(threshold, limit), "group_id bigint, other_id bigint, similarity double"
    )
    # A pair can meet in several cells; its score is the same up to rounding.
    pairs = found.groupBy("group_id", "other_id").agg(F.max("similarity").alias("similarity"))
    best = top_per_group(
        pairs, ["group_id"], [F.desc("similarity"), F.col("other_id")], limit
    )
    # First entries of every group, enough to fill a list even without the entry itself.
    heads = top_per_group(
        members, ["group_id"], [F.col("entry_id")], limit + 1, spread=16
    ).select(F.col("group_id").alias("other_group"), F.col("entry_id").alias("other_id"))
    offers = best.select("group_id", F.col("other_id").alias("other_group"), "similarity").unionByName(
        members.select("group_id").distinct().select(
            "group_id", F.col("group_id").alias("other_group"), F.lit(1.0).alias("similarity")
        )
    )
    offers = offers.join(heads, "other_group").select("group_id", "other_id", "similarity")
    short = top_per_group(
        offers.where(F.col("similarity") >= threshold),
        ["group_id"],
        [F.desc("similarity"), F.col("other_id")],
        limit + 1,
    )
    lists = short.groupBy("group_id").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col("other_id").alias("o")))
        ).alias("list")
    )
    # At most limit + 1 candidates per group travel to its members as one array.
    mine = members.join(lists, "group_id")
    kept = F.slice(F.filter("list", lambda c: c["o"] != F.col("entry_id")), 1, limit)
    return mine.select("entry_id", F.explode(kept).alias("c")).select(
        "entry_id", F.col("c.o").alias("other_id"), (-F.col("c.d")).alias("similarity")
    )
