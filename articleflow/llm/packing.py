"""Packing of documents into training sequences: first-fit decreasing inside random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.bpe import Tokenizer
from articleflow.llm.common import map_slices, shared

END_ID = 1
GROUP_ROWS = 8192
_PIECE = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
)
_PLACED = "piece_id long, bin long, offset long"


class CapacityTree:
    """Tournament tree over open bins: each node holds the most room of the bins below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room for it: (bin, room it had)."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        had = most[node]
        most[node] = had - size
        first = node - self.leaves
        node //= 2
        while node:
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left >= right else right
            if most[node] == best:
                break
            most[node] = best
            node //= 2
        return first, had


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item; larger items first, equal ones in the order given."""
    tree = CapacityTree(len(sizes), room)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item in np.argsort(-sizes, kind="stable"):
        bins[item], had = tree.place(int(sizes[item]))
        offsets[item] = room - had
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: Tokenizer,
    length: int = 2048,
    group_rows: int = GROUP_ROWS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, and with ``with_ids`` the piece's ids (``ids``: little-endian unsigned 32-bit).

    A document is its ids and then ``END_ID``; a null text is empty, so it has that one id. Pieces
    of exactly ``length`` are cut off the front and are sequences of their own, which never move.
    What is left (under ``length``) is dealt at random into groups of about ``group_rows`` and each
    group is packed alone. Equal ids or repeated rows are separate documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = tokenizer.encoder()
        rows, start, size, crc, total, data = [], [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = np.append(encoder.ids(text or ""), np.uint32(END_ID)).astype("<u4")
            for at in range(0, len(ids), length):
                piece = ids[at : at + length]
                rows.append(row)
                start.append(at)
                size.append(len(piece))
                crc.append(zlib.crc32(piece))
                total.append(len(ids))
                data.append(piece.tobytes() if with_ids else None)
        long = pa.int64()
        arrays = [batch.column("doc_id").take(pa.array(rows, long))]
        arrays += [pa.array(v, long) for v in (start, size, crc, total)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(data, pa.binary())],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
        )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = map_slices(texts, cut, _PIECE.format(id=kind))
    # Numbers are given once and stored, so a repeated stage sees the same ones.
    pieces = shared(pieces.withColumn("piece_id", F.monotonically_increasing_id()))
    rest = pieces.where(F.col("length") < length).select("piece_id", "length")
    groups = max(1, -(-rest.count() // group_rows))
    group = F.pmod(F.xxhash64("piece_id"), F.lit(groups)).alias("group")

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(batches).sort_by("piece_id")
        bins, offsets = first_fit_decreasing(items["length"].to_numpy(), length)
        yield pa.RecordBatch.from_arrays(
            [
                items["piece_id"].combine_chunks(),
                pa.array((key[0].as_py() << 32) + bins, pa.int64()),
                pa.array(offsets, pa.int64()),
            ],
            names=["piece_id", "bin", "offset"],
        )

    placed = rest.select("piece_id", "length", group).groupBy("group").applyInArrow(fill, _PLACED)
    joined = pieces.join(placed, "piece_id", "left")
    # Even numbers: sequences of one whole piece; odd ones: packed bins.
    sequence = F.coalesce(F.col("bin") * 2 + 1, F.col("piece_id") * 2)
    return joined.select(
        F.col("doc_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        sequence.alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
