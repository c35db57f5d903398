"""Byte-level BPE encoding of whole texts, long ones in overlapping chunks, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.bpe import RankEncoder, Tokenizer
from articleflow.llm.common import map_slices, shared

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
# Fixed value: the characters that \s matches in the pattern.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(pattern: str, text: str) -> list[int]:
    """Starts of pre-tokens that follow a character other than white space.

    What lies before such a start splits the same way whatever follows it, and what lies from it on
    splits the same way whatever came before. So it is enough for two chunks to share one.
    """
    starts = (m.start() for m in _splitter(pattern).finditer(text))
    return [s for s in starts if s and text[s - 1] not in WHITE_SPACE]


def encode(
    docs: DataFrame,
    tokenizer: Tokenizer,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id and ``ids`` (little-endian unsigned 32-bit, as binary).

    ``tokenizer`` is a rank file and its pattern. A null text is empty and has no ids. Texts over
    ``chunk_chars`` become chunks of that size plus ``overlap``; chunks are split into pre-tokens
    apart, joined at the first boundary that both neighbours found in their overlap, and the pieces
    between are encoded apart. Where two neighbours share none (one very long run), the rest of the
    text is one piece. Ids and rows may repeat.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    is_long = F.length("text") > chunk_chars

    def encode_all(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = tokenizer.encoder()
        ids = [encoder.ids(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(ids, pa.binary())], names=["id", "ids"]
        )

    short = map_slices(texts.where(~is_long), encode_all, f"id {kind}, ids binary")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    part = text[at : at + chunk_chars + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id")[row : row + 1], batch.column("doc")[row : row + 1]]
                        + [pa.array([k], pa.int32()), pa.array([part], pa.string())],
                        names=["id", "doc", "k", "text"],
                    )

    numbered = texts.where(is_long).withColumn("doc", F.monotonically_increasing_id())
    chunks = numbered.mapInArrow(chunk, f"id {kind}, doc long, k int, text string")
    chunks = shared(chunks.repartition("doc", "k"))

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        head, tail = [], []
        for text in batch.column("text").to_pylist():
            found = boundaries(tokenizer.pattern, text)
            head.append([s for s in found if s < overlap])
            tail.append([s - chunk_chars for s in found if s >= chunk_chars])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("k"), pa.array(head, ints), pa.array(tail, ints)],
            names=["doc", "k", "head", "tail"],
        )

    found = map_slices(
        chunks.select("doc", "k", "text"), edges, "doc long, k int, head array<int>, tail array<int>"
    )
    order = Window.partitionBy("doc").orderBy("k")
    shared_start = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    met = found.select(
        "doc", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(shared_start).alias("start")
    )
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("whole", F.min(F.col("start").isNotNull()).over(so_far)).withColumn(
        "piece", F.max(F.when(F.col("whole"), F.col("k"))).over(so_far)
    )
    ends = F.lead(F.when(F.col("whole"), F.col("start"))).over(order)
    met = met.select("doc", "k", "piece", "start", ends.alias("end"))
    pieces = (
        chunks.join(met, ["doc", "k"])
        .groupBy("doc", "piece")
        .agg(
            F.min("id").alias("id"),
            F.min_by("start", "k").alias("start"),
            F.max_by("end", "k").alias("end"),
            F.array_sort(F.collect_list(F.struct("k", "text"))).alias("parts"),
        )
    )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for batch in batches:
            for row in batch.to_pylist():
                texts = [p["text"] for p in row["parts"]]
                stop = len(texts[-1]) if row["end"] is None else chunk_chars + row["end"]
                text = "".join([*(t[:chunk_chars] for t in texts[:-1]), texts[-1][:stop]])
                data = encoder.ids(text[row["start"] :]).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["id"]], batch.schema.field("id").type),
                        pa.array([row["doc"]], pa.int64()),
                        pa.array([row["piece"]], pa.int32()),
                        pa.array([data], pa.binary()),
                    ],
                    names=["id", "doc", "piece", "ids"],
                )

    encoded = pieces.mapInArrow(encode_pieces, f"id {kind}, doc long, piece int, ids binary")
    whole = encoded.groupBy("doc").agg(
        F.min("id").alias("id"),
        F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"),
    )
    text_ids = F.aggregate("parts", F.lit(b""), lambda acc, part: F.concat(acc, part["ids"]))
    long = whole.select("id", text_ids.alias("ids"))
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encoded`` (id, ``ids``): id and ``bytes``, the raw bytes of its ids.

    Null ids give no bytes. An id that the tokenizer lacks is an error.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = words(tokenizer)
        data = [b"".join(map(raw.__getitem__, _numbers(v))) for v in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(data, pa.binary())], names=["id", "bytes"]
        )

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return map_slices(rows, run, f"id {kind}, bytes binary", "ids").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``encoded``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The ids are decoded as by :func:`decode` and only digests leave the task.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import hashlib

        raw, shown = words(tokenizer), decimals(tokenizer)
        counts, of_ids, of_bytes = [], [], []
        for value in batch.column("ids").to_pylist():
            numbers = _numbers(value)
            counts.append(len(numbers))
            of_ids.append(hashlib.sha256(b",".join(map(shown.__getitem__, numbers))).hexdigest())
            of_bytes.append(hashlib.sha256(b"".join(map(raw.__getitem__, numbers))).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts, pa.int64())]
            + [pa.array(v, pa.string()) for v in (of_ids, of_bytes)],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows, run, schema, "ids").withColumnRenamed("id", id_col)


def _numbers(data: bytes | None) -> list[int]:
    return np.frombuffer(data or b"", "<u4").tolist()


@lru_cache(maxsize=2)
def words(tokenizer: Tokenizer) -> dict[int, bytes]:
    encoder = tokenizer.encoder()
    if not isinstance(encoder, RankEncoder):
        raise TypeError("decoding needs a rank file")
    return {rank: word for word, rank in encoder.ranks.items()}


@lru_cache(maxsize=2)
def decimals(tokenizer: Tokenizer) -> dict[int, bytes]:
    return {rank: str(rank).encode() for rank in words(tokenizer)}
