"""Quality scores by nearest-neighbour voting among labelled documents in a latent semantic space.

A document is a bag of hashed words, first and last bytes of words, and a few marks of its form
(length, variety, repeated lines). Bags are weighted by rarity and projected on the leading singular
directions of the labelled sample. Every document is compared with every labelled vector, in blocks;
its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import WORD_SLICE_BYTES, map_slices
from articleflow.llm.wordhash import split_words

_WORDS = 4096
_LAST, _FIRST, _FORM = _WORDS, _WORDS + 256, _WORDS + 512
_MARKS = 5
_STEPS = 16
SIZE = _FORM + _MARKS * _STEPS


@dataclass(frozen=True)
class QualityVote:
    """``sample``: labelled documents of each label that are kept as neighbours, at most (the model's
    size, and what is sent to every task, depends on nothing else). ``power``: of the similarity in a
    vote's weight. Votes are weighted back to the labels' shares among all labelled documents."""

    sample: int = 2500
    size: int = 96
    neighbours: int = 25
    power: float = 8.0
    threshold: float = 0.7
    seed: int = 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of a batch, ordered by row and feature; a row without words has none."""
    words = split_words(texts)
    raw = np.frombuffer(words.data, np.uint8)
    count, rows = len(texts), words.rows
    total = words.counts
    safe = np.maximum(total, 1)
    pieces = [(words.hashes % np.uint64(_WORDS)).astype(np.int64)]
    pieces.append(_LAST + raw[words.ends - 1].astype(np.int64))
    pieces.append(_FIRST + raw[words.starts].astype(np.int64))
    at = np.concatenate([rows * SIZE + p for p in pieces])
    keys, times = np.unique(at, return_counts=True)
    row, feature = keys // SIZE, keys % SIZE
    weight = 1 + np.log(times)
    # Marks of form, each one of a few steps.
    distinct = np.bincount(np.unique(rows * (1 << 32) + (words.hashes >> np.uint64(32)).astype(np.int64)) >> 32, minlength=count)
    mean = np.bincount(rows, weights=words.ends - words.starts, minlength=count) / safe
    lines = [(t or "").split("\n") for t in texts.to_pylist()]
    fresh = np.array([len(set(x)) / len(x) for x in lines]) if count else np.zeros(0)
    per_line = np.log2(safe / np.array([len(x) for x in lines])) if count else np.zeros(0)
    marks = [np.log2(safe), distinct / safe * (_STEPS - 1), mean, fresh * (_STEPS - 1), np.maximum(per_line, 0)]
    full = np.flatnonzero(total)
    for k, mark in enumerate(marks):
        step = np.minimum(mark[full], _STEPS - 1).astype(np.int64)
        row = np.concatenate([row, full])
        feature = np.concatenate([feature, _FORM + k * _STEPS + step])
        weight = np.concatenate([weight, np.full(len(full), 3.0)])
    order = np.lexsort((feature, row))
    return row[order], feature[order], weight[order]


@dataclass(frozen=True)
class Model:
    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, texts: pa.Array) -> np.ndarray:
        """Unit vectors of texts; zeros for a text without words."""
        row, feature, weight = bags(texts)
        out = np.zeros((len(texts), self.directions.shape[1]), np.float32)
        scaled = (weight * self.rarity[feature]).astype(np.float32)
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        for n in range(len(texts)):
            part = slice(first[n], first[n + 1])
            out[n] = scaled[part] @ self.directions[feature[part]]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def scores(self, texts: pa.Array, options: QualityVote) -> np.ndarray:
        """Share of the neighbours' weight that has label 1."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.full(len(texts), self.prior)
        k = min(options.neighbours, len(self.labels))
        vectors = self.project(texts)
        for at in range(0, len(texts), 512):
            near = vectors[at : at + 512] @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** options.power
            votes *= self.weights[best]
            total = votes.sum(axis=1)
            good = total > 0
            part = out[at : at + 512]
            part[good] = ((votes * self.labels[best]).sum(axis=1)[good] / total[good]).clip(0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, options: QualityVote = QualityVote()) -> Model:
    """Learn from the labelled documents that are not held out.

    Of each label the ``sample`` documents with the smallest hash of their id are taken; shares of
    the labels are counted over all labelled documents. Without labels every score is 1.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    shares = {r.quality: r["count"] for r in marked.groupBy("quality").count().collect()}
    if not shares:
        return Model(np.zeros(SIZE), np.zeros((SIZE, 1), np.float32), np.zeros((0, 1)), np.zeros(0), np.zeros(0), 1.0)
    order = F.xxhash64("doc_id", F.lit(options.seed))
    picked = [
        marked.where(F.col("quality") == q).orderBy(order, "doc_id").limit(options.sample) for q in sorted(shares)
    ]
    picked = picked[0] if len(picked) == 1 else picked[0].union(picked[1])

    def bagged(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, feature, weight = bags(batch.column("text"))
        at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.string()), batch.column("quality"),
                pa.ListArray.from_arrays(at, pa.array(feature, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(weight, pa.float32())),
            ],
            names=["doc_id", "quality", "features", "weights"],
        )

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = map_slices(texts, bagged, "doc_id string, quality int, features array<int>, weights array<float>")
    table = found.toArrow().sort_by("doc_id")
    quality = table["quality"].to_numpy().astype(np.float64)
    bag = np.zeros((len(quality), SIZE), np.float32)
    for n, (f, w) in enumerate(zip(table["features"], table["weights"], strict=True)):
        bag[n, f.values.to_numpy()] = w.values.to_numpy()
    rarity = np.log((1 + len(bag)) / (1 + (bag > 0).sum(axis=0))) + 0.1
    scaled = bag * rarity.astype(np.float32)
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
    directions = _leading(scaled, options)
    vectors = scaled @ directions
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    taken = {q: max(1, int((quality == q).sum())) for q in (0, 1)}
    weights = np.where(quality == 1, shares.get(1, 0) / taken[1], shares.get(0, 0) / taken[0])
    prior = shares.get(1, 0) / sum(shares.values())
    return Model(rarity, directions, vectors.astype(np.float32), quality, weights, prior)


def _leading(rows: np.ndarray, options: QualityVote) -> np.ndarray:
    """Leading right singular directions, by subspace iteration."""
    size = max(1, min(options.size, *rows.shape))
    basis = np.random.default_rng(options.seed).normal(size=(rows.shape[1], size + 8)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :size], np.float32)


def score(
    docs: DataFrame,
    model: Model,
    options: QualityVote = QualityVote(),
    columns: tuple[str, ...] = ("doc_id",),
    keep_text: bool = False,
) -> DataFrame:
    """``columns`` of every row of ``docs`` (and ``text``), with ``score`` (0 to 1) and ``predicted``.

    Only the text decides, so equal texts have equal scores. A null text, and one without words, has
    the share of label 1 among the labelled documents. The text goes to the Python worker once, so it
    doesn't belong in ``columns`` too.
    """
    kept = docs.select(F.struct(*columns).alias("row"), F.col("text"))
    names = ["row", "text", "score"] if keep_text else ["row", "score"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array(model.scores(batch.column("text"), options))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), scores], names=names)

    kind = kept.schema["row"].dataType.simpleString()
    scored = map_slices(kept, run, f"row {kind}, {'text string, ' if keep_text else ''}score double", size=WORD_SLICE_BYTES)
    predicted = (F.col("score") >= options.threshold).cast("int").alias("predicted")
    return scored.select("row.*", *names[1:], predicted)
