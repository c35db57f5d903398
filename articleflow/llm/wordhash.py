"""Hashes of words and of runs of words for a whole batch of texts at once.

A word is a run of bytes other than space and the control characters 9 to 13. Hashes depend on
nothing but the bytes, so every task and every run computes the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# Bytes hashed at once; nothing that is kept from batch to batch grows with a text.
_CHUNK = 1 << 17
_BLOCK = 1 << 18


def _table(base: int, size: int) -> np.ndarray:
    filled = np.full(size, base & _MASK, np.uint64)
    filled[0] = 1
    return np.multiply.accumulate(filled)


_LOW, _BACK = _table(_BASE, _BLOCK), _table(_INVERSE, _BLOCK)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finalizer of a published generator)."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(place: np.ndarray) -> np.ndarray:
    """The base to the power of a place inside its word; only a very long word needs a second table."""
    most = int(place.max()) if len(place) else 0
    if most < _BLOCK:
        return _LOW[place]
    high = _table(pow(_BASE, _BLOCK, 1 << 64), most // _BLOCK + 1)
    return _LOW[place % _BLOCK] * high[place // _BLOCK]


@dataclass
class Words:
    """Words of a batch in order: hash, row, and byte range in ``data``."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per row, its first word; one more at the end
    data: bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: pa.Array) -> Words:
    """Words of a string column; a null row has none."""
    encoded = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    data = b"\n".join(encoded)
    ends_of_rows = np.cumsum([len(e) + 1 for e in encoded])
    raw = np.frombuffer(data, np.uint8)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = 0
    while at < len(raw):
        # A chunk ends behind a space, so that no word is cut; a longer word makes a longer chunk.
        end, step = min(at + _CHUNK, len(raw)), 64
        while end < len(raw):
            near = np.flatnonzero(_spaces(raw[end : end + step]))
            if len(near):
                end += int(near[0]) + 1
                break
            end, step = min(end + step, len(raw)), step * 2
        hashes, starts, ends = _hashed(raw[at:end])
        parts.append((hashes, starts + at, ends + at))
        at = end
    hashes, starts, ends = (np.concatenate(p) for p in zip(*parts, strict=True))
    rows = np.searchsorted(ends_of_rows, starts, side="right")
    first = np.searchsorted(rows, np.arange(len(encoded) + 1))
    return Words(hashes, rows, starts, ends, first, data)


def _spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of the bytes."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _spaces(raw)
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    if len(raw) < _BLOCK:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _LOW[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _BACK[starts]), starts, ends
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = (raw[~space[1:-1]].astype(np.uint64) + np.uint64(1)) * _power(place)
    return mix(np.add.reduceat(values, first)), starts, ends


def runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of its first word) of every run of ``size`` words inside one row."""
    count = len(words.hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total += words.hashes[j : j + count] * np.uint64(pow(_INVERSE, j + 1, 1 << 64))
    at = np.flatnonzero(words.rows[:count] == words.rows[size - 1 :])
    return mix(total[at], size), at


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the shingles of every row; a row of fewer words has one of all its words."""
    hashes, at = runs(words, size)
    rows = words.rows[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, row in enumerate(short):
            own = words.hashes[words.first[row] : words.first[row + 1]]
            weights = np.array([pow(_INVERSE, j + 1, 1 << 64) for j in range(len(own))], np.uint64)
            extra[k] = (own * weights).sum(dtype=np.uint64)
        hashes = np.concatenate([hashes, mix(extra, 0)])
        rows = np.concatenate([rows, short])
    return hashes, rows


def weighted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) of the distinct hashes of each row, ordered by row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return hashes[at], rows[at], np.diff(np.append(at, len(hashes)))
