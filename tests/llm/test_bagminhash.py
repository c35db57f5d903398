import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_pipeline import shingles

from articleflow.llm import bagminhash
from articleflow.llm.bagminhash import NearDuplicates
from articleflow.llm.wordhash import shingles as hashed
from articleflow.llm.wordhash import split_words, weighted


def brute(rows):
    """Class ids by comparing every two distinct texts."""
    bags = {t: shingles(t) for i, t in rows if i is not None and shingles(t)}
    texts, label = list(bags), {t: t for t in bags}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            both = sum((bags[a] & bags[b]).values())
            if both / sum((bags[a] | bags[b]).values()) >= 0.8:
                label[root(a)] = root(b)
    low = {}
    for i, t in rows:
        if i is not None and t in label:
            low[root(t)] = min(i, low.get(root(t), i))
    same = {tuple(sorted(bags[t].items())): t for t in texts}
    out = []
    for i, t in rows:
        t = same.get(tuple(sorted(shingles(t).items()))) if t else t
        class_id = low[root(t)] if t in label else (None if shingles(t) else i)
        out.append((i, class_id, class_id == i and i is not None))
    return Counter(out)


def check(spark, rows, options=NearDuplicates()):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, node int")
    got = Counter(tuple(r) for r in bagminhash.near_duplicates(docs, options).collect())
    assert got == brute(rows)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in words)


@pytest.mark.parametrize("options", [NearDuplicates(), NearDuplicates(tile=8, shingles=900, rows=4)])
def test_classes_equal_brute_force(spark, options):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))] for _ in range(12)]
    # A crowd whose texts are near the threshold of each other, so that buckets keep several components.
    rows = [(1000 + k, edited(rng, base[0], 0.025)) for k in range(120)]
    rows += [(k, edited(rng, base[k % 12], 0.01 * (k % 4))) for k in range(200)]
    rows += [(2000 + k, rows[k][1]) for k in range(0, 60, 3)]
    check(spark, rows, options)


def test_odd_rows(spark):
    one, two = " ".join(f"one{i}" for i in range(40)), " ".join(f"two{i}" for i in range(40))
    rows = [(None, one), (None, None), (None, "never seen elsewhere at all"), (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "a b"), (6, "b a")]
    rows += [(8, one), (9, one), (9, two), (9, two), (10, two.replace("two39", "x")), (7, "w " * 3000), (7, "w " * 3001)]
    rows += [(11, "q" * 300_000 + " " + one)] + [(12, one)] * 50
    check(spark, rows)
    check(spark, [])


def test_registers_agree_as_often_as_multisets_are_similar():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), edited(rng, words, 0.03), edited(rng, words, 0.1), " ".join(words * 2), " ".join(words[:150] * 3)]
    count, registers = len(texts), 2048
    hashes, rows, times = weighted(*hashed(split_words(pa.array(texts)), 5))
    values = bagminhash.signatures(hashes, rows, times, count, registers)
    bags = [shingles(t) for t in texts]
    for a in range(count):
        for b in range(a):
            true = sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())
            assert abs(np.mean(values[a] == values[b]) - true) < 5 * (0.25 / registers) ** 0.5


def test_points_drawn_ahead_change_no_signature(monkeypatch):
    """Texts of one shingle and of many, heavy ones too: one point at a time gives the same registers."""
    rng = np.random.default_rng(11)
    sizes = [1, 2, 0, 700, 5, 1, 90]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    hashes = rng.integers(0, 1 << 63, len(rows)).astype(np.uint64)
    times = rng.choice([1, 1, 1, 2, 9], len(rows))
    ahead = bagminhash.signatures(hashes, rows, times, len(sizes), 64)
    monkeypatch.setattr(bagminhash, "AHEAD", 1)
    rounds = []
    drawn = bagminhash._points
    monkeypatch.setattr(bagminhash, "_points", lambda *x: rounds.append(1) or drawn(*x))
    one = bagminhash.signatures(hashes, rows, times, len(sizes), 64)
    assert (ahead == one).all() and len(rounds) > 200
    monkeypatch.undo()
    few = []
    monkeypatch.setattr(bagminhash, "_points", lambda *x: few.append(1) or drawn(*x))
    bagminhash.signatures(hashes, rows, times, len(sizes), 64)
    assert len(few) < len(rounds) / 10
