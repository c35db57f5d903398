import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from articleflow.llm import catalog, mixing
from articleflow.llm.mixing import Mixing

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    """Targets by the rule as it is written: share, stop, share the excess again."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget = Fraction(3 * sum(sizes.values()), 2)
    target, free = {}, set(names)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            budget -= target[s]
        free -= over
    return sizes, target | {s: weight[s] * level for s in free}


def naive(votes, limits, seats):
    held = [0] * len(votes)
    for _ in range(seats):
        live = [k for k in range(len(votes)) if votes[k] > 0 and held[k] < limits[k]]
        if live:
            held[max(live, key=lambda k: (Fraction(votes[k]) / (2 * held[k] + 1), -k))] += 1
    return held


def test_apportionment_equals_the_highest_quotients():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 12)
        votes = [rng.choice([0, 1, 2, 2, 3, rng.random() * 9, rng.randint(0, 50)]) for _ in range(n)]
        limits = [rng.choice([0, 1, 3, 1000]) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert mixing.apportion(votes, limits, seats) == naive(votes, limits, seats)


def check(spark, rows, options=Mixing(), slack=None):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, rank string, votes string")
    got = [tuple(r) for r in mixing.mix(table, options).collect()]
    assert Counter((i, n) for i, n, *_ in got) == Counter((r[0], words(r[1])) for r in rows)
    sizes, target = brute_targets([r[:3] for r in rows])
    by_source = defaultdict(lambda: [0, 0])
    pairs = {(sizes[s], float(target[s])): s for s in sizes}
    for _, size, source_size, aim, taken in got:
        assert 0 <= taken <= options.repeats * size
        near = min(pairs, key=lambda p: (abs(p[0] - source_size), abs(p[1] - aim)))
        assert near[0] == source_size and abs(near[1] - aim) <= 1e-9 * max(1, aim)
        by_source[near][0] += taken
    for near, (taken, _) in by_source.items():
        same = [s for s in sizes if (sizes[s], float(target[s])) == near]
        shards = sum(-(-(sizes[s] + len(rows)) // options.shard) for s in same)
        assert abs(taken - len(same) * near[1]) <= options.block * (len(same) + shards), near
    return Counter(got)


def rows_of(rng, count):
    # Sizes differ, so that no two sources share size and target by chance.
    return [(k, "w " * rng.randint(0, 300), rng.choice(["a", "b", "c", "c", "c", "é", "😀"]), 1, "r", "v") for k in range(count)]


def test_targets_and_taken_words(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 600)
    once = check(spark, rows)
    assert check(spark, rows[::-1]) == once
    small = Mixing(shard=500, fan=4, block=8)
    assert check(spark, rows, small) == check(spark, random.Random(2).sample(rows, len(rows)), small)


def test_odd_rows(spark):
    odd = [(None, "a b c", None), (1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "w " * 30_000, "y"), (5, "one", "z")]
    odd += [(6, "same words here", "x")] * 400 + [(6, "more same words here", "x")] * 3 + [(None, None, None)] * 2
    rows = [(*r, 0, "", "") for r in odd]
    for options in (Mixing(), Mixing(shard=64, fan=2, block=4)):
        check(spark, rows, options)
    assert check(spark, []) == Counter()
    assert {t for *_, t in check(spark, [(k, None, "x", 0, "", "") for k in range(3)])} == {0}


def test_given_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes, target = brute_targets(rows)
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for r in catalog.op12_source_mix(spark, SF).collect():
        assert (r.source_size, round(r.target, 6)) == (sizes[source[r.doc_id]], round(float(target[source[r.doc_id]]), 6))
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 32
