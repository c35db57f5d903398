import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from articleflow.llm import vector_codes
from articleflow.llm.vector_codes import VectorCodes

SCHEMA = "vec_id long, embedding array<double>, label int, code int, x string, near string"


def brute(rows, options):
    """The report by measuring every part against every entry in Python's integers."""
    kept = [(i, [math.floor(256 * c) for c in v], g) for i, v, g in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for length in {len(x) for _, x, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = [length * p // options.parts for p in range(options.parts + 1)]
        parts = [[x[cut[p] : cut[p + 1]] for _, x, _ in own] for p in range(options.parts)]
        books = [[list(v) for v in part[: options.entries]] for part in parts]

        def assign(p):
            return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p])) for v in parts[p]]  # noqa: B023

        for _ in range(options.rounds):
            for p in range(options.parts):
                groups = defaultdict(list)
                for v, (_, e) in zip(parts[p], assign(p), strict=True):
                    groups[e].append(v)
                for e, vs in groups.items():
                    books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        best = [assign(p) for p in range(options.parts)]
        digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
        for k, (i, _, g) in enumerate(own):
            code = "".join(f"{best[p][k][1]:02x}" for p in range(options.parts))
            out.append([i, code, sum(best[p][k][0] for p in range(options.parts)), g, digest])
    sums = defaultdict(int)
    for r in out:
        sums[r[3]] += r[2]
    fit = lambda v: v if v < 1 << 63 else None
    return sorted([(i, code, fit(far), fit(sums[g]), digest) for i, code, far, g, digest in out], key=str)


def check(spark, rows, options=VectorCodes()):
    table = spark.createDataFrame([(*r, 1, "x", "n") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in vector_codes.report(table, options).collect()), key=str)
    assert got == brute(rows, options)
    return got


def rows_of(seed, count, length, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, length))
    vectors = centres[rng.integers(0, 9, count)] + rng.normal(size=(count, length)) * spread
    return [(int(i), v.tolist(), int(g) if g else None) for i, v, g in zip(rng.permutation(count), vectors, rng.integers(0, 4, count), strict=True)]


@pytest.mark.parametrize(("length", "spread", "options"), [
    (32, 0.1, VectorCodes()),
    (32, 1.0, VectorCodes(parts=4, rounds=4, kept=4, least=1)),
    (20, 0.02, VectorCodes(parts=3, entries=40, rounds=3, kept=20, least=2, rare=0.5)),
    (8, 0.5, VectorCodes(parts=16, entries=5, kept=16)),
    (6, 0.003, VectorCodes(parts=2, entries=64, kept=2, rounds=3)),
])
def test_equal_to_brute_force(spark, length, spread, options):
    rows = rows_of(length, 300, length, spread)
    check(spark, rows + rows[:20], options)


def test_odd_rows(spark):
    odd = [
        (1, None, 1), (2, [], None), (3, [float("nan")] * 16, 1), (4, [None] + [1.0] * 15, 1), (5, [float("inf")] * 16, 2),
        (None, [0.5] * 16, None), (6, [0.0] * 16, 1), (6, [0.5] * 16, 1), (7, [1.0, -1.0], 2), (8, [1e300] * 16, 9), (9, [-3e5] * 16, 9),
    ]
    rows = [r for r in odd * 2 if r[0] != 8]
    got = check(spark, rows + rows_of(3, 100, 16))
    assert len(got) == 100 + 2 * 6
    assert check(spark, []) == []
    table = spark.createDataFrame([(*r, 1, "x", "n") for r in odd], SCHEMA)
    made = {r.vec_id: r for r in vector_codes.report(table).collect() if r.vec_id}
    # Floors beyond a long are its bound; an entry of its own leaves no error.
    assert made[8].error == 0 and made.keys() == {2, 6, 7, 8, 9}


def test_bounds_spare_most_of_the_work():
    rng = np.random.default_rng(4)
    options = VectorCodes()
    x = np.floor(rng.normal(size=(3000, 64)) * 60).astype(np.int64)
    books = [x[:64, 4 * p : 4 * p + 4] for p in range(16)]
    near, low, _, _ = vector_codes.assign_anew(x, books, 16, options)
    moved = [b + rng.integers(-2, 3, b.shape) for b in books]
    moves = vector_codes._moves({64: books}, {64: moved})[64]
    again, bounds, far, needed = vector_codes.assign_again(x, moved, moves, near, low, 16, options)
    full, _, exact, _ = vector_codes.assign_anew(x, moved, 16, options)
    assert (again[:, :, 0] == full[:, :, 0]).all() and (far == exact).all()
    assert (needed <= 16).mean() > 0.9
    # Stored bounds stay below the true distances, that of the outer ones too.
    for p in range(16):
        d = np.sqrt(vector_codes.squares(x[:, 4 * p : 4 * p + 4], moved[p]).astype(float)) * 16
        listed = np.take_along_axis(d, again[:, p, 1:].astype(int), 1)
        assert (bounds[:, p, :-1] <= listed + 1e-6).all()
        np.put_along_axis(d, again[:, p].astype(int), np.inf, 1)
        assert (bounds[:, p, -1] <= d.min(axis=1) + 1e-6).all()


def test_sql_states_the_same(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    want = sorted(con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.oracle()})").fetchall())
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted(map(tuple, vector_codes.report(table).collect())) == want
