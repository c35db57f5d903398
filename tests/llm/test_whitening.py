import math

import numpy as np
from pyspark.sql import functions as F

from articleflow.llm import catalog, whitening

SCHEMA = "vec_id long, embedding array<double>, component int, x string"
ODD = [
    (1, None), (2, []), (3, [float("nan"), 1.0, 2.0]), (4, [None, 1.0, 2.0]), (5, [float("-inf"), 0.0, 1.0]),
    (None, [0.5, 0.25, -0.1]), (6, [0.0, 0.0, 0.0]), (6, [0.0, -0.0, 0.001]), (7, [1.0, 2.0]), (8, [1.5, -2.0]), (9, [4.0]),
]


def brute(rows, components=4):
    """Per length: whole vectors of the rows that count, with n, sums, eigenvalues and vectors."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for length in sorted({len(x) for _, x in kept} - {0}):
        own = [(i, x) for i, x in kept if len(x) == length]
        fit = np.array(sorted({tuple(x) for _, x in own}), float)
        n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
        centred = fit - fit.mean(axis=0)
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        for i, x in own:
            far = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            for k in range(len(values)):
                if values[k] > 1e-12 * max(values[0], 1e-300):
                    score = (np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])
                    out.append((i, k + 1, n, far, abs(score), values[k] / np.trace(centred.T @ centred / n)))
    return sorted(out, key=str)


def check(spark, rows):
    table = spark.createDataFrame([(i, v, 0, "y") for i, v in rows], SCHEMA)
    got = whitening.whiten(table).collect()
    want = brute(rows)
    made = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=str)
    key = lambda r: (str(r[0]), r[1], r[3], r[4])
    for a, b in zip(sorted(made, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-7, atol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)
    return got


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(100 + k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 8)) * np.arange(1, 9) / 4)]
    got = check(spark, rows + [(i + 1000, v) for i, v in rows[:50]] * 3)
    assert len(got) == (400 + 150) * 4 and {r.n for r in got} == {len({tuple(np.floor(np.array(v) * 256)) for _, v in rows})}
    signs = {}
    for r in got:
        signs.setdefault((r.vec_id % 1000, r.component), set()).add(round(r.whitened, 9))
    assert all(len(v) == 1 for i, v in signs.items() if i[0] < 150)


def test_odd_rows(spark):
    got = check(spark, ODD * 2)
    # One distinct vector, or an empty one, has no component; two have one.
    assert {r.vec_id for r in got} == {None, 6, 7, 8} and {r.component for r in got if r.vec_id == 7} == {1}
    assert check(spark, []) == [] and check(spark, [(1, [0.5, 0.5])] * 5) == []
    far = spark.createDataFrame([(k, [1e300 * (-1) ** k, float(k)], 0, "") for k in range(5)], SCHEMA)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(i, k): (n, far, score, share) for i, k, n, far, score, share in brute(rows)}
    got = catalog.op11_whitening(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n, far, score, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, far) and abs(abs(r.whitened) - score) < 1e-8 and abs(r.explained - share) < 1e-9


def test_eigenpairs(spark):
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 9, 40):
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for spectrum in (rng.uniform(0, 9, size), np.ones(size), np.zeros(size), np.where(np.arange(size) < 3, 5.0, 1.0), 10.0 ** -np.arange(size)):
            for matrix in (turn @ np.diag(spectrum) @ turn.T, np.diag(spectrum)):
                matrix = (matrix + matrix.T) / 2
                values, vectors = whitening.leading(matrix, 4)
                top = max(spectrum.max(), 1e-300)
                assert np.allclose(values / top, np.sort(spectrum)[::-1][:4] / top, atol=1e-13)
                assert np.allclose(matrix @ vectors.T / top, vectors.T * values / top, atol=1e-12)
                assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)


def test_other_columns_play_no_part(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, whitening.whiten(table).collect()))
    wide = table.withColumns({c: F.lit(7) for c in ("id", "x", "length", "whitened", "vector", "n")})
    assert sorted(map(tuple, whitening.whiten(wide).collect())) == plain
