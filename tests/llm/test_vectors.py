import numpy as np
from pyspark.sql import functions as F

from articleflow.llm import cell_dedup, cross_polytope
from articleflow.llm.cell_dedup import CellDedup

SCHEMA = "vec_id long, embedding array<double>, label int"
ODD = [
    (1, None), (2, []), (3, [0.0] * 8), (4, [None] + [1.0] * 7), (5, [float("nan")] + [1.0] * 7),
    (6, [float("inf")] + [1.0] * 7), (7, [1.0] * 3), (8, [1e300] * 8), (9, [1e-300] * 8), (None, [1.0] * 8),
]


def rows_of(seed, count, near):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, 8))
    close = base[: near] + rng.normal(size=(near, 8)) * 0.12
    crowd = base[0] + rng.normal(size=(near * 3, 8)) * 0.1
    vectors = np.concatenate([base, close, crowd, base[:5], base[5:9] * 3])
    return [(100 + k, v.tolist()) for k, v in enumerate(vectors)]


def good(rows):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and i not in range(1, 8)]


def test_cells_equal_brute_force(spark):
    rows = ODD + rows_of(3, 300, 60)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("n_links", F.lit("x"))
    options = CellDedup(block=64, nearest=8, threshold=0.97)
    got = {r.vec_id: r for r in cell_dedup.near_duplicates(table, options).collect()}
    ids = [i for i, _ in good(rows)]
    unit = np.array([v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v in good(rows)])
    linked = unit @ unit.T >= 0.97
    np.fill_diagonal(linked, False)
    parent = {i: i for i in ids}
    for _ in ids:
        changed = {i: min([parent[i]] + [parent[ids[j]] for j in np.flatnonzero(linked[k])]) for k, i in enumerate(ids)}
        if changed == parent:
            break
        parent = changed
    found = sum(got[i].n_links for i in ids)
    assert 0.99 * linked.sum() <= found <= linked.sum()
    exact = 0
    for k, i in enumerate(ids):
        assert got[i].n_links <= linked[k].sum()
        assert got[i].kept == (got[i].component_id == i)
        exact += got[i].component_id == parent[i]
    assert exact >= 0.98 * len(ids)
    for i in range(1, 8):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)


def test_links_of_a_crowd_are_all_counted(spark):
    rng = np.random.default_rng(8)
    base, centre = rng.normal(size=(6000, 64)) / 8, rng.normal(size=64) / 8
    vectors = np.concatenate([base, centre + rng.normal(size=(3000, 64)) * 0.0227])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert linked.max() > 2500
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    got = {r.vec_id: r for r in cell_dedup.near_duplicates(table).collect()}
    assert [got[i].n_links for i in range(len(vectors))] == linked.tolist()
    assert sum(r.kept for r in got.values()) == (linked == 0).sum() + 1


def mixed_lengths(seed, counts):
    """Vectors of several lengths, a third of each near one direction, ids in turns."""
    rng, out = np.random.default_rng(seed), []
    for length, count in counts:
        base, centre = rng.normal(size=(count - count // 3, length)), rng.normal(size=length)
        crowd = centre + rng.normal(size=(count // 3, length)) * 0.15
        out += [v for v in np.concatenate([base, crowd])]
    order = rng.permutation(len(out))
    return [(int(order[k]), v) for k, v in enumerate(out)]


def test_links_of_every_length_are_counted(spark):
    rows = mixed_lengths(4, [(12, 700), (5, 400), (2, 30), (1, 3)])
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], SCHEMA)
    got = {r.vec_id: r for r in cell_dedup.near_duplicates(table, CellDedup(block=16)).collect()}
    for length in (12, 5, 2, 1):
        ids = [i for i, v in rows if len(v) == length]
        unit = np.array([v / np.linalg.norm(v) for _, v in rows if len(v) == length])
        linked = unit @ unit.T >= 0.95
        np.fill_diagonal(linked, False)
        assert [got[i].n_links for i in ids] == linked.sum(axis=1).tolist()
        best = np.array(ids)
        for _ in ids:
            least = np.where(linked, best, len(rows)).min(axis=1)
            best = np.minimum(best, least)
        assert [got[i].component_id for i in ids] == best.tolist()
        assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_every_length_is_searched(spark):
    rows = mixed_lengths(6, [(12, 300), (5, 200), (2, 15), (1, 1)])
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], SCHEMA)
    options = cross_polytope.CrossPolytope(neighbours=20, block=64, queries_block=4)
    got, hits, wanted = {}, 0, 0
    for r in cross_polytope.search(table, F.col("vec_id") % 20 == 0, options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for length in (12, 5, 2, 1):
        same = [(i, v) for i, v in rows if len(v) == length]
        for q, found in nearest(same, [(i, v) for i, v in same if i % 20 == 0], 20).items():
            assert len(got.get(q, [])) == len(found)
            hits += len({i for _, i in found} & set(got.get(q, [])))
            wanted += len(found)
    assert hits >= 0.9 * wanted > 0


def test_equal_scores_go_to_smaller_ids(spark):
    """Forty copies of one vector tie at the last rank."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(40)] + [(100 + i, [-1.0, 0.0, float(i)]) for i in range(5)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in cross_polytope.search(table, F.col("vec_id") == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: list(range(1, 21))}


def test_no_vectors(spark):
    for rows in ([], [(1, None, 0)]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert cell_dedup.near_duplicates(table).count() == len(rows)
        assert cross_polytope.search(table, F.col("vec_id") % 20 == 0).count() == 0


def nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float((v * w).sum()), i) for i, w in rows if i != q)
        out[q] = scored[:k]
    return out


def test_search_of_few_rows_is_exact(spark):
    rows = ODD[:7] + rows_of(5, 12, 2)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows] * 2, SCHEMA).withColumn("rank", F.lit(1))
    want = nearest(good(rows), [(i, v) for i, v in good(rows) if i % 20 == 0], 200)
    options = cross_polytope.CrossPolytope(neighbours=200, probes=1)
    got = {}
    for r in cross_polytope.search(table, F.col("vec_id") % 20 == 0, options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for _, i in want[q]]
        assert np.allclose([s for _, s in found], [-s for s, _ in want[q]], rtol=1e-12)


def test_cells_are_found_once_per_vector(spark):
    """They come with the vectors' rows, not anew in every block; the result is that of all met rows scored one by one."""
    options = cross_polytope.CrossPolytope(neighbours=6, tables=2, probes=3, block=50, queries_block=4)
    rows = mixed_lengths(7, [(12, 300), (5, 200)])
    rows += [(len(rows) + k, rows[k][1]) for k in range(0, 200, 10)]  # copies, with ties
    table = spark.createDataFrame([(i, v.tolist(), i % 20 == 0) for i, v in rows], "id long, vector array<double>, query boolean")
    turned = {r.id: r for r in cross_polytope.with_cells(table, options).collect()}
    assert len(turned) == len(rows)
    want = []
    for q, v in rows:
        assert bool(turned[q].probes) == (q % 20 == 0) and len(turned[q].cells) == options.tables
        probes = set(turned[q].probes)
        assert q % 20 or set(turned[q].cells) <= probes
        met = [(-float((w * v).sum()), i) for i, w in rows if i != q and len(w) == len(v) and probes & set(turned[i].cells)]
        if q % 20 == 0 and len(met) >= options.neighbours:
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(met)[: options.neighbours])]
    assert want
    found = cross_polytope.search(table, F.col("query"), options, "id", "vector").collect()
    assert set(want) <= {tuple(r) for r in found}


def test_close_and_huge_products_stay():
    """Rows that rounding may put among the best stay, and all met rows where products are not finite."""
    rows = np.array([[1.0, 1.0], [1.0, 1.0 + 2e-16], [1.0, 0.9], [5.0, 5.0]])
    met = np.array([[True, True, True, False]])
    assert cross_polytope.may_be_best(np.ones((1, 2)), rows, met, 1).tolist() == [[True, True, False, False]]
    huge = cross_polytope.may_be_best(np.full((1, 2), 1e300), rows * 1e300, met, 1)
    assert huge.tolist() == met.tolist()


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    want = nearest(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    hits = 0
    for r in cross_polytope.search(table, F.col("vec_id") % 20 == 0).collect():
        hits += r.vec_id in {i for _, i in want[r.query_id]}
    assert hits >= 0.95 * 20 * len(want)
