from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from segqa.llm import lattice


def cosines(vectors):
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def brute_force(ids, vectors, least):
    near = cosines(vectors) >= least
    np.fill_diagonal(near, False)
    component = dict(zip(ids, ids, strict=True))
    for _ in ids:
        for a, b in zip(*np.nonzero(near), strict=True):
            component[ids[a]] = component[ids[b]] = min(component[ids[a]], component[ids[b]])
    return near, component


def around(rng, centre, cosine):
    z = rng.standard_normal(len(centre))
    z -= (z @ centre) * centre
    z /= np.linalg.norm(z)
    return cosine * centre + np.sqrt(1 - cosine**2) * z


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    around_zero = np.concatenate([np.zeros((1, 8)), lattice.minimal_vectors()])
    assert lattice.minimal_vectors().shape == (240, 8) and np.allclose((lattice.minimal_vectors() ** 2).sum(axis=1), 2)
    x = rng.standard_normal((300, 8)) * 3
    near = lattice.nearest_e8(x)
    doubled = np.rint(2 * near)
    assert np.array_equal(doubled, 2 * near) and (np.ptp(doubled % 2, axis=1) == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    best = ((x[:, None, :] - (near[:, None, :] + around_zero)) ** 2).sum(axis=2).argmin(axis=1)
    assert (best == 0).all()


def test_recall_at_the_threshold_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(150):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        vectors += [centre, around(rng, centre, rng.uniform(0.88, 0.93))]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    near, _ = brute_force(list(range(len(rows))), vectors, 0.9)
    got = {r.id: r.n_links for r in lattice.near_duplicates(table(spark, rows), "vec_id", "embedding").collect()}
    expected = near.sum(axis=1)
    assert all(got[i] <= expected[i] for i in got)
    assert sum(got.values()) >= 0.95 * expected.sum() > 100


def test_crowds_and_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    vectors = [around(rng, centre, 0.99) for _ in range(60)] + [centre] * 40 + [rng.standard_normal(64) for _ in range(60)]
    ids = [1000 - i for i in range(len(vectors))]
    got = {r.id: r for r in lattice.near_duplicates(table(spark, [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)]), "vec_id", "embedding").collect()}
    near, component = brute_force(ids, vectors, 0.9)
    for n, i in enumerate(ids):
        assert (got[i].n_links, got[i].component) == (near[n].sum(), component[i])
        assert got[i].kept == (component[i] == i)


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, one), (8, [2.0, 0.0, 0.0]),
        (9, [1.0, 0.0]), (None, one), (7, one), (10, [1e38, 1e38, 0.0]), (11, [-1.0, 0.0, 0.0]), (None, None), (12, [1e-38, 0.0, 0.0]),
    ]
    got = lattice.near_duplicates(table(spark, rows), "vec_id", "embedding").collect()
    by_id = {r.id: (r.n_links, r.component, r.kept) for r in got}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 9, 10, 11):
        assert by_id[i] == (0, i, True)
    assert by_id[7] == (4, 7, True) and by_id[8] == (4, 7, False) and by_id[12] == (4, 7, False)
    assert sorted((r.n_links, r.component, r.kept) for r in got if r.id is None and r.n_links) == [(4, 7, False)]
    assert lattice.near_duplicates(table(spark, rows).limit(0), "vec_id", "embedding").count() == 0


def test_links_are_never_below_the_threshold(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.standard_normal(6) for _ in range(120)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    near, component = brute_force(list(range(120)), vectors, 0.9)
    got = {r.id: r for r in lattice.near_duplicates(table(spark, rows), "vec_id", "embedding").collect()}
    assert all(got[i].n_links <= near[i].sum() for i in got)
    roots = {i: got[i].component for i in got}
    assert all(component[a] == component[b] for a, b in combinations(range(120), 2) if roots[a] == roots[b])
