import numpy as np
import pytest

from folioforge.operators import density
from folioforge.plans import library
from folioforge.tables import table


def hierarchy(ids, vectors, min_size, min_samples=1):
    """Leaf clusters by merging all pairs in order: what a cluster holds when it first meets another."""
    unit = np.asarray(vectors, float)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    d = density.lengths(unit @ unit.T)
    core = np.sort(np.where(np.eye(len(ids), dtype=bool), 0, d), axis=1)[:, min_samples - 1]
    pairs = sorted((max(d[i, j], core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i))
    part = {i: {i} for i in ids}
    inner, out = set(), {}
    for _, a, b in pairs:
        x, y = part[a], part[b]
        if x is y:
            continue
        if len(x) >= min_size and len(y) >= min_size:
            for side in (x, y):
                if id(side) not in inner:
                    out |= {p: min(side) for p in side}
            x = x | y
            inner.add(id(x))
        else:
            both = x | y
            if id(x) in inner or id(y) in inner:
                inner.add(id(both))
            x = both
        keep.append(x)
        for p in x:
            part[p] = x
    return {i: out.get(i, -1) for i in ids}


keep = []  # parts stay alive, so that their ids stay their own


def clustered(spark, ids, vectors, **how):
    rows = spark.createDataFrame([(int(i), v) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>").repartition(3)
    return {r["vec_id"]: r["cluster"] for r in density.density_clusters(rows, **how).collect()}


def blobs(n, groups, seed, dims=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    points = centres[rng.integers(0, groups, n)] + rng.normal(scale=0.15, size=(n, dims))
    points[: n // 6] = rng.normal(size=(n // 6, dims))
    return rng.permutation(10 * n)[:n].tolist(), points.tolist()


@pytest.mark.parametrize("size, samples, block", [(3, 1, 40), (4, 3, 50)])
def test_leaves_equal_the_whole_hierarchy(spark, size, samples, block):
    ids, points = blobs(180, 7, seed=size + samples)
    want = hierarchy(ids, points, size, samples)
    assert clustered(spark, ids, points, min_size=size, min_samples=samples, block_points=block) == want
    assert len(set(want.values())) > 4


def test_equal_points_and_ties(spark):
    base = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.9, 0.1, 0.0], [0.0, 0.9, 0.1]]
    points = [base[i % 5] for i in range(25)]
    ids = list(range(25))
    want = hierarchy(ids, points, 3)
    assert clustered(spark, ids, points, block_points=7) == want
    assert len(set(want.values()) - {-1}) == 5


def test_noise_only_empty_null_and_repeated(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert density.density_clusters(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.9, 0.1])]
    got = density.density_clusters(spark.createDataFrame(rows, schema)).collect()
    assert {(r[0], r[1]) for r in got} == {(1, -1), (2, -1), (3, -1), (4, -1)}
    ids, points = blobs(40, 3, seed=9)
    rows = spark.createDataFrame([(i, p) for i, p in zip(ids, points)] * 2, schema)
    got = density.density_clusters(rows).collect()
    assert len(got) == 80 and {r[0]: r[1] for r in got} == hierarchy(ids, points, 3)


def test_spanning_tree_rounds(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in {(min(x), max(x)): (min(x), max(x), round(rng.random(), 1)) for x in rng.integers(0, 60, (300, 2)).tolist() if x[0] != x[1]}.values()]
    got = {tuple(r) for r in density.spanning_tree(spark.createDataFrame(edges, "a bigint, b bigint, length double")).select("length", "a", "b").collect()}
    part, want = {v: v for e in edges for v in e[:2]}, set()

    def root(v):
        while part[v] != v:
            v = part[v]
        return v

    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if root(a) != root(b):
            part[root(a)] = root(b)
            want.add((w, a, b))
    assert got == want


def test_query_equals_the_whole_hierarchy(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    want = hierarchy([r[0] for r in rows], [list(r[1]) for r in rows], 3)
    assert {r["vec_id"]: r["cluster"] for r in library.m5_clusters(spark, sf).collect()} == want
    assert len(set(want.values())) > 2


def test_large_tables_make_few_copies():
    """A point goes to as many pairs as there are blocks; with blocks of 1,024 these were 98 and 587."""
    assert density._blocks(100_000, density.BLOCK_POINTS) <= 13 and density._blocks(600_000, density.BLOCK_POINTS) <= 74
    assert density._blocks(10_000, density.BLOCK_POINTS) == 8 and density._blocks(3, density.BLOCK_POINTS) == 2


def test_tree_of_one_block_equals_all_pairs():
    """Equal points, equal lengths and core distances; the points are moved up many times."""
    rng = np.random.default_rng(4)
    unit = rng.integers(-2, 3, (300, 3)).astype(float) + [0.5, 0, 0]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids, core = rng.permutation(3000)[:300], rng.integers(0, 3, 300) / 10
    d = np.maximum(np.maximum(density.lengths(unit @ unit.T), core[:, None]), core[None, :])
    part, want = {i: i for i in ids.tolist()}, []
    for length, x, y in sorted((d[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(300) for j in range(i)):
        if part[x] != part[y]:
            want.append((x, y, round(length, 9)))
            old, new = part[x], part[y]
            part = {k: new if v == old else v for k, v in part.items()}
    assert sorted((x, y, round(n, 9)) for x, y, n in zip(*density._tree(ids, unit, core))) == sorted(want)
