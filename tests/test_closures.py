import random

import numpy as np

from folioforge.operators import closures
from folioforge.plans import library
from folioforge.tables import table


def test_cascade_over_levels_and_circles(spark):
    edges = [("doc", 1, "section", 10), ("doc", 1, "section", 11), ("section", 10, "chunk", 100), ("chunk", 100, "vector", 7), ("doc", 2, "section", 12), ("section", 12, "chunk", 101), ("vector", 7, "doc", 1), ("section", 11, "chunk", 100)]
    df = spark.createDataFrame(edges, "owner_kind string, owner_id bigint, kind string, id bigint")
    gone = closures.cascade(df, spark.createDataFrame([("doc", 1), ("doc", 1), ("doc", 9)], "kind string, id bigint"))
    assert {tuple(r) for r in gone.collect()} == {("doc", 1, 0), ("doc", 9, 0), ("section", 10, 1), ("section", 11, 1), ("chunk", 100, 2), ("vector", 7, 3)}
    assert closures.cascade(df, df.select("kind", "id").limit(0)).count() == 0


def test_chains_and_circles_of_aliases(spark):
    rng = random.Random(5)
    links = {f"n{i}": f"n{i + 1}" for i in range(40)} | {"a": "b", "b": "c", "c": "a", "into": "b", "self": "self", "x": "y"}
    links |= {f"m{i}": f"m{rng.randrange(i)}" for i in range(1, 30)}
    rows = [*links.items(), ("x", "z"), (None, "y"), ("q", None)]
    got = {r["old"]: (r["now"], r["steps"], r["circular"]) for r in closures.resolved(spark.createDataFrame(rows, "old string, now string").repartition(3)).collect()}

    def walk(name):
        at, steps, seen = name, 0, set()
        while at in links and at not in seen:
            seen.add(at)
            at, steps = links[at], steps + 1
        return (None, None, True) if at in seen else (at, steps, False)

    assert got == {k: walk(k) for k in links}
    assert got["n0"] == ("n40", 40, False) and got["into"][2] and got["self"][2]
    assert closures.resolved(spark.createDataFrame([], "old string, now string")).count() == 0


def drawn(m):
    """Two principal components by a singular value decomposition, stretched to 0 to 1."""
    centred = m - m.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
    at = centred @ axes
    return (at - at.min(axis=0)) / (at.max(axis=0) - at.min(axis=0))


def test_plane_equals_singular_vectors(spark, monkeypatch):
    monkeypatch.setattr(closures, "FAN", 3)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(200, 6)) * [5, 3, 1, 1, 0.5, 0.1] + 7
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None)], "vec_id bigint, embedding array<double>").repartition(11)
    got = {r["vec_id"]: (r["x"], r["y"]) for r in closures.plane(rows).collect()}
    assert got.pop(900) == (None, None)
    assert np.allclose([got[i] for i in range(200)], drawn(m), atol=1e-6)


def test_plane_of_little(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert closures.plane(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in closures.plane(spark.createDataFrame([(1, [2.0, 3.0])], schema)).collect()] == [(1, 0.5, 0.5)]
    assert sorted(tuple(r) for r in closures.plane(spark.createDataFrame([(1, [2.0]), (2, [4.0])], schema)).collect()) == [(1, 0.0, 0.5), (2, 1.0, 0.5)]


def test_query_equals_singular_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    want = dict(zip((r[0] for r in rows), drawn(np.array([list(r[1]) for r in rows], float)).tolist()))
    got = {r["vec_id"]: (r["x"], r["y"]) for r in library.v3_plane(spark, sf).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=2e-6)


def test_circles_take_no_more_rounds(spark, monkeypatch):
    """Rounds go by the longest chain that ends, not by the number of names, and nothing is broadcast."""
    written, plain = [], closures.materialise
    monkeypatch.setattr(closures, "materialise", lambda df, *a, **b: (written.append(df), plain(df, *a, **b))[1])
    pairs = [(i, i + 1 if i % 10 < 9 else i - 9) for i in range(3000)] + [(10_000 + i, 10_001 + i) for i in range(5)]
    got = {r["old"]: (r["now"], r["steps"], r["circular"]) for r in closures.resolved(spark.createDataFrame(pairs, "old bigint, now bigint")).collect()}
    assert len(written) <= 6
    assert all("BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString() for df in written)
    assert all(got[i] == (None, None, True) for i in range(3000)) and all(got[10_000 + i] == (10_005, 5 - i, False) for i in range(5))
