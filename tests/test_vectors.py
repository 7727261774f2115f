import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folioforge.operators import lifecycle, vectors


def test_a_block_holds_a_strip_of_its_product():
    """4,096 by 4,096 cosines are 134 MB; a task holds a few strips of 256 queries and its vectors."""
    unit = np.random.default_rng(0).normal(size=(4096, 16)).astype(np.float32)
    block = pa.table({"id": np.arange(4096), "v": pa.array(list(unit), pa.list_(pa.float32()))})
    tracemalloc.start()
    found = vectors._best(block, block, 1, 0.35, True, 1e-9, "vec_id")
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert found.num_rows > 3000


@pytest.mark.parametrize("strip", [7, 256])
def test_parts_are_those_of_all_pairs(spark, monkeypatch, strip):
    monkeypatch.setattr(vectors, "STRIP", strip)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 30)
    m = np.random.default_rng(2).normal(size=(150, 4))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    part = list(range(150))
    for i, j in np.argwhere(unit @ unit.T > 0.93).tolist():
        part = [part[min(i, j)] if x == part[max(i, j)] else x for x in part]
    groups = {}
    for i, x in enumerate(part):
        groups.setdefault(x, []).append(i)
    want = {i: min(g) if len(g) > 2 else -1 for g in groups.values() for i in g}
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(150, None), (151, [0.0] * 4)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in lifecycle.clusters(points, 0.93, 3).collect()}
    assert got == want | {150: -1, 151: -1} and len(set(want.values())) > 3
