import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import neardup


@pytest.mark.parametrize("block", [512, 24])
def test_every_pair_of_a_bucket_is_judged(spark, monkeypatch, block, weighted):
    """All pairs of one bucket that are alike end in one component, whoever led it and however it is cut into blocks."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(70):  # about 0.5 alike among each other
        own = list(base)
        for i in rng.sample(range(120), 9):
            own[i] = rng.choice(words)
        near = list(own)
        near[rng.randrange(40, 80)] = "changed"
        near[rng.randrange(80, 120)] = "words"
        texts += [" ".join(own), " ".join(near)]
    rows = dict(enumerate(texts))
    drawn = neardup.sketches
    # one bucket for all, whatever the bands draw
    one = lambda *a, **b: drawn(*a, **b).withColumn("keys", F.array(F.lit(1).cast("bigint")))
    monkeypatch.setattr(neardup, "sketches", one)
    monkeypatch.setattr(neardup, "BLOCK", block)
    frame = spark.createDataFrame(list(rows.items()), "tid bigint, text string")
    got = {r["v"]: r["c"] for r in neardup.components(neardup.links(frame, agree=0)).collect()}

    parent = {i: i for i in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    similarity = weighted(texts)
    alike = [(i, j) for i in rows for j in rows if i < j and similarity(i, j) >= 0.8]
    assert len(alike) >= 20
    for i, j in alike:
        x, y = sorted((top(i), top(j)))
        parent[y] = x
    assert {i: got.get(i, i) for i in rows} == {i: top(i) for i in rows}


def test_block_plan_meets_every_pair_once(spark, monkeypatch):
    """Each pair of members from two components shares exactly one group, and none of the largest component's own does."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    n = 60
    crowded = spark.createDataFrame([(7, 0, t) for t in range(n)] + [(8, 0, t) for t in range(4)], "key bigint, band int, tid bigint")
    labels = spark.createDataFrame([(t, t if t % 3 else 0) for t in range(n)], "v bigint, c bigint")
    sets = spark.createDataFrame([(t, 10) for t in range(n)], "tid bigint, shingles bigint")
    groups = {}
    for r in neardup._dealt(crowded, labels, sets).collect():
        groups.setdefault((r["key"], r["x"], r["y"]), []).append(r)
    met = {}
    for (key, x, y), rows in groups.items():
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                if x == y or a["own"] != b["own"]:
                    pair = (key, *sorted((a["tid"], b["tid"])))
                    met[pair] = met.get(pair, 0) + 1
    want = {(k, i, j) for k, m in ((7, n), (8, 4)) for i in range(m) for j in range(i + 1, m) if (i if i % 3 else 0) != (j if j % 3 else 0)}
    assert want <= met.keys() and set(met.values()) == {1}
