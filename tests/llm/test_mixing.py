import random
from collections import defaultdict

import pytest

from folioforge.llm import mixing

RNG = random.Random(6)


def fill(sizes):
    """Targets by resharing the excess until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 30, None: 5}, {"x": 7}, {"a": 0, "b": 0}, {"a": 0, "b": 5, "c": 90}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = fill(sizes)
    assert got == {s: pytest.approx(t, abs=1e-6) for s, t in want.items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_come_near_the_targets(spark, frame):
    rows, n = [], 0
    for source, count in (("a", 900), ("b", 300), ("c", 60), (None, 200)):
        for _ in range(count):
            rows.append((n, " ".join(["w"] * RNG.choice([3, 10, 40, 90])), "en", source))
            n += 1
    docs = frame(rows, 5)
    out = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(n))
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        share = r["target"] / r["source_size"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert int(share) <= r["copies"] <= int(share) + 1
    for s in target:
        assert abs(taken[s] - target[s]) <= 200, (s, taken[s], target[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    other = mixing.mix(docs, seed="other").collect()
    assert sorted(map(str, other)) != sorted(map(str, out))


def test_inclusion_is_proportional(spark, frame):
    """Over many seeds each document of a source is rounded up about as often as the fraction says."""
    rows = [(i, "w w w w", "en", "a" if i < 20 else "b") for i in range(26)]
    docs = frame(rows).cache()
    ups = defaultdict(int)
    for k in range(25):
        for r in mixing.mix(docs, seed=str(k)).collect():
            ups[r["source"]] += r["copies"]
            assert r["copies"] <= 3
    assert ups["a"] == 25 * 9 or abs(ups["a"] / 25 - 104 / 3 / 4) < 0.5


def test_edges(spark, frame, clashing):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "w " * 50_000), (5, "a b"), (5, "a b"), (None, "c d"), (6, "e f", "en", None)]
    docs = clashing(frame(rows).drop("size"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert all(r["taken"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    kept = mixing.mix_rows(docs)
    assert sum(r["taken"] for r in kept.collect()) == sum(r["taken"] for r in out)
    assert mixing.mix(frame(rows).limit(0)).count() == 0
    assert mixing.mix(frame([(1, None), (2, "")])).count() == 2


def test_rows_that_repeat_are_dealt_over_blocks(spark, frame):
    """3,000 copies of one row, a third of all, don't meet in one block, and the sum is kept."""
    rows = [(1, "one two three", "en", "a")] * 3000 + [(i, "some words here", "en", "b") for i in range(6000)]
    docs = frame([(d, t, lang, s) for d, t, lang, s in rows])
    got = mixing.mix(docs)
    by = {}
    for r in got.collect():
        n, taken, _ = by.get(r["source"], (0, 0, 0))
        by[r["source"]] = (n + 1, taken + r["taken"], r["target"])
    assert {k: v[0] for k, v in by.items()} == {"a": 3000, "b": 6000}
    assert all(abs(taken - target) <= 6 for _, taken, target in by.values())


def test_one_text_under_two_sources(spark, frame):
    """Each row keeps its own source's numbers, and rows that differ in other columns alone are told apart."""
    docs = frame([(1, "one two three", "en", "a"), (1, "one two three", "en", "b"), (1, "one two three", "de", None), (2, "w " * 30, "en", "b"), (3, "w " * 60, "en", None)])
    sizes = {"a": 3, "b": 33, None: 63}
    for seed in ("mix", "1", "2", "3"):
        taken = {(r["doc_id"], r["source"]): r for r in mixing.mix(docs, seed).collect()}
        rows = mixing.mix_rows(docs, seed).collect()
        assert {(r["doc_id"], r["source"]): r["copies"] for r in rows} == {k: r["copies"] for k, r in taken.items() if r["copies"]}
        assert all(r["source_size"] == sizes[r["source"]] and r["taken"] == r["size"] * r["copies"] and r["target"] == taken[r["doc_id"], r["source"]]["target"] for r in rows)
    repeated = frame([(1, "a b c", lang, "s") for lang in ("en", "de", "fr")])
    first = sorted(map(tuple, mixing.mix_rows(repeated).collect()))
    assert len(first) == 3 and first == sorted(map(tuple, mixing.mix_rows(repeated.repartition(5)).collect()))
