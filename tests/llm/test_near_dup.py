import random

import numpy as np
import pytest

from folioforge.llm import neardup

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    words = text.split()
    for i in RNG.sample(range(len(words)), n):
        words[i] = RNG.choice(VOCABULARY)
    return " ".join(words)


def test_classes_equal_brute_force(spark, frame, weighted):
    rows, n = [], 0
    for _ in range(12):
        base = prose(RNG.randint(60, 200))
        rows.append((n, base))
        n += 1
        for _ in range(RNG.randint(0, 6)):
            rows.append((n, RNG.choice([base, base.upper(), edited(base, 1), edited(base, len(base.split()) // 60), edited(base, 12)])))
            n += 1
    hot = prose(150)
    rows += [(n + i, edited(hot, RNG.randint(1, 4))) for i in range(60)]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(rows)).collect()}
    texts = dict(rows)
    assert len({r["class_key"] for r in got.values()}) == len({r["class_id"] for r in got.values()})
    similarity = weighted([texts[d] for d in range(n + 60)])
    parent = {d: d for d in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if similarity(a, b) >= 0.8:
                lo, hi = sorted((top(a), top(b)))
                parent[hi] = lo
    assert {d: got[d]["class_id"] for d in ids} == {d: top(d) for d in ids}
    sizes = {}
    for d in ids:
        sizes[got[d]["class_id"]] = sizes.get(got[d]["class_id"], 0) + 1
    assert all(got[d]["class_size"] == sizes[got[d]["class_id"]] and got[d]["kept"] == (d == got[d]["class_id"]) for d in ids)


def test_edges(spark, frame, clashing):
    a = prose(80)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, a), (4, a), (5, a.replace(" ", "\n")), (6, "one two"), (7, "ONE two"), (None, a), (8, prose(30_000)), (9, "x" * 200_000)]
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in neardup.near_duplicates(clashing(frame(rows))).collect()), key=str)
    assert got == sorted(
        [(1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 4, True), (4, 4, 4, True), (5, 4, 4, False), (6, 6, 2, True), (7, 6, 2, False), (None, 4, 4, False), (8, 8, 1, True), (9, 9, 1, True)], key=str
    )
    kept = neardup.keep_first(clashing(frame(rows)))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "9"]
    assert kept.columns == clashing(frame(rows)).columns
    assert neardup.near_duplicates(frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.6, 0.8, 0.9])
def test_samples_collide_as_weighted_jaccard(share):
    n = 400
    rng = np.random.default_rng(1)
    common = rng.integers(1, 1 << 62, int(n * share), dtype=np.uint64)
    levels = rng.integers(0, 8, n)
    weights = lambda x: np.exp(x / 4)
    sampler = neardup.Sampler(900)
    found = np.concatenate([common, rng.integers(1, 1 << 62, n - len(common), dtype=np.uint64)])
    other = np.concatenate([common, rng.integers(1, 1 << 62, n - len(common), dtype=np.uint64)])
    shifted = levels.copy()
    shifted[: len(common) // 4] += 2
    draws = sampler.draw(np.concatenate([found, other]), np.concatenate([levels, shifted]), np.array([0, n, 2 * n]))
    c = len(common)
    both = np.minimum(weights(levels[:c]), weights(shifted[:c])).sum()
    expected = both / (weights(levels).sum() + weights(shifted).sum() - both)
    assert abs((draws[0] == draws[1]).mean() - expected) < 0.06


def test_null_and_repeated_ids_lose_nothing(spark, frame, clashing):
    """Different texts without an id, or under one id, are documents of their own; copies among them are one class."""
    a, b, c, d, e, g = (prose(70) for _ in range(6))
    rows = [(None, a), (None, b), (None, b.upper()), (None, c), (5, d), (5, e), (5, e), (None, g), (9, g), (9, None), (None, None)]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in neardup.keep_first(clashing(frame(rows))).collect())
    texts = [t for _, t in kept]
    assert len(kept) == 8 and set(texts) >= {a, c, d, e, g} and len({b, b.upper()} & set(texts)) == 1 and ("9", g) in kept
    got = neardup.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["class_key"], []).append(r)
    assert sorted(len(v) for k, v in by.items() if k is not None) == [1, 1, 1, 2, 2, 2]
    assert all(len({(r["class_id"], r["class_size"]) for r in v}) == 1 and any(r["kept"] for r in v) for k, v in by.items() if k is not None)


def test_a_phrase_that_many_repeat_joins_no_classes(spark, frame):
    """Texts of their own that all repeat one pair of words hundreds of times stay apart."""
    rows = [(i, prose(60) + " over again" * 300 + " " + prose(60)) for i in range(20)]
    assert {r["class_size"] for r in neardup.near_duplicates(frame(rows)).collect()} == {1}
