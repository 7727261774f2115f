import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.llm import classifier, language, textcore

RNG = random.Random(8)


def prose(n=60):
    return " ".join(RNG.choice(["sun", "moon", "river", "stone", "cloud"]) + str(RNG.randint(0, 99)) for _ in range(n)) + "."


def junk(n=60):
    return " ".join(RNG.choice(["BUY", "NOW", "$$$"]) + "!!" for _ in range(n))


def test_learns_and_scores(spark, frame):
    rows = [(i, junk() if i % 4 == 0 else prose()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id bigint, quality int")
    docs = frame(rows)
    model = classifier.fit(docs, labels, ~language.held_out(F.col("doc_id")))
    out = classifier.score(docs, model, keep=["doc_id"]).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) and 0 <= r["score"] <= 1 for r in out)


def test_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(classifier.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 1] > 0).astype(float)
    model = classifier.grow(x, y, trees=8)
    inner = model.feature.shape[1]
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - inner]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((classifier.grow(x, y).score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_statistics_equal_brute_force():
    texts = ["", "One two, TWO two!\nOne | x", "a\na\n\nb", None, "é ü " * 5, "x" * 30]
    column = {n: i for i, n in enumerate(classifier.FEATURES)}
    got = np.concatenate([classifier.statistics(b) for b in textcore.blocks(pa.array(texts, pa.string()), size=20)])
    for t, r in zip(texts, got, strict=True):
        t = t or ""
        raw, words, lines = t.encode(), re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        n = max(1, len(words))
        want = {
            "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "mean_word": sum(len(w.encode()) for w in words) / n, "bars": t.count("|") / max(1, len(raw)),
            "distinct_words": len(set(words)) / n, "top_word": max((words.count(w) for w in words), default=0) / n, "repeated_word": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            "distinct_lines": len(set(lines)) / len(lines), "words_a_line": len(words) / len(lines), "non_ascii": sum(b >= 128 for b in raw) / max(1, len(raw)), "capital_words": sum("A" <= w[0] <= "Z" for w in words) / n,
        }
        for name, value in want.items():
            assert abs(r[column[name]] - value) < 1e-9, (name, t)


def test_edges(spark, frame, clashing):
    rows = [(1, None), (2, ""), (3, prose()), (3, prose()), (None, prose()), (4, "x" * 300_000), (5, "w " * 50_000)]
    docs = clashing(frame(rows).drop("score"))
    one = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (4, None)], "doc_id bigint, quality int")
    for labels, expected in ((one, 1.0), (one.limit(0), 0.5)):
        model = classifier.fit(docs, labels, F.lit(True))
        out = classifier.score(docs, model).collect()
        assert len(out) == len(rows) and all(abs(r["score"] - expected) < 1e-3 for r in out)
    assert classifier.score(frame(rows).limit(0), model).count() == 0
    mixed = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 1)], "doc_id bigint, quality int")
    assert classifier.score(docs, classifier.fit(docs, mixed, F.lit(True))).count() == len(rows)


def test_first_split_equals_brute_force():
    """The first tree's root has the greatest gain over all features and all thresholds, its leaves the Newton steps."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (400, 5)).astype(float)
    y = ((x[:, 3] > 4) ^ (rng.random(400) < 0.2)).astype(float)
    forest = classifier.grow(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + classifier.RIDGE)
    gains = {(f, t): value(x[:, f] <= t) + value(x[:, f] > t) for f in range(5) for t in range(8)}
    best = max(gains, key=gains.get)
    assert (forest.feature[0, 0], np.floor(forest.threshold[0, 0])) == best
    left = x[:, best[0]] <= best[1]
    for m, leaf in ((left, 0), (~left, 1)):
        assert np.isclose(forest.value[0, leaf], -classifier.RATE * g[m].sum() / (h[m].sum() + classifier.RIDGE))


def test_texts_under_one_id_train_alike(spark, frame):
    rows = [(i % 6, f"text {i} of some words, " * (1 + i % 5), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    one, two = (classifier.fit(frame(rows, n), labels, F.lit(True)) for n in (1, 7))
    assert all(np.array_equal(a, b) for a, b in zip((one.feature, one.value), (two.feature, two.value), strict=True))
