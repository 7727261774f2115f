import random
import re
from collections import Counter

import pytest

from folioforge.operators import postings


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["the"] * 30 + ["of"] * 10 + ["rare"] + [f"w{i}" for i in range(50)]
    texts = {i * 37: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for i in range(900)}
    texts[100_000] = "Rare rare RARE, the rare!"
    texts[5] = None
    return texts


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    schema = "doc_id bigint, text string"
    rows = sorted(corpus.items())
    postings.append(spark.createDataFrame(rows[:600], schema), path)
    postings.append(spark.createDataFrame([*rows[600:], (None, "the")], schema), path)
    return postings.read(spark, path)


def plain(corpus, terms, k):
    hits = {d: sum(Counter(re.findall("[a-z0-9]+", (t or "").lower()))[w] for w in set(terms)) for d, t in corpus.items()}
    return sorted(((d, n) for d, n in hits.items() if n), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("terms", [["the"], ["rare"], ["the", "rare", "w7"], ["w1", "w2", "w2"], ["nothing"], []])
@pytest.mark.parametrize("first", [1, 3, 1000])
def test_search_equals_scoring_all(index, corpus, terms, first):
    got = [tuple(r) for r in postings.search(index, terms, 7, first).collect()]
    assert got == plain(corpus, terms, 7)


def test_ranges_are_skipped(index, corpus):
    best = plain(corpus, ["rare"], 1)
    assert best == [(100_000, 4)]
    assert postings.skipped(index, ["rare"], 4) > 0.5


def test_bounds_read_no_documents(index):
    plan = postings.bounds(index, ["the"])._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "ids" not in scan and "counts" not in scan and "top" in scan
    assert "PushedFilters: [In" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term" in plan or "EqualTo(term,the)" in plan


def test_blocks_hold_their_ranges(index, corpus):
    rows = index.where("term = 'the'").collect()
    assert sum(len(r["ids"]) for r in rows) == sum("the" in (t or "").lower().replace("!", "").replace(",", "").split() for t in corpus.values())
    for r in rows:
        assert r["top"] == max(r["counts"]) and {i // postings.BLOCK_IDS for i in r["ids"]} == {r["range"]} and list(r["ids"]) == sorted(r["ids"])


def test_index_is_built_once_a_table(spark, sf, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id bigint, text string").write.parquet(path)
    first = postings.index_of(spark, path)
    assert postings.index_of(spark, path).inputFiles() == first.inputFiles()
    spark.createDataFrame([(3, "two two two")], "doc_id bigint, text string").write.mode("append").parquet(path)
    again = postings.index_of(spark, path)
    assert again.inputFiles() != first.inputFiles()
    assert [tuple(r) for r in postings.search(again, ["two"], 2).collect()] == [(3, 3), (1, 1)]


def test_blocks_shuffle_texts_and_not_words(spark):
    """One row a text is dealt out, whatever its words; repeated ids, ids below 0 and texts without a word are as told."""
    texts = [(-5, "One two"), (3, "one ONE"), (3, "two; one"), (4, ""), (5, None), (9000, "É one-two"), (None, "one")]
    made = postings.blocks(spark.createDataFrame(texts, "doc_id bigint, text string"))
    got = sorted(tuple(r) for r in made.collect())
    assert got == [("one", -1, 1, [-5], [1]), ("one", 0, 3, [3], [3]), ("one", 2, 1, [9000], [1]), ("two", -1, 1, [-5], [1]), ("two", 0, 1, [3], [1]), ("two", 2, 1, [9000], [1])]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    assert postings.blocks(spark.createDataFrame([(1, ""), (2, "!")], "doc_id bigint, text string")).count() == 0
