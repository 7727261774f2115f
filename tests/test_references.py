import time

from folioforge.operators import references
from folioforge.plans import catalogue
from folioforge.tables import table


def test_every_part_has_its_best_title(spark, sf):
    """t23_word_similarity over the whole table, by brute force over all titles."""
    names = {r["p_partkey"]: r["p_name"] for r in table(spark, sf, "part").collect()}
    first = {}
    for k in sorted(names):
        first.setdefault(names[k], k)
    want, best = {}, {}
    for k, name in names.items():
        if name not in best:
            best[name] = min((-round(references.word_similarity(t, f"Author X. {name}. Journal 2004"), 6), i) for t, i in first.items())
        less, title = best[name]
        if -less >= references.MIN_TITLE:
            want[k] = (title, -less)
    got = {r["ref_id"]: (r["title_id"], r["similarity"]) for r in catalogue.QUERIES["t23_word_similarity"](spark, sf).collect()}
    assert got == want and max(got) > 60


def test_a_long_question_is_split_once(spark):
    """The work grows with the words, not with their square; equal titles are all found, longer ones in full alone."""
    words = " ".join(f"word{i} of" for i in range(10_000))
    questions = spark.createDataFrame([(1, words), (2, "word7 of word8 of word9 on")], "question_id int, question string")
    titles = [("a", "The word7777 of"), ("b", "Word7777, of!"), ("c", "word7 of word8 of word9 of"), ("d", "word9999 of"), ("e", "of of of of"), ("f", "word7 of word8"), ("g", "word7 of")]
    began = time.time()
    found = references.named_titles(questions, spark.createDataFrame(titles, "title_id string, title string")).collect()
    assert time.time() - began < 20
    assert sorted(tuple(r) for r in found) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "f"), (2, "f")]
