import random

from pyspark.sql import functions as F

from folioforge.operators import references, trigrams


def misspelt(rng, text):
    letters = list(text)
    for _ in range(rng.randint(0, 2)):
        if not letters:
            break
        i = rng.randrange(len(letters))
        letters[i : i + 1] = rng.choice([[], ["x"], [letters[i], letters[i]]])
    return "".join(letters)


def test_join_equals_all_pairs(spark):
    rng = random.Random(3)
    words = "theory of große Straßen naïve Bayes étude über the and fields Ünïcode données графы деревья 深層 学習 x2 r2d2 kernel caches".split()
    titles = [(i, " ".join(rng.sample(words, rng.randint(1, 5)))) for i in range(80)] + [(80, ""), (81, "--"), (82, "a")]
    texts = [(i, f"Author {chr(65 + i % 26)}. {misspelt(rng, rng.choice(titles)[1] or 'none')}, Journal of the {rng.choice(words)} {1950 + i}.") for i in range(150)] + [(150, ""), (151, None), (152, "a a a")]
    lines, names = (spark.createDataFrame(rows, "id bigint, text string").repartition(3) for rows in (texts, titles))
    for least in (0.72, 0.5, 1.0):
        want = {(r, t): s for r, a in texts if a for t, b in titles if (s := round(references.word_similarity(b, a), 6)) >= least}
        got = {(r["text_id"], r["title_id"]): r["similarity"] for r in trigrams.similar(lines, names, least, references.word_similarity).collect()}
        assert got == want and got
        near = {tuple(r) for r in trigrams.candidates(lines, names, least).collect()}
        assert set(want) <= near


def test_trigrams_are_those_of_the_measure(spark):
    rows = ["Große Straßen", "a", "", "x--y", "naïve Bayes 2nd", "ΣΊΣΥΦΟΣ"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", trigrams.trigram_set(F.col("t")).alias("g"))
    for r in df.collect():
        assert set(r["g"]) == set(references._trigrams(r["t"])), r


def test_common_words_meet_nothing(spark):
    """A word that all lines hold joins no line with a title that has rarer trigrams."""
    texts = spark.createDataFrame([(i, f"common words here {chr(97 + i % 26) * 4}{chr(97 + i // 26) * 4}") for i in range(400)], "id bigint, text string")
    titles = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 4}{chr(97 + i // 26) * 4} common") for i in range(400)], "id bigint, text string")
    assert trigrams.candidates(texts, titles, 0.72).count() < 4000


def test_misspelt_titles_without_a_whole_word(spark):
    refs = spark.createDataFrame([(1, "Smith J. Distribted Systms Principls. 2004"), (2, "No title at all")], "ref_id bigint, reference string")
    titles = spark.createDataFrame([(7, "Distributed Systems Principles"), (8, "Distributed Systems Principles"), (9, "Other")], "title_id bigint, title string")
    got = references.best_titles(refs, titles, 0.5).collect()
    assert [(r["ref_id"], r["title_id"]) for r in got] == [(1, 7)]
    assert references.best_titles(refs.limit(0), titles).count() == references.best_titles(refs, titles.limit(0)).count() == 0
