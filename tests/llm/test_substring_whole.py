import random

import pytest

from folioforge.llm import substring

RNG = random.Random(31)


def words(n, letters):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "абвгдежзийклмноп", "कखगघङचछजझञटठ"])
def test_passages_without_capitals_and_sentence_ends_are_found(spark, frame, letters):
    """Every one of 40 passages of 51 words in differing text on one line loses a part at its second place."""
    rows, places = [], {}
    for i in range(40):
        shared, before = words(51, letters), words(RNG.randint(20, 60), letters)
        rows.append((i, words(30, letters) + " " + shared + " " + words(40, letters)))
        rows.append((100 + i, before + " " + shared.replace(" ", RNG.choice([" ", "\n", "  "])) + " " + words(30, letters)))
        places[100 + i] = (len(before), len(rows[-1][1]) - 30)
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in substring.repeats(frame(rows)).collect()}
    assert set(spans) == set(places)
    assert all(places[d][0] < a < b <= places[d][1] for d, (a, b) in spans.items())


def test_texts_under_one_id_are_documents_of_their_own(spark, frame):
    shared = words(60, "abcdefghijklmnop").capitalize() + "."
    clean = {d: words(200, "qrstuvwxyz") for d in (None, 7)}
    rows = [(1, shared), (None, shared + "\nrest of none"), (None, clean[None]), (7, shared + "\nrest of seven"), (7, clean[7])]
    only_null = words(60, "aeioubdfg").capitalize() + "."
    rows += [(None, only_null + "\n" + words(30, "klmn")), (None, only_null + "\n" + words(30, "pqrs"))]
    docs = frame(rows)
    out = [r["text"] for r in substring.remove(docs, substring.repeats(docs)).collect()]
    assert shared in out and "\nrest of none" in out and "\nrest of seven" in out
    assert clean[None] in out and clean[7] in out
    assert sum(only_null in t for t in out) == 1 and len(out) == len(rows)
