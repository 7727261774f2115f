import numpy as np
from folioforge.llm import decontaminate


def test_items_without_an_id_are_found(spark, frame):
    item = "which of the seven rivers of the old province runs north past the mill before it meets the sea"
    other = "how many lamps did the keeper of the long pier light on the evening before the great storm came"
    items = spark.createDataFrame([(None, item), (5, other), (None, None)], "item_id bigint, text string")
    docs = frame([(1, "So they asked: " + item + " and nobody knew."), (2, "nothing of the kind"), (3, other)])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, None), (3, 5)}


def test_repeated_phrases_stay_within_memory(spark, monkeypatch):
    """An item and a text that repeat one phrase: what meets at once is bounded, and the places are those of any other text."""
    import tracemalloc

    from folioforge.llm import decontaminate as dc

    items = [(1, "ab " * 70), (2, "the one and only phrase of its kind, " * 3), (3, "xyz " * 400)]
    index = dc.Index(items)

    def find(text):
        norm = dc.normalise(text)
        return dc._find(index, norm, np.arange(len(norm) + 1), 0, *index.lookup(dc._codes(norm)))

    small = "ab " * 700 + items[1][1] + "xyz " * 900
    want = find(small)
    assert {k for k, *_ in want} == {0, 1, 2}
    monkeypatch.setattr(dc, "HITS", 500)
    assert sorted(find(small)) == sorted(want)
    monkeypatch.undo()
    tracemalloc.start()
    found = find("ab " * 700_000 + items[1][1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {k for k, *_ in found} == {0, 1} and peak < 500e6
    spans = sorted((a, b) for k, _, a, b in found if k == 0)
    assert all(y <= c for (_, y), (c, _) in zip(spans, spans[1:])) and len(spans) > 9000
