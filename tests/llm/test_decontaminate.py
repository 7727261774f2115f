import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import decontaminate as dc

RNG = random.Random(4)


def prose(n):
    return " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(2, 8))) for _ in range(n))


def typo(text, n):
    chars = list(text)
    for i in RNG.sample(range(len(chars)), n):
        chars[i] = RNG.choice(["", "q", chars[i] + "z"])
    return "".join(chars)


def distance(item, text):
    """Least edits from the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_found_as_by_full_alignment(spark, frame):
    items = [(i, prose(12)) for i in range(6)]
    rows = []
    for i in range(40):
        text = prose(40)
        if i % 2:
            item = RNG.choice(items)[1]
            text = prose(10) + " " + typo(item, RNG.randint(0, len(item) // 8)) + " " + prose(10)
        rows.append((i, text.upper() if i % 5 == 0 else text.replace(" ", " \n") if i % 7 == 0 else text))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(frame(rows), bench).collect()}
    index = dc.Index(items)
    for d, text in rows:
        flat = dc.normalise(text)
        for k, (item, body) in enumerate(items):
            least = distance(dc.normalise(body), flat)
            assert ((d, item) in got) == (least <= index.edits[k])
            if (d, item) in got:
                r = got[d, item]
                assert r["distance"] == least and distance(dc.normalise(body), dc.normalise(text[r["start"] : r["end"]])) == least


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=12), st.text(alphabet="ab", max_size=30), st.integers(0, 4))
def test_alignment(item, text, edits):
    """A band of all diagonals gives the least distance; narrower ones give none that is less."""
    codes = dc._codes(item), dc._codes(text)
    got = dc.align(*codes, -len(item), len(item) + len(text) + 1, edits)
    least = distance(item, text)
    assert (got is None) == (least > edits)
    if got:
        assert got[0] == least and distance(item, text[got[1] : got[2]]) == least
        narrow = [x for s in range(-edits, len(text) + 1, edits + 1) if (x := dc.align(*codes, s, 2 * (edits + 1), edits))]
        assert min(x[0] for x in narrow) == least


def test_alignment_takes_time_by_length_times_budget():
    """An item of 5,000 characters with 500 edits costs a band of 1,002 diagonals, wherever it stands."""
    item = prose(1100)[:5000]
    text = prose(2000) + " " + typo(item, 300) + " " + prose(2000)
    index = dc.Index([(1, item)])
    began = time.perf_counter()
    at = np.arange(len(text) - 7)
    got = dc._find(index, text, np.arange(len(text) + 1), 0, *index.lookup(dc._codes(text)))
    assert len(at) and [x[0] for x in got] == [0] and got[0][1] <= 300
    assert time.perf_counter() - began < 10


def test_edges(spark, frame, clashing):
    item = prose(12)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (None, item)], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (4, "a tiny text"), (None, item), (5, "z" * 50_000 + " " + item), (6, "é " + item + " " + item)]
    got = sorted(((r["doc_id"], r["item_id"], r["start"]) for r in dc.contaminated(clashing(frame(rows)), bench).collect()), key=str)
    assert got == sorted([(3, 1, 0), (3, 1, 0), (4, 4, 2), (None, 1, 0), (5, 1, 50_001), (6, 1, 2), (6, 1, 3 + len(item))], key=str)
    assert dc.contaminated(frame(rows).limit(0), bench).count() == 0
    assert dc.contaminated(frame(rows), bench.limit(0)).count() == 0


def test_parts_find_as_one(spark, frame, monkeypatch):
    items = [(i, prose(8)) for i in range(7)] + [(None, prose(8))]
    rows = [(i, prose(5) + " " + RNG.choice(items)[1] + " " + prose(5)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: sorted(map(str, dc.contaminated(frame(rows), bench).collect()))
    whole = found()
    monkeypatch.setattr(dc, "PART_CHARS", 100)
    assert len(whole) >= 30 and found() == whole


def test_rows_without_an_id_or_under_one_id_are_judged_alone(spark, frame, clashing):
    item = prose(12)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    clean = [prose(20) for _ in range(4)]
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (7, "a " + item), (7, clean[2]), (8, clean[3]), (8, clean[3]), (9, None)]
    out = dc.drop(clashing(frame(rows)), bench)
    assert out.columns == clashing(frame(rows)).columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted([*map(str, clean), clean[3], "None"])


def test_normalised_offsets():
    (block,) = dc.textcore.blocks(pa.array(["  É b\n\nc", "", "d  "]), lower=True)
    codes, shift, first, texts = dc._normalised(block)
    assert texts == ["é b c", "", "d"] and list(shift[: len(texts[0])]) == [2, 3, 4, 5, 7]
