import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from folioforge.llm import textcore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="aé b\n\t☃Z.", max_size=30)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.integers(1, 40))
def test_words_and_hashes(texts, size):
    seen = {}
    found = []
    for block in textcore.blocks(pa.array(texts, pa.string()), size=size):
        starts, ends, first = block.words()
        hashes = block.hashes(starts, ends)
        for r in range(block.last - block.first):
            words = [block.data[a:b].tobytes().decode() for a, b in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)]
            found.append(words)
            for w, h in zip(words, hashes[first[r] : first[r + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert found == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.lists(st.integers(0, 5), max_size=9), min_size=1, max_size=6), st.integers(1, 5))
def test_shingles(rows, k):
    words = np.array([textcore.mix(np.array([w + 1], np.uint64))[0] for r in rows for w in r], np.uint64)
    hashes, first = textcore.shingles(words, np.concatenate([[0], np.cumsum([len(r) for r in rows])]), k)
    seen = {}
    for r, row in enumerate(rows):
        want = [tuple(row[i : i + k]) for i in range(len(row) - k + 1)] if len(row) >= k else [tuple(row)] * bool(row)
        got = hashes[first[r] : first[r + 1]]
        assert len(got) == len(want)
        for w, h in zip(want, got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
