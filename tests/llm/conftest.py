import math
from collections import Counter

import pytest


@pytest.fixture()
def frame(spark):
    """A frame of documents from (doc_id, text[, lang, source]) tuples."""

    def make(rows, partitions=2):
        full = [(*r, *(["en", "s"][len(r) - 2 :] if len(r) < 4 else ())) for r in rows]
        full = [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in full]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(partitions)

    return make


@pytest.fixture()
def clashing(spark):
    """Adds columns whose names clash with those that operators add or use inside."""
    from pyspark.sql import functions as F

    def make(df):
        names = "tid key a b digest start end size taken copies score license kept n_words lang_pred rejected text_a _text _units class block row_key turn held_out".split()
        return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})

    return make


def _weighted(texts, k=5):
    """Similarity of two of ``texts`` by (1 + ln tf) * idf ** 0.25 in quarter steps, from plain counts."""
    counts = []
    for t in texts:
        w = t.lower().split()
        counts.append(Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))))
    df = Counter(x for c in counts for x in c)
    n = len(texts)

    def weight(x, tf):
        idf = 1 + math.log((1 + n) / (1 + df[x]))
        return math.exp((round(math.log(idf)) + round(4 * math.log(1 + math.log(tf)))) / 4)

    sets = [{x: weight(x, tf) for x, tf in c.items()} for c in counts]

    def similarity(i, j):
        x, y = sets[i], sets[j]
        shared = sum(min(w, y[g]) for g, w in x.items() if g in y)
        return shared / (sum(x.values()) + sum(y.values()) - shared)

    return similarity


@pytest.fixture()
def weighted():
    return _weighted
