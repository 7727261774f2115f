"""Quality classifier: histogram gradient-boosted trees over text statistics.

Training binds to a bounded sample of labelled rows; their statistics go to the
driver, where trees of a fixed depth grow on binned features.  A model is four
flat arrays (feature, threshold, value, base), complete binary trees one after
another, and scoring steps all rows of a batch down all trees at once.

Defined results: a null text counts as empty and has a score; with labels of
one class alone, or none, every text scores that class's share (0.5 for none);
labels that contradict each other all count; repeated rows get equal scores;
other columns pass through, and those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm import textcore
from folioforge.session import bound_batches

#: Bound of the fit: about this many labelled rows are drawn.
MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
MIN_HESSIAN, RIDGE = 2.0, 1.0
FEATURES = (
    "log_bytes log_words mean_word upper digits symbols punctuation lines bars exclamations non_ascii short_words long_words "
    "distinct_words top_word repeated_word distinct_triples closed_words capital_words distinct_lines words_a_line"
).split()


def _share(flags: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each row, and of the most frequent one's occurrences."""
    n = len(first) - 1
    rows = np.repeat(np.arange(n), np.diff(first))
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    lead = np.ones(len(v), bool)
    lead[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(lead)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=n).astype(float), most


def statistics(block: textcore.Block) -> np.ndarray:
    """Feature matrix of a block's texts, one row each."""
    data, offsets = block.data, block.offsets
    size = np.diff(offsets).astype(float)
    starts, ends, row_words = block.words()
    words = np.diff(row_words).astype(float)
    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[48:58] = 1, 2
    for c in b"#*$%&|<>":
        kind[c] = 3
    for c in b".,;:!?":
        kind[c] = 4
    of = kind[data]
    lengths = (ends - starts).astype(float)
    hashes = block.hashes(starts, ends)
    distinct, top = _distinct(hashes, row_words)
    triples, first = textcore.shingles(hashes, row_words, 3)
    distinct3, _ = _distinct(triples, first)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[row_words[:-1][words > 0]] = False
    # lines: split at line ends, each row's last line too
    breaks = np.flatnonzero(data == 10)
    line_rows = np.searchsorted(offsets, breaks, "right") - 1
    line_ends = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((line_ends, np.concatenate([line_rows, np.arange(len(size))])))
    line_ends, owners = line_ends[order], np.concatenate([line_rows, np.arange(len(size))])[order]
    line_starts = np.concatenate([[0], line_ends[:-1]])
    fresh = np.ones(len(owners), bool)
    fresh[1:] = owners[1:] != owners[:-1]
    line_starts = np.where(fresh, offsets[owners], line_starts + 1)
    line_first = np.searchsorted(owners, np.arange(len(size) + 1))
    n_lines = np.diff(line_first).astype(float)
    distinct_lines, _ = _distinct(block.hashes(np.minimum(line_starts, line_ends), line_ends), line_first)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), _share(lengths, row_words, words), _share(of == 1, offsets, size), _share(of == 2, offsets, size), _share(of == 3, offsets, size),
            _share(of == 4, offsets, size), _share(data == 10, offsets, size), _share(data == 124, offsets, size), _share(data == 33, offsets, size), _share(data >= 128, offsets, size),
            _share(lengths <= 2, row_words, words), _share(lengths >= 12, row_words, words), distinct / np.maximum(words, 1), top / np.maximum(words, 1), _share(again, row_words, words),
            distinct3 / np.maximum(np.diff(first), 1), _share(kind[last] == 4, row_words, words), _share(kind[head] == 1, row_words, words), distinct_lines / np.maximum(n_lines, 1), words / np.maximum(n_lines, 1),
        ]
    )


@dataclass
class Forest:
    """Complete binary trees in flat arrays: row per tree, inner nodes in level order, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees:
            rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.value[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boost trees on the logistic loss, splits from histograms of binned features."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = float(y.mean()) if n else 0.5
    if not 0 < mean < 1 or not n:
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    base = float(np.log(mean / (1 - mean)))
    total = np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, count = (1 << d) - 1, 1 << d
            local = node - first
            best_gain, best_f, best_b = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, -1)
            for f in range(width):
                cell = local * BINS + binned[:, f]
                gs = np.cumsum(np.bincount(cell, g, count * BINS).reshape(count, BINS), 1)
                hs = np.cumsum(np.bincount(cell, h, count * BINS).reshape(count, BINS), 1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < MIN_HESSIAN) | (ha - hl < MIN_HESSIAN)] = -1
                b = gain.argmax(1)
                top = gain[np.arange(count), b]
                better = top > best_gain
                best_gain[better], best_f[better], best_b[better] = top[better], f, b[better]
            for c in np.flatnonzero(best_b >= 0):
                if best_b[c] < len(edges[best_f[c]]):
                    feature[k, first + c], threshold[k, first + c] = best_f[c], edges[best_f[c]][best_b[c]]
            node = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        leaf = node - inner
        value[k] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[k][leaf]
    return Forest(feature, threshold, value, base)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in textcore.blocks(batch.column(3)):
            part = batch.slice(block.first, block.last - block.first)
            x = statistics(block)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "hash", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Forest:
    """Train on about MAX_LABELLED of the labelled rows where ``usable`` (over doc_id) holds."""
    bound_batches(docs.sparkSession)
    marked = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    n = marked.count()
    space = 1 << 31
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(space))
    # a label a row: the mean where labels contradict each other; bounded, so it may be broadcast
    sample = marked.where(drawn < min(space, space * MAX_LABELLED // max(n, 1))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "hash", "y", "text")
    # of different texts under one doc_id the one with the least hash counts
    found = rows.mapInArrow(_features, "doc_id bigint, hash bigint, y double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("hash", "y", "x")).alias("r")).select("doc_id", "r.*").collect()
    found.sort(key=lambda r: r["doc_id"])
    return grow(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Forest, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of each text."""
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    held, passed = docs.sparkSession.sparkContext.broadcast(model), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textcore.blocks(batch.column(passed)):
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([*part.columns[:passed], pa.array(held.value.score(statistics(block)))], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_" + "_".join(keep))).mapInArrow(run, schema)
