"""Near-duplicate classes by improved consistent weighted sampling.

Texts are sets of five-word shingles weighted by tf * idf.  Improved consistent
weighted sampling draws, per hash function, the shingle with the least
``ln a = ln c - r * (t - beta) - r`` (``t = floor(ln S / r + beta)`` for weight
``S``); two texts draw alike with the probability of their weighted Jaccard
similarity.  Samples are banded: texts that agree in all draws of a band share
a bucket.  Links are verified by weighted Jaccard similarity over all shingles.

1. A bucket's members are verified against its leader, the member that meets
   most others in all its buckets.  The links give components.
2. A bucket whose members lie in several components isn't settled: every pair of
   its members from two components is judged, in blocks of about ``BLOCK``
   members.  A block pair is one task's group, so no group grows with a bucket.
   Members of a bucket's largest component are held against all others, but
   not against each other.  A pair that shares several buckets is judged in the
   first, one that agrees in fewer than ``AGREE`` of all draws isn't a candidate
   (a text of similarity 0.8 does once in some 6,000 times), and two members
   that links of the block have joined meanwhile needn't be judged any more.

So every candidate pair was verified or its members are in one class.  No
bucket is capped, and none is collected: beyond the first components, the work
is in proportion to the members outside the largest one times the members.

Weights: ``(1 + ln tf) * idf ** IDF_POWER``, ``idf = 1 + ln((1 + N) / (1 + df))``,
rounded to steps of a quarter in the logarithm.  The power keeps what a large
group of near copies shares from weighing much less than what tells them apart;
the logarithm keeps a phrase that two texts repeat hundreds of times from
outweighing all that they don't share.
Document frequencies come from a count sketch of a fixed size over all
documents; it errs upwards by about the mean load of its cells, a constant
share of N at every corpus size, and so leaves the rare shingles with one
common weight.

Defined results: a text without words (null, empty, blank) is in no group: its
class is its own doc_id, its class_key null.  A text of one to four words has
one shingle, all of it.  Words compare in lower case, white space doesn't
count.  Equal texts share a class, repeated rows too.  A class's first document
is the one with the least doc_id, null last, then the least text hash; rows that
repeat both are marked alike, and ``keep_first`` keeps one of them.  Texts under
one doc_id, or under none, are documents of their own: classes are told apart by
class_key, class_id is the first document's doc_id (null where no document of the class has
one).  Texts are told apart by 64-bit hashes, two texts' shingles by 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import textcore
from folioforge.session import bound_batches, discard, materialise, release

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
#: Draws in which two texts agree at least, of all BANDS * ROWS.
AGREE = 34
#: Members and shingles of a block of an unsettled bucket, about.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Power of the idf in a weight.
IDF_POWER = 0.25
#: Cells of the document-frequency sketch, and of the table that holds each hash function's variates.
SKETCH_BITS, VARIATE_BITS = 20, 14
#: Weight levels whose variates are tabulated; those above are worked out one by one.
TABLED = 12
#: Cells of the sketch that travel as one row.
SLICE = 1 << 12
_WORDS = r"[^\x20\x09-\x0D]"
#: Stands for a null doc_id, after all others.
_LAST = (1 << 63) - 1
_WEIGHT = np.exp(np.arange(256) / 4)


def _row_sets(block: textcore.Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their counts, and each row's first index (one more than rows)."""
    starts, ends, row_words = block.words()
    found, first = textcore.shingles(block.hashes(starts, ends), row_words, k)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(first) < 1 << 16:  # one sort: the row above, 48 bits of the hash below
        order = np.argsort((rows.astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16)), kind="stable")
    else:
        order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(found)))
    return found[at], counts, np.searchsorted(rows[at], np.arange(len(first)))


def frequency_sketch(docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS) -> tuple[np.ndarray, int]:
    """Count sketch of the shingles' document frequencies over all rows, and the number of rows with a shingle.

    Every task counts into 2**SKETCH_BITS cells and emits the filled slices;
    slices are added up per slice number.  The driver receives the cells alone.
    """
    cells = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(cells, np.int64), 0
        for batch in batches:
            for block in textcore.blocks(batch.column(0), lower=True):
                found, _, first = _row_sets(block, k)
                held += np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
                rows += int((np.diff(first) > 0).sum())
        at = np.flatnonzero(held)
        slices = np.unique(at // SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*slices.tolist(), -1], pa.int32()), pa.array([*(held[s * SLICE : (s + 1) * SLICE].astype("<u4").tobytes() for s in slices), np.array([rows], "<u8").tobytes()], pa.binary())], names=["slice", "cells"]
        )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for cells_ in batch.column("cells"):
                total = total + np.frombuffer(cells_.as_py(), "<u4" if key[0].as_py() >= 0 else "<u8").astype("<u8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "cells"])

    parts = docs.select(F.col(text)).mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInArrow(add, "slice int, cells binary").collect()
    out, n = np.zeros(cells, np.uint64), 0
    for number, raw in parts:
        if number < 0:
            n = int(np.frombuffer(bytes(raw), "<u8")[0])
        else:
            out[number * SLICE : (number + 1) * SLICE] = np.frombuffer(bytes(raw), "<u8")
    return out, n


def idf_levels(sketch: np.ndarray, n: int) -> np.ndarray:
    """Logarithm of idf ** IDF_POWER of each cell in quarter steps."""
    idf = 1 + np.log((1 + n) / (1 + np.minimum(sketch.astype(float), n)))
    return np.round(np.log(idf) * IDF_POWER * 4).astype(np.int8)


class Weights:
    """Weights of shingles in quarter steps of the logarithm."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def level(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = self.levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
        often = counts > 1
        if often.any():
            out[often] += np.round(np.log(1 + np.log(counts[often])) * 4).astype(np.int64)
        return out


class Sampler:
    """The hash functions of improved consistent weighted sampling."""

    def __init__(self, hashes: int, bits: int = VARIATE_BITS):
        rng = np.random.Generator(np.random.PCG64(20240607))
        size = (hashes, 1 << bits)
        self.bits, self.hashes = bits, hashes
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size, np.float32)
        self.odd = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # ln a of every variate cell for the first weight levels, level by level in a row
        self.table = np.empty((hashes, TABLED << bits), np.float32)
        for x in range(TABLED):
            self.table[:, x << bits : (x + 1) << bits] = self._log_a(x / 4, self.log_c, self.r, self.beta)

    @staticmethod
    def _log_a(log_weight, log_c: np.ndarray, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return log_c - r * (np.floor(np.float32(log_weight) / r + beta) - beta) - r

    def draw(self, found: np.ndarray, level: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sample of every row (all rows have a shingle) by every hash function, as a 64-bit value."""
        out = np.empty((len(first) - 1, self.hashes), np.uint64)
        lengths = np.diff(first)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        shift, base = np.uint64(64 - self.bits), np.minimum(level, TABLED - 1) << self.bits
        above = np.flatnonzero(level >= TABLED)
        for j in range(self.hashes):
            product = found * self.odd[j]
            cell = (product >> shift).view(np.int64)
            value = self.table[j].take(cell + base)
            if len(above):
                high = cell[above]
                value[above] = self._log_a((level[above] / 4).astype(np.float32), self.log_c[j][high], self.r[j][high], self.beta[j][high])
            at = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first[:-1]), lengths))
            # two shingles in one cell: the one with the lesser product is drawn
            if len(at) > len(lengths):
                at = at[np.lexsort((product[at], rows[at]))]
                at = at[np.append(True, np.diff(rows[at]) > 0)]
            t = np.floor((level[at] / 4).astype(np.float32) / self.r[j][cell[at]] + self.beta[j][cell[at]])
            out[:, j] = textcore.mix(found[at] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each row and band from the samples in that band."""
    keys = np.empty((len(samples), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(samples), b + 1, np.uint64)
        for r in range(rows):
            key = textcore.mix(key * np.uint64(0xD6E8FEB86659FD93) + samples[:, b * rows + r])
        keys[:, b] = key
    return keys


def sketches(docs: DataFrame, levels: np.ndarray, tid: str = "tid", text: str = "text", k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(tid, keys, sample) of each text with words: a key for each band, and 16 bits of each draw."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = Weights(held.value), Sampler(bands * rows)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            # equal texts of a batch are drawn from once
            _, once = np.unique(ids, return_index=True)
            ids, texts = ids[once], batch.column(1).take(pa.array(once))
            for block in textcore.blocks(texts, lower=True):
                found, counts, first = _row_sets(block, k)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                first = np.append(first[some], len(found))
                draws = sampler.draw(found, weights.level(found, counts), first)
                keys = band_keys(draws, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                sample = [x.tobytes() for x in (draws >> np.uint64(48)).astype("<u2")]
                yield pa.RecordBatch.from_arrays([pa.array(ids[block.first : block.last][some]), lists, pa.array(sample, pa.binary())], names=["tid", "keys", "sample"])

    return docs.select(tid, text).mapInArrow(run, "tid bigint, keys array<bigint>, sample binary").dropDuplicates(["tid"])


def shingle_sets(texts: DataFrame, levels: np.ndarray, k: int = SHINGLE_WORDS) -> DataFrame:
    """(tid, shingles, hashes, levels) of ``texts`` (tid, text): the upper 32 bits of each shingle's hash in order, and its weight's level in a byte."""
    held = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(held.value)
        for batch in batches:
            for block in textcore.blocks(batch.column(1), lower=True):
                found, counts, first = _row_sets(block, k)
                hashes, level = (found >> np.uint64(32)).astype("<u4"), np.minimum(weights.level(found, counts), 255).astype(np.uint8)
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.last - block.first),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array([hashes[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([level[a:b].tobytes() for a, b in cut], pa.binary()),
                    ],
                    names=["tid", "shingles", "hashes", "levels"],
                )

    return texts.select("tid", "text").mapInArrow(run, "tid bigint, shingles bigint, hashes binary, levels binary")


class Sets:
    """Texts' shingle hashes (ascending) and weights, read from two binary columns."""

    def __init__(self, hashes: pa.Array, levels: pa.Array):
        self.hashes = [np.frombuffer(x.as_buffer(), "<u4") for x in hashes]
        self.weights = [_WEIGHT[np.frombuffer(x.as_buffer(), np.uint8)] for x in levels]

    def like(self, one: int, others: list[int], threshold: float) -> np.ndarray:
        """For each of ``others``, whether its weighted Jaccard similarity with ``one`` reaches the threshold."""
        mine, weight = self.hashes[one], self.weights[one]
        lengths = [len(self.hashes[o]) for o in others]
        theirs, their_weight = (np.concatenate([part[o] for o in others]) for part in (self.hashes, self.weights))
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        least = np.where(mine[at] == theirs, np.minimum(weight[at], their_weight), 0.0)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        shared, total = np.add.reduceat(least, begin), np.add.reduceat(their_weight, begin)
        return shared >= (threshold - 1e-9) * (weight.sum() + total - shared)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The linked ones (a, b) of ``pairs`` (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = Sets(pa.concat_arrays([batch.column("hashes_a"), batch.column("hashes_b")]), pa.concat_arrays([batch.column("levels_a"), batch.column("levels_b")]))
            linked = pa.array([bool(both.like(i, [n + i], threshold)[0]) for i in range(n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(linked)

    named = [sets.select(F.col("tid").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("levels").alias(f"levels_{x}")) for x in "ab"]
    return pairs.join(named[0], "a").join(named[1], "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least vertex of each vertex's connected component.

    Every round each vertex moves to its least neighbour and the edges between
    the places reached remain; the vertices left shrink by a factor each round.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges", narrow=True)
    labels = materialise(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("c", F.col("v")), "labels", narrow=True)
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        moves = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).where("m < c")
        hop = materialise(moves, "moves", narrow=True)
        moved = materialise(labels.join(hop, "c", "left").select("v", F.coalesce("m", "c").alias("c")), "labels", narrow=True)
        at_a = edges.join(hop.withColumnsRenamed({"c": "a", "m": "ma"}), "a", "left").select(F.coalesce("ma", "a").alias("a"), "b")
        at_b = at_a.join(hop.withColumnsRenamed({"c": "b", "m": "mb"}), "b", "left").select("a", F.coalesce("mb", "b").alias("b"))
        left = materialise(at_b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=True)
        discard(hop, labels, edges)
        labels, edges = moved, left
    discard(edges)
    return labels


def _dealt(crowded: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, band, x, y, own, tid, c): members of unsettled buckets, a row for each pair of blocks x <= y that they take part in.

    Members outside a bucket's largest component are dealt into blocks of their
    own, each to be held against all of these and against the blocks of the
    largest component, whose own members are linked already.
    """
    sized = crowded.join(sets.select("tid", "shingles"), "tid").join(labels.withColumnRenamed("v", "tid"), "tid", "left")
    placed = materialise(sized.select("key", "band", "tid", "shingles", F.coalesce("c", "tid").alias("c")), "placed")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    top = F.max(F.struct("n", "s", "c"))
    whole = parts.groupBy("key").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("top.n < n")

    def blocks(n: str, s: str):
        return F.greatest(F.ceil(F.expr(n) / BLOCK), F.ceil(F.expr(s) / BLOCK_SHINGLES)).cast("int")

    one = (F.col("n") <= BLOCK) & (F.col("s") <= BLOCK_SHINGLES)
    plan = whole.select("key", F.col("top.c").alias("largest"), F.when(one, 1).otherwise(blocks("n - top.n", "s - top.s")).alias("p"), F.when(one, 0).otherwise(blocks("top.n", "top.s")).alias("q"))
    plan = materialise(plan, "plan", narrow=True)
    inner = (F.col("c") != F.col("largest")) | (F.col("q") == 0)
    own = F.when(inner, F.pmod(F.hash("tid"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.hash("tid"), F.greatest("q", F.lit(1))))
    met = F.explode(F.sequence(F.lit(0), F.when(inner, F.col("p") + F.col("q")).otherwise(F.col("p")) - 1))
    dealt = placed.join(plan, "key").select("key", "band", "tid", "c", own.alias("own"), met.alias("other"))
    return dealt.select("key", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "tid", "c")


class Members:
    """The members of one or more groups, decoded from Arrow."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column
        self.group = np.column_stack([column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "x", "y")])
        self.band, self.own, self.tid, self.c = (column(c).to_numpy(zero_copy_only=False) for c in ("band", "own", "tid", "c"))
        self.sample = np.frombuffer(b"".join(x.as_py() for x in column("sample")), "<u2").reshape(batch.num_rows, -1)
        self.sets = Sets(column("hashes"), column("levels"))


def _compare(group: pa.RecordBatch, threshold: float, rows: int, agree: int) -> list[tuple[int, int]]:
    """Links that join the components of a group's members, each pair judged in the first band whose bucket it shares."""
    m = Members(group)
    n, (x, y), band = len(m.tid), m.group[0, 1:], int(m.band[0])
    c, places = m.c.copy(), np.arange(n)
    links = []
    for i in np.flatnonzero(m.own == x).tolist():
        others = places[i + 1 :] if x == y else np.flatnonzero(m.own == y)
        others = others[c[others] != c[i]]
        if not len(others):
            continue
        same = m.sample[others] == m.sample[i]
        count = same.sum(1)
        open_ = count >= agree
        if band:
            open_ &= ~same[:, : band * rows].reshape(len(others), band, rows).all(2).any(1)
        others = others[open_][np.argsort(-count[open_], kind="stable")]
        while len(others):
            part, others = others[:64], others[64:]
            for o in part[m.sets.like(i, part.tolist(), threshold)].tolist():
                if c[i] != c[o]:
                    c[c == max(c[i], c[o])] = min(c[i], c[o])
                    links.append((int(m.tid[i]), int(m.tid[o])))
            others = others[c[others] != c[i]]
    return links


def settle(crowded: DataFrame, labels: DataFrame, sets: DataFrame, samples: DataFrame, threshold: float, rows: int = ROWS, agree: int = AGREE) -> DataFrame:
    """Links (a, b) that join components: every pair of members of a bucket that lie in two components is judged, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def judged() -> pa.RecordBatch:
            links = _compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0], threshold, rows, agree)
            return pa.RecordBatch.from_arrays([pa.array([p[s] for p in links], pa.int64()) for s in (0, 1)], names=["a", "b"])

        for batch in batches:
            group = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "x", "y")])
            cuts = np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))), len(group)) if len(group) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(group[a]) != last:
                    yield judged()
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(group[a])
        if held:
            yield judged()

    carried = sets.select("tid", "hashes", "levels").join(samples.select("tid", "sample"), "tid")
    grouped = _dealt(crowded, labels, sets).join(carried, "tid").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return grouped.mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, agree: int | None = None) -> DataFrame:
    """Verified links (a, b) between texts of ``docs`` (tid, text), each text given by its tid: enough to join every class."""
    spark = docs.sparkSession
    bound_batches(spark)
    agree = bands * rows * AGREE // (BANDS * ROWS) if agree is None else agree
    levels = idf_levels(*frequency_sketch(docs, k=k))
    drawn = materialise(sketches(docs, levels, k=k, bands=bands, rows=rows), "sketches")
    members = drawn.select("tid", F.posexplode("keys").alias("band", "key"))
    # what is aggregated by key is written before it is joined: only then can Spark split a hot key of the join
    counts = materialise(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts", narrow=True)
    crowded = materialise(members.join(counts, "key"), "crowded")
    # equal texts are made one before the shuffle
    needed = docs.dropDuplicates(["tid"]).join(crowded.select("tid").distinct(), "tid")
    sets = materialise(shingle_sets(needed, levels, k), "sets")
    release(spark)
    # a bucket's leader is the member that meets most others in all its buckets: the text that the others were copied from, as a rule
    central = crowded.groupBy("tid").agg(F.sum("n").alias("met"))
    leaders = materialise(crowded.select("key", "tid").join(central, "tid").groupBy("key").agg(F.max(F.struct("met", F.col("tid").alias("b")))["b"].alias("b")), "leaders", narrow=True)
    stars = crowded.select("key", "tid").join(leaders, "key").where("tid <> b").select(F.least("tid", "b").alias("a"), F.greatest("tid", "b").alias("b")).distinct()
    first = materialise(verify(materialise(stars, "stars", narrow=True), sets, threshold), "links")
    labels = components(first)
    second = materialise(settle(crowded, labels, sets, drawn, threshold, rows, agree), "links")
    discard(counts, crowded, leaders, sets, drawn, labels)
    return first.union(second)


def with_text_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tid, text): tid is the text's hash, null for a text without words."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.when(F.col(text).rlike(_WORDS), F.xxhash64(text)).alias("tid"), F.col(text).alias("text"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(tid, class_key, first_rank, first_tid, class_size): one row per text with words.

    class_key is the least text hash of the class; first_rank and first_tid name
    the class's first document: the least doc_id, null last, then the least text hash.
    """
    rows = with_text_id(docs, doc_id, text).where("tid is not null")
    found = components(links(rows.select("tid", "text"), threshold))
    copies = rows.groupBy("tid").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("least"), F.count("*").alias("n"))
    member = copies.join(found.withColumnRenamed("v", "tid"), "tid", "left").withColumn("c", F.coalesce("c", "tid"))
    member = materialise(member.select("tid", "c", "least", "n"), "member")
    whole = member.groupBy("c").agg(F.min(F.struct("least", "tid")).alias("first"), F.sum("n").alias("class_size"))
    discard(found)
    return member.join(whole, "c").select("tid", F.col("c").alias("class_key"), F.col("first.least").alias("first_rank"), F.col("first.tid").alias("first_tid"), "class_size")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_key, class_size, kept."""
    found = classes(docs, doc_id, text, threshold)
    alone = F.col("tid").isNull()
    rank = F.coalesce("doc_id", F.lit(_LAST))
    return (
        with_text_id(docs, doc_id, text)
        .select("doc_id", "tid")
        .join(found, "tid", "left")
        .select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.nullif("first_rank", F.lit(_LAST))).alias("class_id"),
            "class_key",
            F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
            (alone | (rank == F.col("first_rank")) & (F.col("tid") == F.col("first_tid"))).alias("kept"),
        )
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class; rows whose text has no words all stay."""
    firsts = classes(docs, threshold=threshold).where("tid = first_tid").select(F.col("first_rank").alias("_rank"), F.col("tid").alias("_tid"))
    keyed = docs.withColumns({"_tid": F.when(F.col("text").rlike(_WORDS), F.xxhash64("text")), "_rank": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))})
    worded = keyed.where("_tid is not null").dropDuplicates(["_rank", "_tid"]).join(firsts, ["_rank", "_tid"], "left_semi")
    return worded.unionByName(keyed.where("_tid is null")).select(*docs.columns)
