"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of m characters within e edits of a benchmark item shares at least
m + 1 - q * (e + 1) character q-grams with it, all on diagonals at most e apart.
Every text's q-grams are looked up in the items' index, hits are counted per
item in bands of diagonals that overlap by half, bands that reach the bound are
retained, and each is verified by alignment along the band's diagonals alone.

Case and runs of white space don't count.  The edit budget of an item is
``EDIT_SHARE`` of its length, at most what leaves the bound at one q-gram or
more; an item shorter than q characters must occur exactly.

The items are a stated query set: they are dealt by their hash into parts of
about ``PART_CHARS`` characters, and one part after another is read, sent to
the tasks and run against all rows.

Defined results: null and empty texts hold no passage; empty items are left
out; of an item's overlapping places in a text the one with the least distance
is reported, the first of equals; repeated rows report alike; rows without an
id are searched too, and so are items without one, reported under a null
item_id where no other item has their text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import textcore
from folioforge.session import bound_batches, materialise

Q, EDIT_SHARE, PART_CHARS = 8, 0.1, 4_000_000
_TABLE_BITS = 21
#: Postings that are met with a text's q-grams at once, about.
HITS = 1 << 20


def normalise(text: str) -> str:
    """Lower case (one character for one), runs of white space as one space, trimmed."""
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", pc.utf8_lower(pa.scalar(text)).as_py()))


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each place on (Q is 8: three doublings)."""
    h = codes.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0xD6E8FEB86659FD93)):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(odd) + h[step:]
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Posting lists of the items' q-grams."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        named = [(i, normalise(t)) for i, t in items if t]
        self.items = [(i, t) for i, t in named if t]
        self.codes = [_codes(t) for _, t in self.items]
        lengths = self.lengths = np.array([len(c) for c in self.codes], np.int64)
        self.short = [k for k, m in enumerate(lengths) if m < Q]
        self.edits = np.maximum(0, np.minimum(np.floor(share * lengths), (lengths - Q) // Q)).astype(np.int64)
        self.need = np.maximum(1, lengths + 1 - Q * (self.edits + 1))
        grams = [_grams(c) for c in self.codes]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.arange(len(grams), dtype=np.int64), [len(g) for g in grams])[order]
        self.at = np.concatenate([*[np.arange(len(g), dtype=np.int64) for g in grams], np.zeros(0, np.int64)])[order]
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._cell(self.grams)] = True
        self.longest = int(lengths.max()) if len(lengths) else 0

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the codes whose q-gram some item has, and the q-gram's slot."""
        grams = _grams(codes)
        at = np.flatnonzero(self.table[self._cell(grams)])
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), max(0, len(self.grams) - 1))
        same = self.grams[slot] == grams[at] if len(self.grams) else np.zeros(0, bool)
        return at[same], slot[same]

    def bands(self, at: np.ndarray, slot: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(item, band) of the bands of a text of ``size`` characters that reach their item's bound, per item in order.

        Bands are twice as wide as the item's budget, each begun half a band after
        the one before.  The text's q-grams are met with their postings some
        ``HITS`` at a time; a band's hits are counted once the text is past it, so
        what is held doesn't grow with how often text and item repeat a q-gram.
        """
        n_bands, wide = size + self.longest + 2, self.longest + 1
        count = self.count[slot]
        ends = np.cumsum(count)
        pending, first = np.zeros(0, np.int64), 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
            n = count[first:last]
            place = np.repeat(self.first[slot[first:last]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, own = self.item[place], self.at[place]
            band = (np.repeat(at[first:last], n) - own + self.longest) // (self.edits[item] + 1)
            # each place of an item counts once a band, so that a text's own repeats don't add up
            pending = np.unique(np.concatenate([pending, *[(item * n_bands + b) * wide + own for b in (band, np.maximum(band - 1, 0))]]))
            key = pending // wide
            if last < len(at):
                item, band = key // n_bands, key % n_bands
                past = (band + 2) * (self.edits[item] + 1) - self.longest + self.lengths[item] <= at[last]
            else:
                past = np.ones(len(key), bool)
            keys, counts = np.unique(key[past], return_counts=True)
            keys = keys[counts >= self.need[keys // n_bands]]
            yield from zip((keys // n_bands).tolist(), (keys % n_bands).tolist(), strict=True)
            pending, first = pending[~past], last


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """Least edits that turn ``item`` into a stretch of ``text`` along the diagonals first..first+width-1, and the stretch; None beyond ``edits``.

    A cell for each item character and each diagonal of the band: the cost is
    in proportion to both, however long the text is.  One vector step per item
    character, insertions by a running minimum.  Places outside the text hold no
    character, so an item may begin or end beyond it at an edit a character.
    """
    steps = np.arange(width)
    padded = np.full(len(item) + width, -1, np.int64)  # the text from place ``first`` on
    low, high = max(0, first), min(len(text), first + len(padded))
    if low < high:
        padded[low - first : high - first] = text[low:high]
    wanted = item.astype(np.int64)
    cost, begin = np.zeros(width, np.int64), first + steps
    for row in range(len(item)):
        slant = cost + (padded[row : row + width] != wanted[row])
        down = np.append(cost[1:] + 1, 1 << 40)  # the item's character is left out: one diagonal back
        best = np.minimum(down, slant)
        origin = np.where(slant <= down, begin, np.append(begin[1:], 0))
        level = best - steps
        reach = np.minimum.accumulate(level)
        lead = np.maximum.accumulate(np.where(level == reach, steps, 0))
        cost, begin = reach + steps, origin[lead]
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    place = first + end + len(item)
    return (int(cost[end]), min(max(0, int(begin[end])), len(text)), min(max(0, place), len(text))) if cost[end] <= edits else None


def _find(index: Index, text: str, shift: np.ndarray, base: int, at: np.ndarray, slot: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, distance, start, end) of the items found in one normalised text; offsets in the original."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    codes = None
    for k, b in index.bands(at, slot, len(text)):
        m, e = len(index.codes[k]), int(index.edits[k])
        first = b * (e + 1) - index.longest
        low, high = max(0, first), min(len(text), first + 2 * (e + 1) + m)
        # bands come in order, so what lies in this one is among the last found
        if any(low <= s and t <= high and d == 0 for d, s, t in found.get(k, [])[-4:]):
            continue
        exact = text.find(index.items[k][1], low, high)
        if exact >= 0:
            found.setdefault(k, []).append((0, exact, exact + m))
            continue
        codes = _codes(text) if codes is None else codes
        if (got := align(index.codes[k], codes, first, 2 * (e + 1), e)) is not None:
            found.setdefault(k, []).append(got)
    for k in index.short:
        if (exact := text.find(index.items[k][1])) >= 0:
            found.setdefault(k, []).append((0, exact, exact + len(index.items[k][1])))
    out = []
    for k, places in found.items():
        taken: list[tuple[int, int]] = []  # in order, none over another
        for d, s, t in sorted(set(places)):
            i = bisect_left(taken, (s, t))
            if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or t <= taken[i][0]) and (s, t) not in taken[i : i + 1]:
                taken.insert(i, (s, t))
                out.append((k, d, int(shift[base + s]), int(shift[base + t - 1]) + 1 if t > s else int(shift[base + s])))
    return out


def _normalised(block: textcore.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Normalised bytes' code points, the original character of each, each row's first code point, and the rows' texts."""
    starts, ends, row_words = block.words()
    inside = ~textcore._SPACE[block.data]
    last = np.zeros(len(starts), bool)
    closing = row_words[1:][np.diff(row_words) > 0] - 1
    last[closing] = True
    gaps = ends[~last]
    inside[gaps] = True  # one space after each word but a row's last
    data = block.data.copy()
    data[gaps] = 0x20
    lead = (data & 0xC0) != 0x80
    chars = np.cumsum(lead) - 1
    at = np.flatnonzero(inside)
    kept = data[at]
    bounds = np.searchsorted(at, block.offsets)
    is_lead = lead[at]
    origin = chars[at][is_lead]
    text = kept.tobytes().decode("utf-8", "surrogatepass")
    row_first = np.concatenate([[0], np.cumsum(is_lead)])[bounds]
    codes = _codes(text)
    row_base = np.concatenate([chars[np.minimum(block.offsets[:-1], max(0, len(chars) - 1))], [0]]) if len(chars) else np.zeros(len(block.offsets), np.int64)
    rows = np.repeat(np.arange(len(row_first) - 1), np.diff(row_first))
    return codes, origin - row_base[rows], row_first, [text[a:b] for a, b in zip(row_first[:-1], row_first[1:], strict=True)]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, text): the items with an id, and each other text once under a null id."""
    held = benchmark.where(F.col(text) != "").select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    named = held.where("item_id is not null")
    bare = held.where("item_id is null").select("text").distinct().join(named.select("text"), "text", "left_anti")
    return named.unionByName(bare.select(F.lit(None).cast("bigint").alias("item_id"), "text"))


def drop(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Rows are told apart by doc_id and text, so that neither a null id nor one
    that several texts share takes clean rows along.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    leaks = contaminated(keyed, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(leaks, F.col("_row") == F.col("_leak"), "left_anti").drop("_row")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """(doc_id, item_id, distance, start, end): every item's places in every text, offsets in characters; a text that no item with an id has is found under a null item_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = _items(benchmark, item_id, item_text)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // PART_CHARS) or 1
    part_of = F.pmod(F.xxhash64("text"), F.lit(parts))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for part in range(parts):
        rows = sorted(items.where(part_of == part).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        held = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], share))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows: list[tuple] = []
                for block in textcore.blocks(batch.column(1), lower=True):
                    codes, shift, row_first, texts = _normalised(block)
                    at, slot = index.lookup(codes)
                    # a q-gram that reaches over a row's end is none
                    row = np.searchsorted(row_first, at, "right") - 1
                    inside = at + Q <= row_first[row + 1]
                    at, slot, row = at[inside], slot[inside], row[inside]
                    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                    todo = range(len(texts)) if index.short else np.unique(row)
                    for r in todo:
                        s = slice(bounds[r], bounds[r + 1])
                        base = int(row_first[r])
                        rows += [(ids[block.first + r], index.items[k][0], d, a, b) for k, d, a, b in _find(index, texts[r], shift, base, at[s] - base, slot[s])]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

        got = source.mapInArrow(run, "doc_id bigint, item_id bigint, distance int, start int, end int")
        if parts > 1:  # one part at a time: its rows are written, then its index goes
            got = materialise(got, "found")
            held.destroy()
        out = got if out is None else out.unionByName(got)
    return out
