"""Packing tokenised documents into sequences of a fixed length.

Sum-of-squares online packing: documents come one after another; each is put
into the open sequence of that fill level which makes the sum over levels of
the squared number of open sequences least, so that no level gathers many
sequences that nothing completes.  Levels are an array of counts; all choices
for one document are one vectorised pass over it.  What is longer than a
sequence fills whole ones first and only its rest is placed.

Every task packs the documents it reads, so nothing is shuffled and a task
holds no more than ``OPEN`` open sequences: beyond that, and at the end, the
emptiest are cut up to fill the gaps of the fullest.  The one that is left at
the end is cut at the powers of two of its length, lengths that aren't padded.
So no task pads anything, whatever its number of documents.

Texts are cut at white space, which the tokenizer drops, so that every distinct
word of a batch is tokenised once.

Defined results: a null or empty text is the end mark alone; repeated rows are
documents of their own, each packed whole; a null id is kept; an empty table
gives no row; a text of any length is tokenised in full; other columns don't matter.
Sequence ids say which task packed them (its number times 2**33): reruns agree
where the same rows come in the same tasks, as from files; write what comes
from a shuffle first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.textcore import string_array
from folioforge.session import bound_batches

LENGTH, END = 4096, 2
#: Open sequences of a task, and words whose ids a worker keeps.
OPEN, WORDS_KEPT = 1024, 1 << 20
#: New words that are tokenised as one text.
WORDS_AT_ONCE = 4096
#: Points that, after a letter at the end of a word, are a token's word of their own.
POINTS = ".,;:!?"
#: Characters of texts whose tokens are made at once; a longer text alone.
BLOCK_CHARS = 1 << 22


class Words:
    """Token ids of words: each distinct one is tokenised once, as long as the table of known ones has room.

    New words are tokenised as one text, with a mark of one id between them
    that none of them holds.  Words of plain letters, with points at their end
    or none, need neither the marks nor the costly rules for cutting and
    folding characters: the same vocabulary is applied to them at white space,
    and the ids that end a word tell them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.mark, self.mark_id = next((c, i[0]) for c, i in ((c, self.encode(self.full, c)) for c in "\u00b6\u00a7|~^") if len(i) == 1)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.full.model, "end_of_word_suffix", None)
        self.ending = np.zeros(self.full.get_vocab_size(), bool)
        self.ending[[i for w, i in self.full.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        sample = "the quick brown fox ... jumps over tokenization , antidisestablishmentarianism ?!"
        self.quick = bool(suffix) and self.encode(self.full, sample.title()) == self.encode(self.plain, sample)
        self.forget()

    @staticmethod
    def encode(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Add words that aren't known yet."""
        kept, pools, counts = [self.known], [self.pool], []
        simple = pc.match_substring_regex(words, f"^[A-Za-z]+[{POINTS}]*$") if self.quick else pa.array(np.zeros(len(words), bool))
        quick, rest = words.filter(simple), words.filter(pc.invert(simple))
        marked = pc.match_substring(rest, self.mark)
        plain, odd = rest.filter(pc.invert(marked)), rest.filter(marked)
        cut = pc.replace_substring_regex(pc.ascii_lower(quick), f"([{POINTS}]+)", r" \1")
        ends_each = 1 + pc.match_substring(cut, " ").to_numpy(zero_copy_only=False).astype(np.int64)
        for first in range(0, len(quick), WORDS_AT_ONCE):
            ids = np.array(self.encode(self.plain, " ".join(cut.slice(first, WORDS_AT_ONCE).to_pylist())), np.uint32)
            at = np.flatnonzero(self.ending[ids])[np.cumsum(ends_each[first : first + WORDS_AT_ONCE]) - 1]
            counts.append(np.diff(at, prepend=-1))
            pools.append(ids)
        for first in range(0, len(plain), WORDS_AT_ONCE):
            ids = np.array(self.encode(self.full, f" {self.mark} ".join([*plain.slice(first, WORDS_AT_ONCE).to_pylist(), ""])), np.uint32)
            at = np.flatnonzero(ids == self.mark_id)
            counts.append(np.diff(at, prepend=-1) - 1)
            pools.append(ids[ids != self.mark_id])
        for word in odd.to_pylist():
            pools.append(np.array(self.encode(self.full, word), np.uint32))
            counts.append(np.array([len(pools[-1])]))
        self.known = pa.concat_arrays([*kept, quick, plain, odd])
        self.pool = np.concatenate(pools)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more than texts)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary
        if len(self.known) > WORDS_KEPT:
            self.forget()
        self.learn(names.filter(pc.invert(pc.is_in(names, self.known))))
        which = pc.index_in(names, self.known).to_numpy(zero_copy_only=False)
        codes = which[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.ends[codes + 1] - self.ends[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.ends[codes] - ends[:-1], lengths)]
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
        return ids, ends[words]


@cache
def words_of(path: str) -> Words:
    """The table of a worker process: its tasks share it."""
    return Words(path)


def token_ids(texts: pa.Array, words: Words, end: int = END) -> Iterator[np.ndarray]:
    """The ids of each text, with the end mark."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(texts):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), BLOCK_CHARS, "right")))
        ids, begins = words.ids(texts.slice(first, last - first))
        for a, b in zip(begins[:-1], begins[1:]):
            yield np.append(ids[a:b], np.uint32(end))
        first = last


class Packer:
    """Sum-of-squares packing of pieces (document, start, ids) into sequences of ``length``."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.counts = np.zeros(length + 1, np.int64)  #: open sequences of each fill level; the full ones aren't counted
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def add(self, document: object, ids: np.ndarray) -> Iterator[list]:
        """Place a document; gives the sequences that it fills, as lists of pieces."""
        whole = len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            yield [(document, start, ids[start : start + self.length])]
        if whole < len(ids):
            yield from self.place((document, whole, ids[whole:]))

    def place(self, piece: tuple) -> Iterator[list]:
        size = len(piece[2])
        # the change of the sum of squares, halved: N(level + size) - N(level) + 1 for an open sequence; a full one leaves the sum
        change = self.counts[size:] - self.counts[: self.length + 1 - size] + 1.0
        change[-1] -= 0.5
        change[self.counts[: self.length + 1 - size] == 0] = np.inf
        change[0] = self.counts[size] + 0.5 if size < self.length else 0.0
        ties = np.flatnonzero(change == change.min())
        level = int(ties[-1])  # the fullest of equals
        sequence = []
        if level:
            sequence = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        sequence.append(piece)
        if level + size == self.length:
            yield sequence
            return
        self.keep(level + size, sequence)
        if self.n_open > self.most_open:
            yield from self.settle()

    def keep(self, level: int, sequence: list) -> None:
        self.open[level].append(sequence)
        self.counts[level] += 1
        self.n_open += 1

    def settle(self) -> Iterator[list]:
        """Fill the gaps of the fullest open sequences with pieces of the emptiest, cut where they must be; one at most stays open."""
        left = [(level, s) for level in sorted(self.open) for s in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        low, high = 0, len(left) - 1
        stock: list = []
        while low <= high or stock:
            level, sequence = left[high] if low <= high else (0, [])
            high -= 1
            while level < self.length:
                if not stock:
                    if low > high:
                        break
                    stock = left[low][1][::-1]
                    low += 1
                document, start, ids = stock.pop()
                room = self.length - level
                sequence.append((document, start, ids[:room]))
                if len(ids) > room:
                    stock.append((document, start + room, ids[room:]))
                level += min(room, len(ids))
            if level < self.length:
                self.keep(level, sequence)
                break
            yield sequence

    def finish(self) -> Iterator[list]:
        """Close all: what fills no sequence is cut at the powers of two of its length."""
        yield from self.settle()
        for sequence in [s for level in self.open.values() for s in level]:
            stock = sequence[::-1]
            rest = sum(len(p[2]) for p in sequence)
            while rest:
                size = 1 << (rest.bit_length() - 1)
                rest -= size
                out = []
                while size:
                    document, start, ids = stock.pop()
                    out.append((document, start, ids[:size]))
                    if len(ids) > size:
                        stock.append((document, start + size, ids[size:]))
                    size -= min(size, len(ids))
                yield out
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary: little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a file of the tokenizers library, there on every executor, whose vocabulary drops white space.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = words_of(tokenizer), Packer(length)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        number = task << 33
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        held: list[tuple] = []

        def put(sequences: Iterator[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for (key, tokens), start, ids in sequence:
                    held.append((key, start, len(ids), ids.astype("<u4").tobytes(), tokens, number, offset))
                    offset += len(ids)
                number += 1
                if len(held) >= 1000:
                    yield out()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held.clear()
            return made

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, token_ids(string_array(batch.column(1)), words, end)):
                yield from put(packer.add((key, len(ids)), ids))
        yield from put(packer.finish())
        if held:
            yield out()

    return rows.mapInArrow(packed, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): each sequence's ids as bytes, padded to ``length`` unless its own length is a power of two.

    A sequence has ``length`` ids at most, so its group is bounded.
    """
    listed = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    padding = F.when(F.bit_count("n_tokens") == 1, F.lit("")).otherwise(F.expr(f"repeat(hex(cast(reverse(unhex(lpad(hex({pad}), 8, '0'))) as binary)), cast({length} - n_tokens as int))"))
    return listed.select("sequence_id", F.unhex(F.concat(joined, padding)).alias("ids"), "n_tokens")
