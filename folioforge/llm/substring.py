"""Repeated-passage removal by hashing lines, and the parts of lines.

Every line of ``LINE_WORDS`` words or more is a unit.  Whole lines miss passages
that sit inside longer lines, so lines of ``MIN_WORDS`` or more are hashed in
parts that cover them, cut at local marks: line ends, sentence ends, the first
capital of a run, and words whose hash is divisible by ``MARK_EVERY``.  From each
mark a unit of at least ``MIN_WORDS`` words runs to the next mark (``MAX_WORDS``
at most), and one runs back from each line's end.  Those marks are sparse in
texts without capitals and sentence ends, and differ where lines are wrapped
otherwise.  So a second kind of parts runs between marks of their own: the words
that have the least hash of some window of ``WINDOW`` words.  A passage's windows
choose alike wherever it stands: one of ``MIN_WORDS + 2 * WINDOW - 1`` words (50)
or more is sure to hold such a unit, whatever its script, case and line breaks
and the text around it.

Equal units get equal digests (64 bits over words in ASCII lower case; white space doesn't count).

Digests are grouped globally, pre-aggregated to their first and last holder; a
digest that many rows hold is split where the units meet its holder (a skewed
join whose other side has one row a digest).  The earliest occurrence stays, by doc_id, then
by the text's hash and then by offset; every other one is removed unless it overlaps the first
occurrence in the same text.  Removed units that touch are merged, and their
character offsets in the original text are kept.

Defined results: null, empty and short texts have no unit and stay as they are;
rows that repeat a doc_id and its text are one document and keep the same
parts; different texts under one doc_id are documents of their own, told apart
by ``text_hash``; a null doc_id ranks last and is reported as null; all text
outside the spans stays as it was; other columns, whatever their names, pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import textcore
from folioforge.session import bound_batches, materialise

MIN_WORDS, MAX_WORDS, MARK_EVERY = 25, 50, 32
#: Words of the shortest line that is a unit as a whole.
LINE_WORDS = 25
#: Words of a window that is sure to hold a mark.
WINDOW = 13
_LAST = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.zeros(256, bool)
_END[[0x2E, 0x21, 0x3F]] = True


def _marks(block: textcore.Block, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, row_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words at which a unit may begin, each row's end among them; and of those at which a line does."""
    data, n = block.data, len(starts)
    follow = data[np.minimum(starts + 1, len(data) - 1)]
    head = data[starts]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97))
    mark = np.zeros(n + 1, bool)
    mark[:n] = hashes % np.uint64(MARK_EVERY) == 0
    mark[:n] |= capital
    mark[1:n] &= ~capital[1:] | ~capital[:-1] | (hashes[1:] % np.uint64(MARK_EVERY) == 0)
    mark[1:n] |= _END[data[ends[:-1] - 1]]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    line = np.zeros(n + 1, bool)
    line[1:n] = lines[starts[1:]] > lines[ends[:-1]]
    line[row_words] = True
    return np.flatnonzero(mark | line), np.flatnonzero(line)


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``size`` consecutive values."""
    out, held = values, 1
    while held < size:
        step = min(held, size - held)
        out = pick(out[: len(out) - step], out[step:])
        held += step
    return out


def _window_marks(hashes: np.ndarray, row_words: np.ndarray, size: int) -> np.ndarray:
    """Indices of the words that have the least hash of some window of ``size`` words of their row."""
    if len(hashes) < size:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, size, np.minimum)
    row = np.repeat(np.arange(len(row_words) - 1), np.diff(row_words))
    least[row[: len(least)] != row[size - 1 :]] = 0
    none = np.zeros(size - 1, np.uint64)
    return np.flatnonzero((_sliding(np.concatenate([none, least, none]), size, np.maximum) == hashes) & (hashes > 0))


def _units_of(block: textcore.Block, min_words: int, max_words: int, line_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest, start and end character of each unit of a block."""
    starts, ends, row_words = block.words()
    none = np.zeros(0, np.int64)
    if len(starts) < min(min_words, line_words):
        return none, none.astype(np.uint64), none, none
    lowered = textcore.Block(block.first, block.last, _LOWER[block.data], block.offsets)
    hashes = lowered.hashes(starts, ends)
    marks, lines = _marks(block, starts, ends, hashes, row_words)
    begin = marks[marks < len(starts)]
    row = np.searchsorted(row_words, begin, "right") - 1
    stop = marks[np.minimum(np.searchsorted(marks, begin + min_words), len(marks) - 1)]
    stop = np.minimum(stop, np.minimum(begin + max_words, row_words[row + 1]))
    # the units that end a line, back to the last mark that gives them enough words
    close = lines[lines >= min_words]
    last_row = np.searchsorted(row_words, close - 1, "right") - 1
    back = np.maximum(marks[np.searchsorted(marks, close - min_words, "right") - 1], close - max_words)
    # the units between least words, which line ends and capitals don't touch
    chosen = _window_marks(hashes, row_words, WINDOW)
    whole = np.append(chosen, 1 << 62)[np.searchsorted(chosen, chosen + min_words)]
    whole = np.minimum(whole, chosen + max_words)
    chosen_row = np.searchsorted(row_words, chosen, "right") - 1
    ends_inside = whole < row_words[chosen_row + 1]
    chosen, whole, chosen_row = chosen[ends_inside], whole[ends_inside], chosen_row[ends_inside]
    begin = np.concatenate([begin, np.maximum(back, row_words[last_row]), chosen])
    stop, row = np.concatenate([stop, close, whole]), np.concatenate([row, last_row, chosen_row])
    fits = stop - begin >= min_words
    # whole lines; longer ones are covered by the units above
    length = np.diff(lines)
    short = np.flatnonzero((length >= line_words) & (length < min_words))
    begin, stop, fits = np.concatenate([begin, lines[short]]), np.concatenate([stop, lines[short + 1]]), np.concatenate([fits, np.ones(len(short), bool)])
    row = np.concatenate([row, np.searchsorted(row_words, lines[short], "right") - 1])
    _, once = np.unique(begin[fits] * (len(starts) + 1) + stop[fits], return_index=True)
    begin, stop, row = begin[fits][once], stop[fits][once], row[fits][once]
    forward, back = textcore._power_tables(len(hashes))
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * forward[: len(hashes)], out=prefix[1:])
    digest = textcore.mix((prefix[stop] - prefix[begin]) * back[begin] + (stop - begin).astype(np.uint64))
    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    base = chars[block.offsets[row]]
    return row, digest, chars[starts[begin]] - base, chars[ends[stop - 1]] - base


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, line_words: int = LINE_WORDS, known: DataFrame | None = None) -> DataFrame:
    """(digest, doc_id, text_hash, start, end, again): units of every text; ``again`` marks later, disjoint ones of the same text, merged.

    ``text_hash`` is 0 where one text alone has the doc_id (``known``: see ``_texts_by_rank``), so that it takes no room there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for block in textcore.blocks(batch.column(2)):
                row, digest, start, end = _units_of(block, min_words, max_words, line_words)
                if not len(row):
                    continue
                order = np.lexsort((start, digest, row))
                row, digest, start, end = row[order], digest[order], start[order], end[order]
                lead = np.ones(len(row), bool)
                lead[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
                first = np.maximum.accumulate(np.where(lead, np.arange(len(row)), 0))
                again = ~lead & (start >= end[first])
                # later occurrences go whatever others hold: merged here, under digests that meet nothing
                later = np.flatnonzero(again)[np.lexsort((start[again], row[again]))]
                reach = np.maximum.accumulate(row[later] * (1 << 40) + end[later])
                head = np.ones(len(later), bool)
                head[1:] = row[later][1:] * (1 << 40) + start[later][1:] > reach[:-1] + 1
                if len(later):
                    end[later[head]] = np.maximum.reduceat(end[later], np.flatnonzero(head))
                    digest[later] = textcore.mix((ids ^ hashes)[block.first + row[later]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[later].astype(np.uint64))
                use = lead
                use[later[head]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[use].astype(np.int64)), *(pa.array(x[block.first + row[use]]) for x in (ids, hashes)), pa.array(start[use].astype(np.int32)), pa.array(end[use].astype(np.int32)), pa.array(again[use])],
                    names=["digest", "doc_id", "text_hash", "start", "end", "again"],
                )

    bound_batches(docs.sparkSession)
    rank = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST))
    own = F.xxhash64(text)
    rows = docs.select(rank.alias("doc_id"), F.when(rank == _LAST, own).otherwise(F.lit(0)).alias("text_hash"), F.col(text).alias("text"))
    known = _texts_by_rank(docs, doc_id, text) if known is None else known
    shared = known.where(f"hash <> other and doc_id <> {_LAST}")
    if shared.limit(1).count():
        rows = rows.join(shared.select("doc_id", "hash"), "doc_id", "left").select("doc_id", F.when(F.col("hash").isNotNull(), F.xxhash64("text")).otherwise(F.col("text_hash")).alias("text_hash"), "text")
    return rows.mapInArrow(run, "digest bigint, doc_id bigint, text_hash bigint, start int, end int, again boolean")


def _texts_by_rank(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, hash, other): least and greatest hash of the texts under each doc_id."""
    rank = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST))
    hashed = docs.select(rank.alias("doc_id"), F.xxhash64(text).alias("h"))
    return hashed.groupBy("doc_id").agg(F.min("h").alias("hash"), F.max("h").alias("other"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, start, end, first_doc_ids, text_hash): merged spans to remove, and the documents that keep their first occurrences."""
    known = materialise(_texts_by_rank(docs, doc_id, text), "ranks")
    found = units(docs, doc_id, text, min_words, max_words, line_words, known)
    # least and greatest holder: enough to tell a digest that repeats, and summed up before the shuffle
    holder = F.struct("doc_id", "text_hash")
    firsts = found.where("not again").groupBy("digest").agg(F.min(holder).alias("first"), F.max(holder).alias("last")).where("first <> last").select("digest", "first")
    firsts = materialise(firsts, "firsts")
    joined = found.join(firsts, "digest", "left").where(F.col("again") | (holder > F.col("first")))
    spans = joined.select("doc_id", "text_hash", "start", "end", F.when(F.col("again"), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("first")).distinct()
    ordered = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", "first")
    before, running = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.unboundedPreceding, 0)
    marked = spans.withColumn("gap", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1)) + 1).cast("int"))
    numbered = marked.withColumn("span", F.sum("gap").over(running))
    merged = numbered.groupBy("doc_id", "text_hash", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("first")).alias("first_doc_ids"))
    single = known.where("hash = other").select("doc_id", "hash")
    own = F.when(F.col("text_hash") == 0, F.coalesce("hash", "text_hash")).otherwise(F.col("text_hash"))
    no_id = lambda x: F.nullif(x, F.lit(_LAST))
    return merged.join(single, "doc_id", "left").select(no_id("doc_id").alias("doc_id"), "start", "end", F.transform("first_doc_ids", no_id).alias("first_doc_ids"), own.alias("text_hash"))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the spans; text, and n_chars where there is one, follow; what lies outside the spans stays character by character."""
    rank = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST))
    lists = spans.groupBy(rank.alias("_rank"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    pieces = F.expr(
        "concat_ws('', transform(sequence(0, size(_cut)), i -> "
        "substring(text, if(i = 0, 0, get(_cut, i - 1).end) + 1, if(i = size(_cut), length(text), get(_cut, i).start) - if(i = 0, 0, get(_cut, i - 1).end))))"
    )
    out = docs.withColumns({"_rank": rank, "_hash": F.xxhash64("text")}).join(lists, ["_rank", "_hash"], "left").withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(pieces))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*docs.columns)
