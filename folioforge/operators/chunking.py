"""Document structure: clean text, sections with breadcrumbs, token-bounded passages with exact spans.

Everything works on spans of the cleaned text, so a passage is a slice of it
and its span is exact by construction.  The places where lines, paragraphs,
sentences and tokens begin are found once per text as sorted arrays; sections,
windows and passages are cut by searching these.  Tokens are words and marks, a
count that needs no vocabulary file.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import bound_batches

# Fixed values of the section and passage sizes.
TARGET_TOKENS, OVERLAP_TOKENS, MIN_TOKENS = 600, 72, 80
FRONT_MATTER_CHARS, PRUNE_CHARS, WINDOW_CHARS, RUNT_CHARS = 400, 120, 6000, 200
SPLIT_OVER_CHARS, PART_CHARS = 9000, 6000
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PARAGRAPH = re.compile(r"\n\s*\n")
_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
# Headings by number, in capitals, and in Markdown; rules for them.
_NUMBERED = re.compile(r"[ \t]*(\d+(?:\.\d+){0,3})\.?[ \t]+([A-Z].{2,70}?)[ \t]*")
_CAPITALS = re.compile(r"[ \t]*([A-Z][A-Z0-9 \t&/-]{3,50})[ \t]*")
_MARKDOWN = re.compile(r"(#{1,6})[ \t]+(.+?)[ \t#]*")
_FENCE = re.compile(r"```|~~~")
HEADING_GAP, LEAST_HEADINGS = 25, 3
#: Words of a title that are looked for; no title has more, and a pattern of a whole page would overflow the stack.
TITLE_WORDS = 24
_LOOKS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "­": ""}


def normalise(text: str) -> str:
    """Clean text: no control characters, compatibility forms, words and lines rejoined, blanks collapsed."""
    text = re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", text)
    text = unicodedata.normalize("NFKC", text.translate(str.maketrans(_LOOKS)))
    text = re.sub(r"(?<=\w)-\n(?=\w)", "", text)
    text = re.sub(r"(?<![\n.!?:])\n(?!\s)", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _lines(text: str) -> list[tuple[int, str]]:
    """Place and text of each line."""
    lines = text.split("\n")
    return list(zip(accumulate((len(x) + 1 for x in lines[:-1]), initial=0), lines, strict=True))


def _fenced(lines: list[tuple[int, str]]) -> list[bool]:
    """Whether each line is in a code block that a later fence closes."""
    marks = [bool(_FENCE.match(x)) for _, x in lines]
    closed = sum(marks) // 2 * 2
    return [seen % 2 == 1 and seen < closed or mark and seen <= closed for seen, mark in zip(accumulate(marks), marks, strict=True)]


def _plain_heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a line that is a heading by its number or its capitals."""
    if (m := _NUMBERED.fullmatch(line)) and m[2][-1] not in ".,;" and len(m[2].split()) <= 12:
        return m[1].count(".") + 1, f"{m[1]} {m[2]}"
    if (m := _CAPITALS.fullmatch(line)) and len(m[1].split()) <= 6 and re.search(r"[A-Z]{5,}", m[1]):
        return 1, m[1].strip().title()
    return None


def headings(text: str) -> list[tuple[int, int, str]]:
    """(place, level, title) of the headings: Markdown's where there is one, else numbered and capital lines, three or more."""
    lines = _lines(text)
    marked = [(at, m) for (at, x), code in zip(lines, _fenced(lines), strict=True) if not code and (m := _MARKDOWN.fullmatch(x))]
    if marked:
        return [(at, len(m[1]), m[2].strip()) for at, m in marked]
    plain = [(at, *found) for at, x in lines if (found := _plain_heading(x))]
    # of those close to a kept one the next is the first beyond the gap
    places, kept, i = [at for at, *_ in plain], [], 0
    while i < len(plain):
        kept.append(plain[i])
        i = bisect_right(places, places[i] + HEADING_GAP)
    return kept if len(kept) >= LEAST_HEADINGS else []


def _cuts(ends: list[int], start: int, stop: int, size: int) -> list[int]:
    """From ``start`` on, each first one of ``ends`` at least ``size`` after the cut before, up to ``stop``."""
    cuts = [start]
    while (i := bisect_left(ends, cuts[-1] + size)) < len(ends) and ends[i] <= stop:
        cuts.append(ends[i])
    return cuts


def _windows(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """Spans of about WINDOW_CHARS that end at paragraphs; a runt joins the one before."""
    cuts = _cuts(ends, 0, len(text), WINDOW_CHARS)
    if len(cuts) > 1 and len(text) - cuts[-1] < RUNT_CHARS:
        cuts.pop()
    return list(pairwise([*cuts, len(text)]))


def _parts(ends: list[int], start: int, stop: int) -> list[tuple[int, int]]:
    """A long span cut at paragraphs, or at equal distances where there is none; the last part has a third of one's size at least."""
    if stop - start <= SPLIT_OVER_CHARS:
        return [(start, stop)]
    last = stop - PART_CHARS // 3
    cuts = _cuts(ends, start, last, PART_CHARS)
    if len(cuts) == 1:
        cuts = [start + PART_CHARS * i for i in range(-(-(last - start) // PART_CHARS))]
    return list(pairwise([*cuts, stop]))


def _outline(levels: list[int]) -> list[int | None]:
    """For each row the nearest one before it with a lesser level that no row between shuts off."""
    parents, latest = [], {}
    for i, level in enumerate(levels):
        latest = {lv: j for lv, j in latest.items() if lv < level}
        parents.append(latest[max(latest)] if latest else None)
        latest[level] = i
    return parents


def sections(text: str, found: list[tuple[int, int, str]] | None = None) -> list[tuple[str | None, int, int, int, str]]:
    """(title, level, start, stop, path) of every section in order; ``found``: headings from elsewhere, such as a located table of contents."""
    if not text.strip():
        return []
    found = headings(text) if found is None else found
    ends = [m.end() for m in _PARAGRAPH.finditer(text)]
    front = [(0, 1, "Front matter")] if found and found[0][0] > FRONT_MATTER_CHARS else []
    # each heading with the one after it; short sections go, unless something deeper follows
    beside = pairwise([*front, *found, (len(text), 0, None)])
    rows = [(title, level, start, stop) for (start, level, title), (stop, after, _) in beside if after > level or stop - start >= PRUNE_CHARS]
    rows = rows or [(None, 1, *x) for x in _windows(text, ends)]
    paths: list[str] = []
    out = []
    for (title, level, start, stop), parent in zip(rows, _outline([r[1] for r in rows]), strict=True):
        above = paths[parent] if parent is not None else ""
        paths.append(" › ".join(x for x in (above, title) if x))
        for n, (a, b) in enumerate(_parts(ends, start, stop), 1):
            name = f"{title} (cont. {n})" if title and n > 1 else title
            out.append((name, level, a, b, " › ".join(x for x in (above, name) if x)))
    return out


class Places:
    """Where the tokens, words, paragraphs and sentences of a text begin and end."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.start() for m in _TOKEN.finditer(text)]

    @cached_property
    def words(self) -> list[int]:
        return [m.start() for m in _WORD.finditer(self.text)]

    def count(self, start: int, stop: int) -> int:
        """Tokens in a span, those that it cuts among them."""
        first = bisect_left(self.tokens, start)
        cut = 0 < start < stop and not (first < len(self.tokens) and self.tokens[first] == start) and _TOKEN.match(self.text, start) is not None
        return bisect_left(self.tokens, stop) - first + cut

    def pieces(self, gap: re.Pattern, start: int, stop: int) -> list[tuple[int, int]]:
        """The spans between the gaps, without blanks at their ends; empty ones left out."""
        edges = [start, *(x for m in gap.finditer(self.text, start, stop) for x in m.span()), stop]
        out = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            piece = self.text[a:b]
            out.append((a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())))
        return [(a, b) for a, b in out if a < b]

    def upto(self, spans: list[tuple[int, int]]) -> list[int]:
        """Tokens of the spans before each one, and of all."""
        return list(accumulate((self.count(*x) for x in spans), initial=0))

    @staticmethod
    def fit(upto: list[int], i: int, room: int) -> int:
        """Index after the last of the spans from ``i`` on that fit the room together; one is always taken."""
        return max(i + 1, bisect_right(upto, upto[i] + room) - 1)

    def segments(self, start: int, stop: int) -> list[tuple[int, int]]:
        """Paragraphs; of those beyond the target the sentences, joined up to it, and over-long ones cut at tokens."""
        out: list[tuple[int, int]] = []
        for a, b in self.pieces(_PARAGRAPH, start, stop):
            if self.count(a, b) <= TARGET_TOKENS:
                out.append((a, b))
                continue
            said = self.pieces(_SENTENCE, a, b)
            upto, j = self.upto(said), 0
            while (i := j) < len(said):
                j = self.fit(upto, i, TARGET_TOKENS)
                c, d = said[i][0], said[j - 1][1]
                size = self.count(c, d)
                if size <= 1.5 * TARGET_TOKENS:
                    out.append((c, d))
                else:
                    low = bisect_left(self.tokens, c)
                    cuts = [c, *self.tokens[low + TARGET_TOKENS : bisect_left(self.tokens, d) : TARGET_TOKENS], d]
                    out += [(x, x + len(self.text[x:y].rstrip())) for x, y in pairwise(cuts)]
        return out

    def tail(self, start: int, stop: int) -> int:
        """Where the last OVERLAP_TOKENS words of a span begin."""
        low, high = bisect_left(self.words, start), bisect_left(self.words, stop)
        return self.words[high - OVERLAP_TOKENS] if high - low > OVERLAP_TOKENS else start

    def packed(self, start: int, stop: int) -> list[tuple[int, int]]:
        """Spans of segments up to the target, each beginning with the last one's tail; a runt joins the one before."""
        segments = self.segments(start, stop)
        out: list[tuple[int, int]] = []
        upto, j = self.upto(segments), 0
        while (i := j) < len(segments):
            back = self.tail(*out[-1]) if out else segments[0][0]
            held = self.count(back, out[-1][1]) if out else 0
            j = self.fit(upto, i, TARGET_TOKENS - held)
            out.append((back, segments[j - 1][1]))
        if len(out) > 1 and self.count(out[-2][1], out[-1][1]) < MIN_TOKENS:
            out[-2:] = [(out[-2][0], out[-1][1])]
        return out


def passages(text: str) -> list[tuple[int, str, int, int, int]]:
    """(section, path, start, stop, tokens): segments packed to the target, never over a section's end."""
    places = Places(text)
    return [(number, path, a, b, places.count(a, b)) for number, (_, _, start, stop, path) in enumerate(sections(text)) for a, b in places.packed(start, stop)]


def located(text: Column, title: Column, hint: Column | None = None) -> Column:
    """Place of a table of contents' title (by its first TITLE_WORDS words) in the text: a line that begins with it, a number before it or not; else with its first four words; -1 where none does.

    ``hint`` is where it is expected: it is looked for from 400 characters before to 12,000 after, and then everywhere.
    """
    clean = F.trim(F.regexp_replace(title, r"\s+", " "))
    quoted = lambda t: F.concat(F.lit(r"(?im)^[ \t]*(?:\d+(?:\.\d+)*\.?[ \t]+)?"), F.regexp_replace(F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1"), " ", r"\\s+"))
    words = F.split(clean, " ")
    patterns = [quoted(F.array_join(F.slice(words, 1, TITLE_WORDS), " ")), F.when(F.size(words) > 4, quoted(F.array_join(F.slice(words, 1, 4), " ")))]
    places = []
    for low, body in ([(F.greatest(hint - 400, F.lit(0)), None)] if hint is not None else []) + [(F.lit(0), text)]:
        held = text.substr(low.cast("int") + 1, F.lit(12_400)) if body is None else body
        places += [F.when((F.trim(clean) != "") & (F.regexp_instr(held, p) > 0), F.regexp_instr(held, p) - 1 + low) for p in patterns]
    return F.coalesce(*places, F.lit(-1)).cast("int")


def page_of(offset: Column, starts: Column) -> Column:
    """Number, from 1, of the page that an offset lies on; ``starts`` are the pages' first offsets in order."""
    return F.nullif(F.size(F.filter(starts, lambda s: s <= offset)), F.lit(0))


def as_read(made: DataFrame) -> DataFrame:
    """(doc_id, path, text): a document's sections in order, each its passages without the words that two of them share.

    Sections are told apart by their number; a passage's overlap is cut by its span, not by comparing words.
    """
    order = Window.partitionBy("doc_id", "section").orderBy("order_index")
    fresh = F.greatest(F.coalesce(F.lag("char_end").over(order), F.lit(0)) - F.col("char_start"), F.lit(0))
    piece = F.struct("order_index", F.expr("substring(text, fresh + 1)").alias("t"), (F.col("fresh") > 0).alias("joins"))
    listed = made.withColumn("fresh", fresh).groupBy("doc_id", "section", "path").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    text = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, F.when((a == "") | x["joins"], "").otherwise("\n\n"), x["t"]))
    return listed.select("doc_id", "section", "path", text.alias("text"))


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text cleaned; null stays null."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if t is None else normalise(t) for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string")


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, order_index, section, path, text, n_tokens, char_start, char_end) of every cleaned text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                clean = normalise(text or "")
                rows += [(doc_id, n, section, path, clean[a:b], tokens, a, b) for n, (section, path, a, b, tokens) in enumerate(passages(clean))]
            yield pd.DataFrame(rows, columns=["doc_id", "order_index", "section", "path", "text", "n_tokens", "char_start", "char_end"])

    made = docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, order_index int, section int, path string, text string, n_tokens int, char_start int, char_end int")
    # content-addressed: the same span of the same document has the same id
    return made.withColumn("chunk_id", F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("char_start").cast("string"), F.col("char_end").cast("string"))))


def check_spans(docs: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_exact): passages that equal their span, white space aside."""
    dense = lambda c: F.regexp_replace(c, r"\s+", "")
    texts = normalised(docs).withColumnRenamed("text", "whole")
    pairs = made.join(texts, "doc_id")
    span = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(dense(span) == dense(F.col("text"))).alias("n_exact"))


def without_overlap(made: DataFrame) -> DataFrame:
    """(doc_id, order_index, text): each passage without the longest run of 8 to 400 words that ends the one before."""
    order = Window.partitionBy("doc_id").orderBy("order_index")
    words = F.array_remove(F.split("text", r"\s+"), "")
    rows = made.select("doc_id", "order_index", words.alias("w")).withColumn("before", F.lag("w").over(order))
    sizes = F.sequence(F.least(F.lit(400), F.size("before"), F.size("w")), F.lit(8), F.lit(-1))
    # the ends of a run are compared first: few runs are cut out and compared in full
    ends = lambda n: (F.get("before", F.size("before") - n) == F.get("w", F.lit(0))) & (F.get("before", F.size("before") - 1) == F.get("w", n - 1))
    fits = F.filter(sizes, lambda n: F.when(ends(n), F.slice("before", F.size("before") - n + 1, n) == F.slice("w", 1, n)).otherwise(False))
    cut = F.when(F.least(F.size("before"), F.size("w")) >= 8, F.coalesce(F.get(fits, F.lit(0)), F.lit(0))).otherwise(0)
    return rows.withColumn("cut", F.coalesce(cut, F.lit(0))).select("doc_id", "order_index", F.array_join(F.slice("w", F.col("cut") + 1, F.greatest(F.size("w"), F.lit(1))), " ").alias("text"))
