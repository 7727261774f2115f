"""Guards over texts that a model wrote: placeholders, echoes, verdicts, quotes, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields filled with their own names, and explanations by what they say.
PLACEHOLDER = (
    r"(?i)^[.…\s]*$|^(string|text|summary|todo|n/a)$"
    r"|^(the |a |your )?(theme|topic|document|section)?\s*(name|label|title|summary)( here| goes here)?\.?$"
)
DENIES = (
    r"(?i)\b(not|no|never)\s+(in\s+)?(genuine(ly)?\s+|direct(ly)?\s+|actual(ly)?\s+)?(conflict|contradict|disagree|incompatible|inconsisten)"
    r"|\b(are|is|remain)\s+(fully\s+|entirely\s+|mutually\s+)?(compatible|consistent|complementary)\b"
)
AFFIRMS = (
    r"(?i)\b(claims|sources|statements|they|these|both)\s+(directly\s+|clearly\s+)?(conflict|contradict|disagree)|\b(conflict|contradict)s?\s+because\b"
    r"|\b(are|is)\s+(mutually\s+|directly\s+)?(incompatible|contradictory|mutually exclusive)\b|\b(are|is)\s+in\s+(direct\s+)?(conflict|contradiction)\b"
)
HEDGES = r"(?i)\b(seem|seems|appear|appears|superficial(ly)?|at first|might|may|could|if)\b"
INSTRUCTION = r"(?i)^\s*(explain|state|describe|return|provide|give|write|list|say|identify|note)\b"
MOVED = r"(?i)\b(content|page|section)s?\b.{0,40}\b(moved|relocated)\b"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def is_placeholder(value: Column) -> Column:
    """True for a field that holds its own name or nothing; null for null."""
    return F.trim(value).rlike(PLACEHOLDER)


def echoes(value: Column, prompt: Column, least: int = 30) -> Column:
    """True for a field whose beginning is lifted from the prompt."""
    start = F.lower(F.substring(F.trim(value), 1, 120))
    return (F.length(F.trim(value)) >= least) & F.lower(prompt).contains(start)


def denies(text: Column) -> Column:
    """True where an explanation says that there is no conflict."""
    return F.coalesce(F.substring(text, 1, 400).rlike(DENIES), F.lit(False))


def affirms(text: Column) -> Column:
    """True where a sentence asserts a conflict without a hedge before the assertion, and none denies it."""
    parts = F.split(F.substring(text, 1, 400), r"[.\n]")
    upto = F.transform(parts, lambda s: F.regexp_extract(s, f"(?s)^.*?(?:{AFFIRMS})", 0))
    plain = F.exists(upto, lambda s: (s != "") & ~s.rlike(HEDGES))
    return F.coalesce(plain & ~denies(text), F.lit(False))


def is_junk(text: Column) -> Column:
    """True for explanations that are short, repeat an instruction, or speak of moved pages."""
    return F.coalesce((F.length(F.trim(text)) < 40) | text.rlike(INSTRUCTION) | F.substring(text, 1, 300).rlike(MOVED), F.lit(True))


def quoted(claim: Column, claims: Column) -> Column:
    """The claim without a leading ``[Title]`` where its first 60 characters stand in the claims given; else empty."""
    bare = F.trim(F.regexp_replace(claim, r"^\s*\[[^\]]*\]\s*", ""))
    held = (bare != "") & F.lower(F.array_join(claims, "\n")).contains(F.lower(F.substring(bare, 1, 60)))
    return F.when(held, bare).otherwise("")


def plain_label(text: Column) -> Column:
    """A label without tags, emphasis and code marks."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")
    for mark in (r"\*\*(.+?)\*\*", "__(.+?)__", "~~(.+?)~~", "`([^`]+)`"):
        out = F.regexp_replace(out, mark, "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def cited(text: Column) -> Column:
    """Numbers cited in ``[n, m]``, in order."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.try_cast("int"))


def valid_citations(text: Column, sources: int) -> Column:
    """The text with each citation group reduced to numbers that name a source; groups of none go, with the space before."""
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, "\x01$1\x02"), "\x01")

    def redo(piece: Column) -> Column:
        numbers = F.split(F.substring_index(piece, "\x02", 1), r"\s*,\s*")
        kept = F.filter(numbers, lambda n: n.try_cast("int").between(1, sources))
        return F.concat(F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))).otherwise(""), F.substring_index(piece, "\x02", -1))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), redo)
    return F.trim(F.regexp_replace(F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, "")), r" +(?=[.,;:]|$)|(?<= ) +", ""))


def parts(pieces: Column, limit: int) -> Column:
    """Passages grouped in order into parts of at most ``limit`` characters; a longer passage is cut to it."""
    start = F.array().cast("array<string>")
    cut = F.transform(pieces, lambda p: F.substring(p, 1, limit))

    def add(acc: Column, piece: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.length(last) + F.length(piece) + 2 <= limit)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), piece)))
        return F.when(F.size(acc) == 0, F.array(piece)).when(joins, joined).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(cut, start, add)


def documented(command: Column, known: Column, generic: Column) -> Column:
    """Whether a command is a generic tool's, or begins like a known one: two words alike, and a third that is missing, alike, or a flag in neither; blank or null: false."""
    words = F.filter(F.split(F.coalesce(command, F.lit("")), r"\s+"), lambda w: w != "")

    def like(other: Column) -> Column:
        theirs = F.filter(F.split(other, r"\s+"), lambda w: w != "")
        third, their_third = F.get(words, F.lit(2)), F.get(theirs, F.lit(2))
        free = third.isNull() | their_third.isNull() | (third == their_third) | ~(third.startswith("-") | their_third.startswith("-"))
        return (F.slice(words, 1, 2) == F.slice(theirs, 1, 2)) & free

    return (F.size(words) > 0) & (F.coalesce(F.array_contains(generic, F.get(words, F.lit(0))), F.lit(False)) | F.exists(known, like))
