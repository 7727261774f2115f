"""Reference lists and fuzzy title matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import DOI
from folioforge.operators import trigrams
from folioforge.session import materialise

# Headings of a reference list, and starts of its entries.
_HEADING = r"(?im)^\s*(?:\d+\.?\s*)?(?:references|bibliography|works cited)\s*$"
_ENTRY = r"(?:^|\n)\s*(?:\[\d{1,3}\]|\d{1,3}\.)\s+(?=[A-Z])"
MIN_ENTRIES, MAX_ENTRIES, MIN_TITLE = 3, 300, 0.72


def entries(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, entry, doi): entries of the last reference list, where it has three or more."""
    parts = F.split(text, _HEADING)
    tail = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    pieces = F.split(tail, _ENTRY)
    cleaned = F.transform(F.slice(pieces, 2, MAX_ENTRIES), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    found = docs.select("doc_id", F.size(pieces).alias("n"), F.posexplode(cleaned).alias("at", "entry")).where(F.col("n") > MIN_ENTRIES)
    kept = found.where(F.length("entry").between(20, 600))
    return kept.select("doc_id", (F.col("at") + 1).alias("pos"), "entry", F.nullif(F.regexp_extract("entry", DOI, 0), F.lit("")).alias("doi"))


def _trigrams(text: str) -> list[str]:
    out: list[str] = []
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {word} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def word_similarity(title: str, text: str) -> float:
    """Greatest share of the title's trigrams, over those of both, that a stretch of the text's trigrams reaches."""
    want, line = set(_trigrams(title)), _trigrams(text)
    if not want or not line:
        return 0.0
    places = [i for i, g in enumerate(line) if g in want]
    best = 0.0
    for n, start in enumerate(places):
        seen: set[str] = set()
        hit = 0
        last = start
        for stop in places[n:]:
            for g in line[last : stop + 1]:
                if g not in seen:
                    seen.add(g)
                    hit += g in want
            last = stop + 1
            best = max(best, hit / (len(want) + len(seen) - hit))
            if len(seen) - hit > len(want):
                break
    return best


def best_titles(refs: DataFrame, titles: DataFrame, least: float = MIN_TITLE) -> DataFrame:
    """(ref_id, title_id, similarity): each reference's best title of similarity ``least`` or more, misspelt ones too.

    Equal references and equal titles are compared once; of equal titles the least id stands for all, as ties go to it.
    """
    lines = materialise(refs.groupBy("reference").agg(F.min("ref_id").alias("id")).select("id", F.col("reference").alias("text")), "references")
    names = materialise(titles.groupBy("title").agg(F.min("title_id").alias("id")).select("id", F.col("title").alias("text")), "titles")
    scored = trigrams.similar(lines, names, least, word_similarity)
    best = scored.groupBy(F.col("text_id").alias("id")).agg(F.min(F.struct((-F.col("similarity")).alias("less"), "title_id")).alias("best"))
    by_text = best.join(lines, "id").select(F.col("text").alias("reference"), "best")
    found = refs.join(by_text, "reference").groupBy("ref_id").agg(F.min("best").alias("best"))
    return found.select("ref_id", F.col("best.title_id").alias("title_id"), (-F.col("best.less")).alias("similarity"))


#: Words of a title by which it is looked up, and characters below which a title names nothing.
HEAD_WORDS, SHORTEST = 4, 10


def _named(text: Column) -> Column:
    """Letters and digits of a text in lower case, a space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def named_titles(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(question_id, title_id): the titles that a question names as whole words, a leading article aside.

    ``questions`` (question_id, question), ``titles`` (title_id, title).  Titles are met by a hash of their first words, up to
    ``HEAD_WORDS``, with the runs of words of the questions, and the few that meet are looked for in full; so it is a join by equality,
    and no title is compared with a question that lacks its first words.  Equal titles are met once, and a question's text goes only
    with what is to be looked for in it.  Titles of fewer than ``SHORTEST`` characters, with or without
    the article, name nothing; null is an empty text.
    """
    bare = F.regexp_replace(_named(F.col("title")), "^(the|a|an) ", "")
    long_ = titles.where(F.length("title") >= SHORTEST).select("title_id", bare.alias("bare")).where(F.length("bare") >= SHORTEST)
    keyed = long_.select("bare").distinct().select("bare", F.xxhash64(F.slice(F.split("bare", " "), 1, HEAD_WORDS)).alias("head"))
    asked = questions.select("question_id", _named(F.col("question")).alias("asked"))
    runs = lambda words, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))
    # the words are bound by a lambda: put into the inner ones as they are, they would be split anew for every run
    every = F.transform(F.array(F.split("asked", " ")), lambda words: F.array_distinct(F.flatten(F.array(*(runs(words, n) for n in range(1, HEAD_WORDS + 1))))))
    heads = asked.select("question_id", F.explode(every[0]).alias("head"))
    # far more rows than their table's size tells, so they aren't to be broadcast
    met = heads.join(keyed.hint("merge"), "head").select("question_id", "bare")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    found = met.join(asked, "question_id").where(padded("asked").contains(padded("bare"))).select("question_id", "bare")
    return found.join(long_, "bare").select("question_id", "title_id").distinct()


def same_source(title: Column, source: Column) -> Column:
    """Whether a source, named as "title — what it is about" with the title perhaps cut short, is a volume's title."""
    clean = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+\z", ""))
    name, own = clean(F.split(F.coalesce(source, F.lit("")), " — ", 2)[0]), clean(title)
    cut = (F.length(name) >= 12) & (own.startswith(name) | name.startswith(own))
    return (name != "") & (own != "") & ((own == name) | cut)


def closeness(text: Column, wanted: Column) -> Column:
    """2 for texts that are equal but for white space, else the share of the words of both that they have in common, case aside."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    flat = lambda c: F.array_join(words(c), " ")
    a, b = (F.array_distinct(words(F.lower(c))) for c in (text, wanted))
    either = F.size(F.array_union(a, b))
    return F.when(flat(text) == flat(wanted), 2.0).when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def evidence(rows: DataFrame, wanted: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, score): of each group's rows (group, key, title, text) whose title the wanted source (group, source, claim) is, the one closest to the claim; ties to the least key."""
    met = rows.join(wanted.select(group, "source", "claim"), group).where(same_source(F.col("title"), F.col("source")))
    score = F.round(closeness(F.col("text"), F.col("claim")), 9)
    best = met.groupBy(group, "source", "claim").agg(F.min(F.struct((-score).alias("less"), key)).alias("_best"))
    return best.select(group, F.col(f"_best.{key}").alias(key), (-F.col("_best.less")).alias("score"))
