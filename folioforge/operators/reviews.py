"""Blind review packets: what a model judged, handed to a reviewer without its marks, and the answers taken back as cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of question that a reviewer may name, and the space of names that packets' ids come from (the URL space of RFC 4122).
TYPES = ("exact", "concept", "mechanism", "multi_hop", "synthesis", "negation", "conflict", "unanswerable")
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
PASSAGE_CHARS, NOTE_CHARS, NAME_CHARS, ID_DIGITS = 2000, 500, 20, 12


def item_id(question: Column) -> Column:
    """First twelve digits of the version 5 UUID of a question, all before the version's own digit."""
    return F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(question, "UTF-8"))), 1, ID_DIGITS)


def same_question(question: Column) -> Column:
    """A question as it is looked up: white space around it and case aside."""
    return F.lower(F.regexp_replace(question, r"^\s+|\s+\z", ""))


def packet(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, question, source, label, chunk_id, title, text): a row per passage of the questions that a model judged.

    ``cases`` (case_id, question, source, judge, pooled); ``passages`` (chunk_id, title, text).  Pooled passages that
    aren't held any more are left out, the others numbered P1, P2, .. in the order in which they were shown.  Neither
    marks nor judge are told.  Null questions and empty pools give no item.  A pool is one search's, so its window is short.
    """
    shown = cases.where((F.col("judge") == "model") & F.col("question").isNotNull()).select("case_id", "question", "source", F.posexplode("pooled").alias("_at", "chunk_id"))
    held = shown.join(passages.select("chunk_id", "title", "text"), "chunk_id")
    number = F.row_number().over(Window.partitionBy("case_id").orderBy("_at"))
    text = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, PASSAGE_CHARS)
    return held.select(item_id(F.col("question")).alias("id"), "question", "source", F.concat(F.lit("P"), number.cast("string")).alias("label"), "chunk_id", "title", text.alias("text"))


def judge_name(given: str | None) -> str:
    """The reviewer's name in lower case; the owner's and the model's names are not to be taken."""
    name = str(given or "reviewer").strip().lower()[:NAME_CHARS] or "reviewer"
    return f"{name}-reviewer" if name in ("human", "model") else name


def answered(answers: DataFrame, items: DataFrame, cases: DataFrame, judge: str | None) -> DataFrame:
    """Each answer with its outcome and the case it makes.

    ``answers`` (place, id, type, unanswerable, supporting, distractors, notes) name passages by label, ``items`` are
    ``packet``'s rows, ``cases`` (case_id, question, judge, model_marks) what is held, the highest case_id of a question counting.
    ``outcome``: ``saved``; ``unknown`` for an item the packet lacks; ``human`` where the owner's judgement stands.
    Labels that an item lacks are counted in ``unknown_labels``, never guessed; an answer without support is unanswerable,
    an unknown type a concept.  ``replaces`` is the case an answer takes the place of, whose model_marks stay beside the reviewer's.
    """
    entry = F.struct("label", "chunk_id")
    labels = items.groupBy("id").agg(
        F.max("question").alias("question"), F.max("source").alias("source"),
        F.array_sort(F.collect_list(F.struct(F.substring("label", 2, 9).try_cast("int").alias("at"), entry.alias("e")))).alias("_shown"),
    )
    last = F.max_by(F.struct("case_id", "judge", "model_marks"), "case_id").alias("_held")
    held = cases.groupBy(same_question(F.col("question")).alias("_q")).agg(last)
    rows = answers.join(labels, "id", "left").withColumn("_q", same_question(F.col("question"))).join(held, "_q", "left")
    shown = F.map_from_entries("_shown.e")
    named = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    found = lambda c: F.filter(F.transform(named(F.col(c)), lambda x: F.try_element_at(shown, x)), lambda x: x.isNotNull())
    rows = rows.withColumns({"_sup": found("supporting"), "_dis": found("distractors")})
    bad = F.size(named(F.col("supporting"))) + F.size(named(F.col("distractors"))) - F.size("_sup") - F.size("_dis")
    none = F.coalesce("unanswerable", F.lit(False)) | (F.size("_sup") == 0) | (F.col("type") == "unanswerable")
    emptied = F.coalesce("unanswerable", F.lit(False)) | (F.size("_sup") == 0)
    kind = F.when(F.coalesce(none, F.lit(False)), "unanswerable").when(F.col("type").isin(*TYPES), F.col("type")).otherwise("concept")
    outcome = F.when(F.col("question").isNull(), "unknown").when(F.col("_held.judge") == "human", "human").otherwise("saved")
    support = F.when(emptied, F.slice("_sup", 1, 0)).otherwise(F.col("_sup"))
    return rows.select(
        "place", "id", outcome.alias("outcome"), F.when(outcome == "unknown", 0).otherwise(bad).alias("unknown_labels"), "question", "source", kind.alias("type"),
        support.alias("supporting"), F.when(emptied, F.col("_dis")).otherwise(F.filter("_dis", lambda x: ~F.array_contains("_sup", x))).alias("distractors"),
        F.substring(F.coalesce("notes", F.lit("")), 1, NOTE_CHARS).alias("notes"), F.lit(judge_name(judge)).alias("judge"),
        F.col("_shown.e.chunk_id").alias("pooled"), F.col("_held.model_marks").alias("model_marks"), F.col("_held.case_id").alias("replaces"),
    )


def saved_cases(rows: DataFrame) -> DataFrame:
    """The cases that answers make; of several answers to one item the last stands."""
    kept = rows.where("outcome = 'saved'").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("place"))))
    return kept.where("_n = 1").drop("_n", "outcome", "unknown_labels", "place")


def tally(rows: DataFrame) -> DataFrame:
    """One row: answers saved and skipped, and labels that no item has."""
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.agg(count(F.count_if(F.col("outcome") == "saved")).alias("saved"), count(F.count_if(F.col("outcome") != "saved")).alias("skipped"), count(F.sum("unknown_labels")).alias("unknown_labels"))
