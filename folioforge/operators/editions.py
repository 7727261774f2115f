"""Editions of volumes: what an export level lets out, and volumes as read with what was written in their margins.

Tables: sections (doc_id, section, order_index, title), passages (doc_id, section, order_index, text, ..), artifacts
(id, kind, target, text, cartridge) whose target is a passage, a section or a document by its kind.  Ids are strings.

Defined results: of artifacts of one kind on one target an own one (no cartridge) goes before a collection's, then the least id;
rows with null keys meet nothing; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.relational import first_per_key

# Levels of an export, the kinds of artifacts that a catalogue holds, and what makes a heading worth showing.
LEVELS = ("full", "readings", "catalogue")
CATALOGUE = ("orientation", "document_summary")
HEADING = "[A-Za-z]{5,}"


def reading_id(content_hash: Column, order_index: Column) -> Column:
    """Id of the passage that stands for a section where its text stays behind: alike on every machine."""
    return F.md5(F.concat_ws(":", content_hash, order_index.cast("string")))


def preferred(artifacts: DataFrame) -> DataFrame:
    """One artifact a kind and target."""
    return first_per_key(artifacts, ["kind", "target"], [F.col("cartridge").isNotNull().asc(), F.asc("id")])


def reduced(level: str, docs: DataFrame, sections: DataFrame, passages: DataFrame, artifacts: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """sections, passages, artifacts and passage tags as an export of the level holds them.

    ``docs`` (doc_id, content_hash), ``sections`` (id, doc_id, order_index), ``passages`` (id, doc_id, section, order_index, text),
    ``tags`` (passage, category, confidence).  A full export holds everything.  A catalogue has no sections and passages, and of artifacts those on
    whole volumes.  Readings have a passage for each section with a summary, which is its text; reflections
    point to their section's one or, if there is none, stay behind, and passages' tags roll up to it at their highest confidence.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level: {level}")
    artifacts = preferred(artifacts)
    if level == "full":
        return {"sections": sections, "passages": passages, "artifacts": artifacts, "tags": tags}
    if level == "catalogue":
        return {"sections": sections.limit(0), "passages": passages.limit(0), "artifacts": artifacts.where(F.col("kind").isin(*CATALOGUE)), "tags": tags.limit(0)}
    summaries = artifacts.where("kind = 'section_summary'").select(F.col("target").alias("section"), "text")
    told = sections.select(F.col("id").alias("section"), "doc_id", F.col("order_index").alias("_at")).join(summaries, "section").join(docs.select("doc_id", "content_hash"), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "section")) - 1
    readings = told.select(reading_id(F.col("content_hash"), F.col("_at")).alias("id"), "doc_id", "section", place.alias("order_index"), "text")
    stands = passages.select(F.col("id").alias("target"), "section").join(readings.select(F.col("id").alias("_stand"), "section"), "section").select("target", "_stand")
    moved = artifacts.where("kind = 'reflection'").join(stands, "target").withColumn("target", F.col("_stand")).select(*artifacts.columns)
    rolled = tags.join(stands, F.col("passage") == F.col("target")).groupBy(F.col("_stand").alias("passage"), "category").agg(F.max("confidence").alias("confidence"))
    return {"sections": sections, "passages": readings, "artifacts": artifacts.where("kind <> 'reflection'").unionByName(moved), "tags": rolled}


def margins(docs: DataFrame, sections: DataFrame, passages: DataFrame, summaries: DataFrame, reflections: DataFrame) -> DataFrame:
    """(doc_id, place, section, title, summary, order_index, text, reflection, reflections): volumes as a reader sees them, a row a passage.

    ``docs`` (doc_id, readings_only), ``sections`` (doc_id, section, order_index, title), ``passages`` (doc_id, section, order_index, kind, text, char_start, char_end),
    ``summaries`` (doc_id, section, text), ``reflections`` (doc_id, order_index, text, cartridge, created).
    A passage goes without what the one before it in its section holds, and the first one without a line that is the section's title;
    figures stand elsewhere (``figures``).  A title without a word of five letters isn't announced.  A section without passages is a row
    of its own, but not in a volume that is readings only, whose summaries are its text and aren't shown again.  Passages of no section come
    last as they are; those of a section that isn't there are left out.  Of a passage's reflections the first is an own one, the oldest.
    """
    order = Window.partitionBy("doc_id", "section").orderBy("order_index")
    shared = F.greatest(F.coalesce(F.lag("char_end").over(order), F.lit(0)) - F.col("char_start"), F.lit(0))
    running = passages.where("kind is null or kind <> 'figure'").withColumn("_shared", shared).withColumn("_n", F.row_number().over(order))
    running = running.select("doc_id", "section", F.col("order_index").alias("_at"), "_n", F.expr("case when section is null then text else substring(text, cast(_shared as int) + 1) end").alias("_text"))

    heads = sections.select("doc_id", "section", F.col("order_index").alias("place"), F.col("title").alias("_title")).join(docs.select("doc_id", "readings_only"), "doc_id")
    placed = heads.join(running.where("section is not null"), ["doc_id", "section"], "left").where("not coalesce(readings_only, false) or _at is not null")
    line = F.substring_index("_text", "\n", 1)
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.trim(c), "^#+", "")))
    opens = (F.col("_n") == 1) & (plain(line) == F.lower(F.trim("_title")))
    placed = placed.withColumn("_text", F.when(opens, F.regexp_replace(F.substring(F.col("_text"), F.length(line) + 2, F.length("_text")), r"\A\s+", "")).otherwise(F.col("_text")))
    told = summaries.groupBy("doc_id", "section").agg(F.min("text").alias("_told"))
    placed = placed.join(told, ["doc_id", "section"], "left")
    title, summary = F.when(F.col("_title").rlike(HEADING), F.col("_title")), F.when(~F.coalesce("readings_only", F.lit(False)), F.col("_told"))
    loose = running.where("section is null").join(docs.select("doc_id"), "doc_id").select("doc_id", F.lit(None).cast("int").alias("place"), "section", *(F.lit(None).cast("string").alias(c) for c in ("title", "summary")), "_at", "_text")
    rows = placed.select("doc_id", F.col("place").cast("int").alias("place"), "section", title.alias("title"), summary.alias("summary"), "_at", "_text").unionByName(loose)

    first = F.min(F.struct(F.col("cartridge").isNotNull().alias("theirs"), "created", "text"))
    notes = reflections.groupBy("doc_id", F.col("order_index").alias("_at")).agg(first.alias("_first"), F.count("*").alias("_count"))
    return rows.join(notes, ["doc_id", "_at"], "left").select(
        "doc_id", "place", "section", "title", "summary", F.col("_at").alias("order_index"), F.col("_text").alias("text"), F.col("_first.text").alias("reflection"), F.coalesce("_count", F.lit(0)).alias("reflections")
    )


def figures(passages: DataFrame) -> DataFrame:
    """(doc_id, figure, text): what figures show, by their number; the last passage of a number counts, at one place the greatest text, those without a number are left out."""
    number = F.regexp_extract("text", r"\AFigure (\d+),", 1)
    body = F.when(F.locate("\n\n", F.col("text")) > 0, F.substring(F.col("text"), F.locate("\n\n", F.col("text")) + 2, F.length("text"))).otherwise(F.col("text"))
    shown = passages.where("kind = 'figure'").select("doc_id", "order_index", number.alias("_n"), body.alias("_body")).where("_n <> ''")
    last = F.max(F.struct("order_index", "_body"))
    return shown.groupBy("doc_id", F.col("_n").cast("int").alias("figure")).agg(last["_body"].alias("text"))
