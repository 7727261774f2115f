"""The thirteen operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import classifier, decontaminate, html_text, interactions, language, licenses, mixing, neardup, packing, quality_rules, repair, substring, urls
from folioforge.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    """Register a query by its function's name."""
    QUERIES[function.__name__] = function
    return function


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, distance, start, end."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = language.fit(docs, ~language.held_out(F.col("doc_id")))
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.identify(rows, models, keep=["doc_id", "held_out"])


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the documents that repeat an earlier document's passage, and the documents that keep it."""
    return substring.repeats(table(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document: the best template, its Dice coefficient, the number of units that match."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", F.round("score", 6).alias("score"), "n_license_units")


ORACLES["op1_license_scan"] = licenses.oracle()


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and line-first verdict of every document."""
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words line_chars removed_chars base_failed kept".split()
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


ORACLES["op2_quality_rules"] = quality_rules.oracle()


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix of all sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), ~language.held_out(F.col("doc_id")))
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return classifier.score(rows, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of each order, by source."""
    rows = interactions.text_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions.audit(rows, list("ABCDE"), ["good", "toxic"])


ORACLES["op11_filter_audit"] = interactions.oracle()


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation after damage by a hash of its turns."""
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


ORACLES["op12_conversation_repair"] = repair.oracle()


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 4,096: one row per piece, its ids as a checksum."""
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
