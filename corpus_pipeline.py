"""The corpus pipeline: documents to a deduplicated, decontaminated, mixed training set.

``STAGES`` names the stages in order.  Each takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's rows as Parquet in the shared folder and reads them
back as the next one's input; a stage's rows are deleted once the next one's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, language, mixing, neardup, substring
from folioforge.session import discard, materialise
from folioforge.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told with a margin; null and letterless texts go."""
    models = language.fit(docs, ~language.held_out(F.col("doc_id")))
    return language.identify(docs, models).where(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate class; rows are told apart by doc_id and text, wordless ones all stay."""
    return neardup.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; a document without a word, or left without one, goes."""
    return substring.remove(docs, substring.repeats(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose own text holds a benchmark item, whatever their doc_id; a null text holds none."""
    return decontaminate.drop(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each with its number of copies; repeated rows are documents of their own, a null source is a source."""
    return mixing.mix_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: No stage but the filters' last steps can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return docs
