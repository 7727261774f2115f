"""Stored postings with block maxima: top-k search that reads the blocks that can still matter.

A posting block holds the documents of a term whose ids lie in one range of
``BLOCK_IDS``, with how often each has the term and the greatest of these
counts.  Blocks lie in Parquet in the order of term and range, a term with most
of the postings over as many files as it needs, so a search reads the row
groups of its terms alone, and of these, at first, only the maxima.

The sum of the maxima of a question's terms bounds every score of a range of
ids.  The ranges with the greatest bounds are scored first; the k-th score so
far rules out every range whose bound is less, and only the others' documents
are read.  The result is that of scoring all.

New documents are appended as further segments, a folder each; a document is in
one segment.

Defined results: a score is the sum of a document's counts of the question's
distinct terms; ties go to the lesser id; documents without a text or a term
have no posting; ids are unique, a repeated one counts with all its rows; an
empty index finds nothing.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import discard, materialise, shared_dir

#: Ids of a range, and ranges that are scored before the first bound is drawn.
BLOCK_IDS, FIRST_RANGES = 4096, 16
#: Bytes of postings of a file, about, at some 16 bytes a posting.
FILE_POSTINGS = 4_000_000
#: Words of a lower-case text, as ``functions.text.tokens`` finds them.
_WORD = re.compile("[a-z0-9]+")


def _listed(ids: np.ndarray, texts: pa.Array) -> pa.Table:
    """(term, top, ids, counts) of the lower-case texts of one range of ids; only its vocabulary and numbers are held."""
    book: defaultdict[str, int] = defaultdict()
    book.default_factory = book.__len__
    codes = [np.fromiter((book[w] for w in _WORD.findall(t.as_py() or "")), np.int64) for t in texts]
    own, slot = np.unique(ids, return_inverse=True)
    places = np.repeat(slot, [len(c) for c in codes])
    pairs, counts = np.unique(np.concatenate(codes) * len(own) + places, return_counts=True)
    term, at = np.divmod(pairs, len(own))
    begins = np.searchsorted(term, np.arange(len(book) + 1)).astype(np.int32)
    top = np.maximum.reduceat(counts, begins[:-1]) if len(book) else counts
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(begins), pa.array(values, kind))
    return pa.table({"term": pa.array(book, pa.string()), "top": pa.array(top, pa.int32()), "ids": lists(own[at], pa.int64()), "counts": lists(counts, pa.int32())})


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, range, top, ids, counts): the posting blocks of ``docs``.

    The texts are dealt by range, and a task makes all blocks of a range at once: what is shuffled is the texts, not a row for each of their words.
    """
    held = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.lower(text).alias("text"))

    def run(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        made = _listed(rows.column("id").to_numpy(), rows.column("text").combine_chunks())
        return made.add_column(1, "range", pa.array([group[0].as_py()] * made.num_rows, pa.int64()))

    dealt = held.withColumn("range", F.floor(F.col("id") / BLOCK_IDS)).groupBy("range")
    return dealt.applyInArrow(run, "term string, range bigint, top int, ids array<bigint>, counts array<int>")


def append(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> str:
    """Write the postings of ``docs`` as a further segment of the index in ``path``; gives its name."""
    name = uuid.uuid4().hex
    made = materialise(blocks(docs, key, text), "blocks")  # dealing by range reads its rows twice
    made.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/segment={name}")
    discard(made)
    return name


def read(spark: SparkSession, path: str) -> DataFrame:
    """(term, range, top, ids, counts, segment) of all segments."""
    return spark.read.schema("term string, range bigint, top int, ids array<bigint>, counts array<int>, segment string").parquet(path)


def bounds(index: DataFrame, terms: list[str]) -> DataFrame:
    """(segment, range, bound): the greatest score that a document of each range can have; documents aren't read."""
    return index.where(F.col("term").isin(terms)).groupBy("segment", "range").agg(F.sum("top").alias("bound"))


def scores(index: DataFrame, terms: list[str], ranges: DataFrame) -> DataFrame:
    """(id, hits) of the documents of ``ranges`` (segment, range) that hold any of the terms."""
    held = index.where(F.col("term").isin(terms)).join(ranges, ["segment", "range"], "left_semi")
    each = held.select(F.explode(F.arrays_zip("ids", "counts")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.counts").alias("n"))
    return each.groupBy("id").agg(F.sum("n").alias("hits"))


def search(index: DataFrame, terms: list[str], k: int, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """(id, hits): the k documents with the greatest sum of counts of ``terms``."""
    terms = sorted(set(terms))
    limits = bounds(index, terms)
    order = [F.desc("bound"), F.asc("segment"), F.asc("range")]
    top = [tuple(r) for r in limits.orderBy(*order).limit(first_ranges).collect()]  # first_ranges rows
    spark = index.sparkSession
    kind = "segment string, range bigint, bound bigint"
    head = scores(index, terms, F.broadcast(spark.createDataFrame(top, kind))).orderBy(F.desc("hits"), "id").limit(k)
    if len(top) < first_ranges:  # these were all
        return head
    best = [(r["id"], r["hits"]) for r in head.collect()]  # k rows
    least = best[-1][1] if len(best) == k else 0
    done = spark.createDataFrame(top, kind)
    rest = limits.where(F.col("bound") >= least).join(F.broadcast(done), ["segment", "range"], "left_anti")
    found = spark.createDataFrame(best, "id bigint, hits bigint").unionByName(scores(index, terms, rest.select("segment", "range")))
    return found.orderBy(F.desc("hits"), "id").limit(k)


def skipped(index: DataFrame, terms: list[str], least: int) -> float:
    """Share of the ranges holding ``terms`` whose bound is under ``least``."""
    row = bounds(index, sorted(set(terms))).agg(F.count("*").alias("n"), F.count_if(F.col("bound") < least).alias("less")).first()
    return row["less"] / row["n"] if row["n"] else 0.0


_built: dict[tuple, str] = {}


def index_of(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of the table at ``path``, built at the session's first question and read by all later ones while the table's files are the same."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(where)
    state = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    known = (spark.sparkContext.applicationId, key, text, state)
    if known not in _built:
        folder = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
        append(spark.read.parquet(path), folder, key, text)
        _built[known] = folder
    return read(spark, _built[known])
