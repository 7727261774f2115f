"""How filters interact: what each removes, alone and after others, in every order.

A packed bitmap index: each task turns its rows into bitsets, one bit a row,
for every filter and label.  A task's rows are ordered by part and every part
begins at a byte of its own, so that a part's bitset is a run of bytes and as
many parts as rows cost no more than the rows do.  For each subset of filters
that an order can have applied before a step, survivors are the rows AND NOT
those filters; popcounts of survivors that fail a further filter are all that
leaves the task.  Counts are summed over tasks and the steps of the orders
looked up among the subsets: a filter order of n filters needs none of the n!
orders to be run, only 2^n subsets.

``text_flags`` gives one row per document with its part and its failures, all
but the table-wide one by column expressions; ``audit`` counts any frame of
failures and labels.

Defined results: a null text is empty, a null part the empty string, a null
failure or label false; repeated rows are documents of their own; a document
with a null id repeats no other and none repeats it by id; of documents that
share id and text none repeats the other; labels of one id are true where any
of its rows is; an empty table has no part and so no row; texts of any length
are judged whole.  Columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one bitmap index; a task makes as many as it needs, one after another.
INDEX_ROWS = 1 << 16


def text_flags(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): failures and labels of every document.

    A: few words; B: few distinct ones; C: many capitals; D: a symbol; E: a
    smaller id has the same text.  Texts are compared by their SHA-256.  Only
    numbers and digests are shuffled; what repeats is summed up by digest first.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).alias("id"), whole.alias("whole"), F.array_remove(F.split(whole, SPACE), "").alias("words")
    )
    capitals = F.length(F.regexp_replace("whole", "[^A-Z]+", ""))
    flags = {
        "A": F.size("words") < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.size("words"),
        "C": 100 * capitals.cast("bigint") > MAX_CAPITAL_PERCENT * F.length("whole").cast("bigint"),
        "D": F.col("whole").rlike(SYMBOLS),
    }
    narrow = materialise(words.select("part", "id", F.unhex(F.sha2("whole", 256)).alias("digest"), *[c.alias(n) for n, c in flags.items()]), "flags", narrow=True)
    # written before they are joined, so that a digest or id that many rows share can be split
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = materialise(firsts, "firsts", narrow=True)
    marks = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = materialise(marks, "marks", narrow=True)
    out = narrow.join(firsts, "digest", "left").withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    return out.join(marks, "id", "left").select("part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def packed(parts: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bitsets of rows ordered by part: distinct parts, first byte of each, and a byte array per column (first: which bits are rows)."""
    names, which = np.unique(parts, return_inverse=True)
    sizes = np.bincount(which, minlength=len(names))
    room = (sizes + 7) // 8
    begins = np.concatenate([[0], np.cumsum(room)[:-1]])
    order = np.argsort(which, kind="stable")
    at = np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 8 * np.repeat(begins, sizes)
    sets = []
    for column in [np.ones(len(parts), bool), *columns]:
        bits = np.zeros(8 * int(room.sum()), np.uint8)
        bits[at] = column[order]
        sets.append(np.packbits(bits))
    return names, begins, sets


def subset_counts(parts: np.ndarray, filters: list[np.ndarray], labels: list[np.ndarray]) -> pd.DataFrame:
    """Per part, subset of filters already applied (as bits) and next filter: survivors, rows removed, and those of them with each label."""
    names, begins, (rows, *sets) = packed(parts, [*filters, *labels])
    fails, marks = sets[: len(filters)], sets[len(filters) :]
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), begins)
    alive, out = {0: rows}, []
    for subset in range(1 << len(fails)):
        if subset:  # one AND NOT: the subset without its last filter is there already
            last = subset.bit_length() - 1
            alive[subset] = alive[subset ^ (1 << last)] & ~fails[last]
        before = count(alive[subset])
        for k, failing in enumerate(fails):
            if not subset >> k & 1:
                gone = alive[subset] & failing
                out.append(pd.DataFrame({"part": names, "subset": subset, "filter": k, "before": before, "removed": count(gone), **{f"lost_{i}": count(gone & m) for i, m in enumerate(marks)}}))
    return pd.concat(out, ignore_index=True)


def audit(rows: DataFrame, filters: list[str], labels: list[str], part: str = "part", index_rows: int = INDEX_ROWS) -> DataFrame:
    """One row per part, order of all ``filters`` and step, with the counts of that step's filter.

    Columns: part, filter_order (the filters' names joined), step (1 on), kept,
    removed, redundant, unique_fails, ``{label}_lost`` for each label, shapley.
    """
    n, names = len(filters), [f"lost_{i}" for i in range(len(labels))]
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
    narrow = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *map(flag, [*filters, *labels]))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = pa.Table.from_batches(held).to_pandas()
            held.clear()
            flags = [columns.iloc[:, 1 + i].to_numpy(bool) for i in range(n + len(labels))]
            made = subset_counts(columns.iloc[:, 0].to_numpy(object), flags[:n], flags[n:])
            yield from pa.Table.from_pandas(made.astype({c: "int32" for c in ("subset", "filter")}), preserve_index=False).to_batches(max_chunksize=10_000)

        for batch in batches:
            for first in range(0, batch.num_rows, index_rows):
                cut = batch.slice(first, index_rows)
                if held and sum(b.num_rows for b in held) + cut.num_rows > index_rows:
                    yield from flush()
                held.append(cut)
        if held:
            yield from flush()

    schema = "part string, subset int, filter int, before bigint, removed bigint" + "".join(f", {c} bigint" for c in names)
    summed = narrow.mapInArrow(indexed, schema).groupBy("part", "subset", "filter").agg(*[F.sum(c).alias(c) for c in ["before", "removed", *names]])
    counts = materialise(summed, "subsets", narrow=True)

    # how many orders have just this subset before the filter
    orders_of = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("subset") + 1)
    per_filter = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("subset") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.col("subset") == F.expr(f"{(1 << n) - 1} ^ shiftleft(1, filter)"), F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders_of).alias("shapley"),
    )
    steps = [
        ("".join(filters[k] for k in order), step + 1, sum(1 << k for k in order[:step]), order[step]) for order in permutations(range(n)) for step in range(n)
    ]
    spark = rows.sparkSession
    places = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, subset int, filter int"))  # n! * n rows of the filters, whatever the table
    return (
        counts.join(places, ["subset", "filter"])
        .join(per_filter, ["part", "filter"])
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("before") - F.col("removed")).alias("kept"),
            "removed",
            (F.col("failing") - F.col("removed")).alias("redundant"),
            "unique_fails",
            *[F.col(c).alias(f"{label}_lost") for c, label in zip(names, labels)],
            "shapley",
        )
    )


def oracle() -> str:
    """DuckDB SQL with the rows of ``op11_filter_audit``: every order is applied step by step to the groups of equal failures."""
    letters = "ABCDE"
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(letters))
    fails = " ".join(f"when '{c}' then {c}" for c in letters)
    return f"""
    with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    firsts as (select t, min(doc_id) as first from d group by t),
    marks as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
    f as (select part, len(w) < {MIN_WORDS} as A, 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) as B,
            100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(t) as C,
            regexp_matches(t, '{SYMBOLS}') as D, coalesce(doc_id > first, false) as E, coalesce(good, false) as good, coalesce(toxic, false) as toxic
          from d join firsts using (t) left join marks using (doc_id)),
    g as (select part, A, B, C, D, E, count(*) as n, sum(good::int) as n_good, sum(toxic::int) as n_toxic from f group by all),
    steps as (select filter_order, step, filter_order[step] as letter, filter_order[1:step - 1] as earlier
              from (values {orders}) as o(filter_order), (select unnest([1, 2, 3, 4, 5]) as step)),
    x as (select part, filter_order, step, letter, n, n_good, n_toxic, case letter {fails} end as failing, A::int + B::int + C::int + D::int + E::int as n_fails,
            not ((A and contains(earlier, 'A')) or (B and contains(earlier, 'B')) or (C and contains(earlier, 'C')) or (D and contains(earlier, 'D')) or (E and contains(earlier, 'E'))) as alive
          from g cross join steps),
    s as (select part, filter_order, step, letter, sum(case when alive and not failing then n else 0 end) as kept, sum(case when alive and failing then n else 0 end) as removed,
            sum(case when failing and not alive then n else 0 end) as redundant, sum(case when failing and n_fails = 1 then n else 0 end) as unique_fails,
            sum(case when alive and failing then n_good else 0 end) as good_lost, sum(case when alive and failing then n_toxic else 0 end) as toxic_lost
          from x group by all)
    select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
           good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from s"""
