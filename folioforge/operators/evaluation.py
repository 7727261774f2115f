"""Evaluation: ranks, recall, reciprocal rank, agreement, percentiles, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, case: str, order: list[Column]) -> DataFrame:
    """Number each case's rows by a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(*order)))


def recall_mrr(rows: DataFrame, case: str, sought: Column, ks: tuple[int, ...]) -> DataFrame:
    """One row: share of cases whose first sought row is within k, and the mean reciprocal rank; no such row counts 0."""
    first = rows.groupBy(case).agg(F.min(F.when(sought, F.col("rank"))).alias("first"))
    within = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks]
    return first.agg(F.count("*").alias("cases"), *within, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def judged(rows: DataFrame, case: list[str], kind: str, support: Column, distractor: Column) -> DataFrame:
    """Per kind, and for all (null): mean reciprocal rank, recall at 10 (cases with support), distractors in the first 5."""
    at = F.col("rank")
    scores = rows.groupBy(*case).agg(
        F.min(F.when(support, at)).alias("first"),
        F.count_if(support & (at <= 10)).alias("hits"),
        F.count_if(support).alias("support"),
        F.count_if(distractor & (at <= 5)).alias("d"),
    )
    return scores.groupingSets([[], [kind]], kind).agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("rr"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("hits") / F.col("support"))), 4).alias("recall_10"),
        F.round(F.avg("d"), 4).alias("distractors_5"),
    )


def agreement(rows: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """Per kind, and for all (null): the four counts, accuracy, kappa, precision and recall of rater b against a."""
    x, y = F.col(a), F.col(b)
    counts = rows.groupingSets([[], [kind]], kind).agg(
        F.count_if(x & y).alias("tp"), F.count_if(~x & y).alias("fp"), F.count_if(x & ~y).alias("fn"), F.count_if(~x & ~y).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po = (tp + tn) / n
    pe = ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)
    share = lambda part, whole: F.round(part / F.nullif(whole, F.lit(0)), 3)
    return counts.select(
        kind, "tp", "fp", "fn", "tn", F.round(po, 3).alias("accuracy"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 3).alias("kappa"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall")
    )


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median, 95th percentile (interpolated) and mean of each group."""
    at = lambda p: F.round(F.percentile(value, F.lit(p)), 2)
    return rows.groupBy(group).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.avg(value), 4).alias("mean"))


def citation_validity(rows: DataFrame, key: list[str], sources: int) -> DataFrame:
    """(key, validity): share of the numbers cited in ``[n, m]`` that name a source."""
    groups = rows.select(*key, F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))).alias("g"))
    numbers = groups.select(*key, F.explode(F.split("g", r"\s*,\s*")).alias("n"))
    return numbers.groupBy(*key).agg(F.round(F.count_if(F.col("n").try_cast("int").between(1, sources)) / F.count("*"), 4).alias("validity"))
