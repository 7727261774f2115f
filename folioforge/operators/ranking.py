"""Ranking operators: fusion, splicing, diversification and sampling.

Every ranking has a total order; equal scores are told apart by an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialise

RRF_K, WEIGHT_DENSE, WEIGHT_LEXICAL = 60, 1.0, 0.2


def top_ranked(df: DataFrame, order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """First k rows with their rank: a top-k before the window, so one task sees k rows."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def numbered(df: DataFrame, order: str, name: str = "n") -> DataFrame:
    """``df`` with each row's number from 1 by a unique column: ranges are numbered on their own and begin where the ones before end."""
    ranged = df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    held = materialise(ranged, "ranges")
    counts = held.groupBy("_part").agg(F.count("*").alias("_size"))
    before = counts.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")  # a row a partition
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order))).drop("_part", "_before")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """First k rows of each group with their rank; pruned before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def rare_names(held: DataFrame, total: DataFrame, key: str, few: int = 20, share: float = 0.002, sample: int = 30, least: float = 0.6) -> DataFrame:
    """(term, df, named) of the terms that at most ``few`` texts, or a share of all, hold, and ``least`` of the first ``sample`` by key write as a name.

    ``held``: (key, term, named) a row for each text and term; ``total``: one row.
    Without the second condition words that are merely rare would crowd out what was asked for.
    """
    rare = held.groupBy("term").agg(F.count("*").alias("df")).join(total, F.lit(True)).where(F.col("df") <= F.greatest(F.lit(few), share * F.col("total")))
    first = top_per_group(held.join(rare.select("term", "df"), "term"), ["term"], [F.asc(key)], sample, "_n")
    return first.groupBy("term").agg(F.max("df").alias("df"), F.avg("named").alias("named")).where(F.col("named") >= least)


def fuse(dense: DataFrame, lexical: DataFrame, key: str, k: int = RRF_K, weight_dense: float = WEIGHT_DENSE, weight_lexical: float = WEIGHT_LEXICAL) -> DataFrame:
    """Weighted reciprocal rank fusion of (key, rk) lists; a list that lacks a row adds nothing."""
    d = dense.select(key, F.col("rk").alias("dense_rank"))
    x = lexical.select(key, F.col("rk").alias("lexical_rank"))
    score = F.coalesce(F.lit(weight_dense) / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(weight_lexical) / (k + F.col("lexical_rank")), F.lit(0.0))
    return d.join(x, key, "full_outer").withColumn("score", score)


def routed_union(routed: DataFrame, everywhere: DataFrame, key: str, pool: int, reserve: float = 0.2) -> DataFrame:
    """The routed list's share of the pool, then the global list; (key, rk) in and (key, pos) out, first place kept."""
    share = int(pool * (1 - reserve))
    stages = routed.where(F.col("rk") <= share).select(key, F.lit(0).alias("stage"), "rk").unionByName(everywhere.where(F.col("rk") <= pool - share).select(key, F.lit(1).alias("stage"), "rk"))
    first = stages.groupBy(key).agg(F.min(F.struct("stage", "rk")).alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.orderBy("at", key))).drop("at")


def diversify(ranked: DataFrame, group: str, n: int, limit: int, exempt: Column | None = None) -> DataFrame:
    """At most n rows a group in order of pos, then the skipped ones; exempt groups aren't held back."""
    held = F.row_number().over(Window.partitionBy(group).orderBy("pos")) > n
    if exempt is not None:
        held = held & ~exempt
    return ranked.withColumn("held", held).orderBy("held", "pos").limit(limit).drop("held")


def exact_first(ranked: DataFrame, literal: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of both lists by rank, then literal ones alone, then the rest; (key, rk) in, (key, bucket, pos) out."""
    r = ranked.select(key, F.col("rk").alias("ranked"))
    x = literal.select(key, F.col("rk").alias("exact"))
    both = r.join(x, key, "full_outer")
    bucket = F.when(F.col("ranked").isNotNull() & F.col("exact").isNotNull(), 0).when(F.col("exact").isNotNull(), 1).otherwise(2)
    return both.select(key, bucket.alias("bucket"), F.coalesce(F.when(bucket != 1, F.col("ranked")), F.col("exact")).alias("pos")).orderBy("bucket", "pos", key).limit(limit)


def splice(ranked: DataFrame, extra: DataFrame, key: str, after: int = 3) -> DataFrame:
    """The first ``after`` rows, then rows of ``extra`` that aren't among them, then the rest; (key, rk) lists."""
    head = ranked.select(key, F.when(F.col("rk") <= after, 0).otherwise(2).alias("part"), "rk")
    more = extra.select(key, F.lit(1).alias("part"), "rk")
    first = head.unionByName(more).groupBy(key).agg(F.min(F.struct("part", "rk")).alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.orderBy("at", key))).drop("at")


def rerank_head(ranked: DataFrame, score: Column, depth: int) -> DataFrame:
    """The first ``depth`` rows by score, the tail as it was; rows need pos and doc_id."""
    in_head = F.col("pos") <= depth
    order = Window.orderBy(F.when(in_head, 0).otherwise(1), F.desc(F.when(in_head, score)), "pos")
    return ranked.withColumn("new_pos", F.row_number().over(order))


def round_robin(df: DataFrame, group: list[str], order: list[Column], turn: str = "turn") -> DataFrame:
    """Number each group's rows, so that ordering by the number takes one from each group in turn."""
    return df.withColumn(turn, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
