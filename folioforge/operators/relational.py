"""Keyed relational operators: overlays, upserts, scopes, orphans and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``base`` whose key isn't among the changes (null keys equal), and the changes."""
    same = None
    other = changes.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    for k in key:
        here = base[k].eqNullSafe(other[f"_{k}"])
        same = here if same is None else same & here
    return base.join(other, same, "left_anti").unionByName(changes)


def in_scope(df: DataFrame, key: str, scopes: list[DataFrame | None]) -> DataFrame:
    """Rows whose key is in every scope; None is no limit, an empty scope holds nothing."""
    for scope in scopes:
        if scope is not None:
            df = df.join(scope.select(key), key, "left_semi")
    return df


def in_any_scope(df: DataFrame, key: str, scopes: list[DataFrame]) -> DataFrame:
    """Rows whose key is in one scope at least."""
    either = scopes[0].select(key)
    for scope in scopes[1:]:
        either = either.unionByName(scope.select(key))
    return df.join(either, key, "left_semi")


def orphans(owned: DataFrame, owner: DataFrame, on: str) -> DataFrame:
    """Rows whose owner is gone."""
    return owned.join(owner.select(on), on, "left_anti")


def mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equal counts the least value."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return first_per_key(counts, group, [F.desc("n"), F.asc(value)])


#: Pairs that one task counts, about; their counts are some 100 MB of it.
TASK_PAIRS = 500_000


def co_members(df: DataFrame, group: str, member: str, block: int = 2048) -> DataFrame:
    """(a, b, shared) with a < b: pairs of members by the number of groups they share.

    A group's members are dealt into blocks of about ``block``, and a pair of blocks is a key of the join: a group
    that holds a third of all rows is met by many tasks. Pairs are counted in as many tasks as their number asks for, whatever
    the session's: a task's memory doesn't grow with the table.
    """
    rows = df.select(group, member).distinct()
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    n = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()["pairs"] or 0
    tasks = max(int(n // TASK_PAIRS) + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = rows.join(sizes, group)
    own, every = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = held.select(group, F.col(member).alias("a"), own.alias("_x"), every.alias("_y"))
    right = held.select(group, F.col(member).alias("b"), every.alias("_x"), own.alias("_y"))
    pairs = left.repartition(tasks, group, "_x", "_y").join(right.repartition(tasks, group, "_x", "_y"), [group, "_x", "_y"]).where("a < b").select("a", "b")
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge a pair: greatest weight, kind by precedence cite, thread, near; (a, b, weight, kind)."""
    order = F.when(F.col("kind") == "cite", 2).when(F.col("kind") == "thread", 1).otherwise(0)
    merged = edges.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("weight").alias("weight"), F.max(order).alias("p"))
    kind = F.element_at(F.array(F.lit("near"), F.lit("thread"), F.lit("cite")), F.col("p") + 1)
    return merged.select(F.col("x").alias("a"), F.col("y").alias("b"), "weight", kind.alias("kind"))


def map_of_last(df: DataFrame, group: str, key: str, value: str, order: Column) -> DataFrame:
    """(group, entries): a map of each group's keys to values; of equal keys the last by order counts, null keys are left out."""
    last = df.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "v")))).alias("entries"))


def assign_tags(held: DataFrame, fresh: DataFrame, doc: str, tag: str) -> DataFrame:
    """(doc, tag, origin): documents' tags after the readers' are replaced by ``fresh`` (doc, tag); those of origin shelf stay and aren't doubled."""
    shelf = held.where("origin = 'shelf'").select(doc, tag).distinct()
    added = fresh.select(doc, tag).distinct().join(shelf, [doc, tag], "left_anti")
    return shelf.withColumn("origin", F.lit("shelf")).unionByName(added.withColumn("origin", F.lit("reader")))


def borne_out(asked: DataFrame, known: DataFrame, generic: list[str]) -> DataFrame:
    """``asked`` (.., command) with known: whether a generic tool's, or like a command of ``known`` (command), by the rule of ``guards.documented``.

    What is known is reduced to its first two words and what may follow them before the join, which is by equality: a pair of
    words that very many commands begin with is one row, and so is each third word after it.  Blank and null commands are false.
    """
    words = lambda: F.filter(F.split(F.coalesce("command", F.lit("")), r"\s+"), lambda w: w != "")
    parts = lambda df: df.withColumn("_w", words()).withColumns({"_two": F.slice("_w", 1, 2), "_third": F.get("_w", F.lit(2))})
    flag = F.col("_third").startswith("-")
    held = parts(known).where(F.size("_w") > 0)
    pairs = held.groupBy("_two").agg(F.bool_or(F.col("_third").isNull()).alias("_bare"), F.coalesce(F.bool_or(~flag), F.lit(False)).alias("_word"))
    thirds = held.where("_third is not null").select("_two", "_third").distinct().withColumn("_same", F.lit(True))
    rows = parts(asked).join(pairs, "_two", "left").join(thirds, ["_two", "_third"], "left")
    like = F.col("_bare").isNotNull() & (F.col("_third").isNull() | F.col("_bare") | F.col("_same").isNotNull() | (F.col("_word") & ~flag))
    verdict = (F.size("_w") > 0) & (F.coalesce(F.get("_w", F.lit(0)).isin(*generic), F.lit(False)) | F.coalesce(like, F.lit(False)))
    return rows.select(*asked.columns, verdict.alias("known"))
