"""Verdicts by majority: votes that are guarded one by one, and counted until they decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import guards
from folioforge.operators import ranking

#: Votes of a cluster, and those that decide.
VOTES, DECIDING = 3, 2


def guarded(votes: DataFrame) -> DataFrame:
    """``votes`` (.., disagreement, explanation, subject) with disagreement as the explanation bears it out, and overruled.

    A no becomes a yes where the explanation asserts a conflict, isn't junk, and a subject is named (overruled);
    then a yes becomes a no where the explanation is junk or denies a conflict, or no subject is named.  Null counts as no.
    """
    text = F.col("explanation")
    named = F.length(F.trim(F.coalesce("subject", F.lit("")))) >= 3
    said = F.coalesce("disagreement", F.lit(False))
    overruled = ~said & guards.affirms(text) & named & ~guards.is_junk(text)
    kept = (said | overruled) & ~guards.is_junk(text) & ~guards.denies(text) & named
    return votes.withColumns({"disagreement": kept, "overruled": overruled})


def majority(votes: DataFrame, group: str, order: str) -> DataFrame:
    """(group, disagreement, yes, votes, chosen): the verdict of each group's guarded votes in order, three at most and none after two agree.

    ``chosen`` is the order of the vote that speaks for the group: the first yes where the verdict is yes, else the first.
    A group's first three votes alone are gathered; groups without votes don't appear.
    """
    # a vote that is repeated counts once, as a yes if any of them is
    each = votes.groupBy(group, order).agg(F.bool_or("disagreement").alias("yes"))
    three = ranking.top_per_group(each, [group], [F.asc(order)], VOTES, "_n")
    held = three.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "yes"))).alias("v"))
    agree = (F.size("v") >= DECIDING) & (F.col("v")[0]["yes"] == F.col("v")[1]["yes"])
    counted = held.withColumn("v", F.when(agree, F.slice("v", 1, DECIDING)).otherwise(F.col("v")))
    ayes = F.filter("v", lambda x: x["yes"])
    verdict = F.size(ayes) >= DECIDING
    return counted.select(group, verdict.alias("disagreement"), F.size(ayes).alias("yes"), F.size("v").alias("votes"), F.when(verdict, F.get(ayes, F.lit(0))["at"]).otherwise(F.col("v")[0]["at"]).alias("chosen"))
