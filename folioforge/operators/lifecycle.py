"""Upkeep of derived tables: incremental rebuilds, folds, purges, ejections, clusters, sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioforge.operators import vectors
from folioforge.session import discard, materialise

#: Gaps, or windows, in a span of time that a task takes.
SPAN_GAPS = 64


def rebuild_plan(old: DataFrame, new: DataFrame, key: str, content: str, made_by: Column, current: str) -> DataFrame:
    """(key, state): keep what is unchanged and current, redo what isn't, add what is fresh, drop what is dead."""
    o = old.select(key, F.col(content).alias("was"), made_by.alias("made_by"), F.lit(True).alias("held"))
    n = new.select(key, F.col(content).alias("now"), F.lit(True).alias("wanted"))
    changed = ~F.col("was").eqNullSafe(F.col("now")) | ~F.col("made_by").eqNullSafe(F.lit(current))
    state = F.when(F.col("wanted").isNull(), "dead").when(F.col("held").isNull(), "fresh").when(changed, "redo").otherwise("keep")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def thread_claims(claims: DataFrame, thread: str, source: str, claim: str, most: int) -> DataFrame:
    """(thread, claim, source, pos): claims of threads with two sources, one a source in turn, ``most`` at most."""
    own = Window.partitionBy(thread, source)
    turns = claims.withColumn("turn", F.row_number().over(own.orderBy(claim))).withColumn("seen", F.min(claim).over(own))
    placed = turns.withColumn("pos", F.row_number().over(Window.partitionBy(thread).orderBy("turn", "seen"))).where(F.col("pos") <= most)
    wide = claims.groupBy(thread).agg(F.count_distinct(source).alias("n")).where("n >= 2").select(thread)
    return placed.join(wide, thread, "left_semi").select(thread, claim, source, "pos")


def fold(members: DataFrame, category: str, absorbed: list, survivor: object) -> DataFrame:
    """Memberships with the absorbed categories moved to the survivor, each once."""
    moved = F.when(F.col(category).isin(absorbed), F.lit(survivor)).otherwise(F.col(category))
    return members.withColumn(category, moved).distinct()


def resolve_names(names: DataFrame, known: DataFrame, name: str, merged: DataFrame) -> DataFrame:
    """(raw, resolved, how): a known name, the survivor it was merged into, or a new one."""
    found = names.join(known, F.upper("raw") == F.upper(name), "left").join(merged, F.lower("raw") == F.col("old"), "left")
    how = F.when(F.col(name).isNotNull(), "same").when(F.col("now").isNotNull(), "merged").otherwise("new")
    return found.select("raw", F.coalesce(name, "now", "raw").alias("resolved"), how.alias("how"))


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows that refer to what goes."""
    return {name: df.join(gone.select(F.col(key).alias(column)), column, "left_anti") for name, (df, column) in tables.items()}


def ejected(members: DataFrame, collection: str, doc: str, leaving: object) -> DataFrame:
    """Documents that a collection introduced and no other holds."""
    others = members.where(F.col(collection) != F.lit(leaving)).select(doc)
    return members.where((F.col(collection) == F.lit(leaving)) & F.col("introduced")).join(others, doc, "left_anti").select(doc)


def connected(edges: DataFrame) -> DataFrame:
    """(v, c): the least vertex of each vertex's connected part; edges shrink round by round, and each round's tables go with it."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=True)
    labels = materialise(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("c", F.col("v")), "labels", narrow=True)
    while edges.limit(1).count():
        down = edges.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("to"))
        new = materialise(labels.join(down, "c", "left").select("v", F.coalesce("to", "c").alias("c")), "labels", narrow=True)
        ends = edges.join(down.withColumnsRenamed({"c": "b", "to": "tb"}), "b").join(down.withColumnsRenamed({"c": "a", "to": "ta"}), "a", "left")
        moved = ends.select(F.coalesce("ta", "a").alias("x"), F.col("tb").alias("y")).where("x <> y")
        shrunk = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", narrow=True)
        discard(labels, edges)
        labels, edges = new, shrunk
    discard(edges)
    return labels


def clusters(points: DataFrame, least: float, size: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster): connected parts of the graph of all pairs above ``least``; -1 for parts under ``size``."""
    parts = connected(vectors.pairs_above(points, least, key, vector)).withColumnRenamed("v", key)
    counts = parts.groupBy("c").agg(F.count("*").alias("n"))
    named = parts.join(counts, "c").select(key, F.when(F.col("n") >= size, F.col("c")).otherwise(-1).alias("cluster"))
    return points.select(key).join(named, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def sessions(events: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """(keys, first, last, n): runs of events at most ``gap_seconds`` apart.

    Runs are found within spans of ``SPAN_GAPS`` gaps first, so that a kind with
    most of the events isn't one task; then those that meet are joined.
    """
    span = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / (SPAN_GAPS * gap_seconds))
    single = events.select(*keys, F.col(time).alias("first"), F.col(time).alias("last"), F.lit(1).cast("bigint").alias("n"), span.alias("_span"))
    return _joined(_joined(single, [*keys, "_span"], gap_seconds).drop("_span"), keys, gap_seconds)


def _joined(runs: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """Runs (keys, first, last, n) with those at most a gap apart made one."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(micros(F.col("first")) - micros(reach) > gap_seconds * 1_000_000, F.lit(True))
    numbered = runs.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_run")


def preceding(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """``events`` with n: rows of the same key within the seconds up to a row's own second, itself included.

    Rows are dealt by spans of time; those near a span's end are seen by the next one too.
    """
    wide = SPAN_GAPS * seconds
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    spans = F.array_distinct(F.array(F.floor(at / wide), F.floor((at + seconds) / wide)))
    dealt = events.withColumn("_at", at).withColumn("_span", F.explode(spans))
    order = Window.partitionBy(key, "_span").orderBy("_at").rangeBetween(-seconds, 0)
    return dealt.withColumn("n", F.count("*").over(order)).where(F.col("_span") == F.floor(F.col("_at") / wide)).drop("_at", "_span")


def debounced(events: DataFrame, key: str, time: str, quiet_seconds: int, busy: DataFrame | None = None) -> DataFrame:
    """(key, asked, due, absorbed): rebuilds that a key's events reserve.

    An event reserves a rebuild a quiet window later and the events until then
    are absorbed; the next one after that reserves another.  ``busy`` (key,
    since, until): a rebuild due while reading goes on waits for its end, and
    one that another rebuild of the key overtakes is skipped, its events absorbed by that.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(F.col(key).alias("k"), seconds.alias("t"))
    spells = (events.sparkSession.createDataFrame([], "k string, since bigint, until bigint") if busy is None else busy.select(F.col(key).alias("k"), *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("since", "until"))))
    kind = rows.schema["k"].dataType

    def run(_: tuple, times: pd.DataFrame, spells: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(times["t"].to_numpy())
        # spells that meet are one; a due time inside moves to its end
        spells = spells[spells["since"] < spells["until"]].sort_values("since")
        since, until = (spells[c].to_numpy(np.int64) for c in ("since", "until"))
        reach = np.maximum.accumulate(until) if len(until) else until
        opens = np.concatenate([[True], since[1:] > reach[:-1]])[: len(since)]
        begins = since[opens]
        ends = reach[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(since) - 1]])] if len(since) else reach
        out, i = [], 0
        while i < len(at):
            due = int(at[i]) + quiet_seconds * 1_000_000
            spell = int(np.searchsorted(begins, due, "right")) - 1
            if spell >= 0 and due < ends[spell]:
                due = int(ends[spell])
            j = int(np.searchsorted(at, due, "right"))
            out.append((times["k"].iloc[0], int(at[i]), due, j - i))
            i = j
        return pd.DataFrame(out, columns=["k", "asked", "due", "absorbed"])

    schema = StructType([StructField("k", kind), *(StructField(c, LongType()) for c in ("asked", "due", "absorbed"))])
    made = rows.groupBy("k").cogroup(spells.withColumn("k", F.col("k").cast(kind)).groupBy("k")).applyInPandas(run, schema)
    return made.select(F.col("k").alias(key), F.timestamp_micros("asked").alias("asked"), F.timestamp_micros("due").alias("due"), "absorbed")


def scoped_threads(threads: DataFrame, claims: DataFrame, k: int, thread: str, scope: DataFrame | None, key: str) -> DataFrame:
    """(thread, score, n_in_scope, state) of the k best threads (thread, score); of ``claims`` (thread, key) those in ``scope`` count.

    With a scope three times as many are taken and those that hold nothing of it
    go; a thread without any claim is told apart from one without a claim in scope.
    """
    best = threads.orderBy(F.desc("score"), thread).limit(k if scope is None else 3 * k)
    inside = claims.withColumn("in_scope", F.lit(True)) if scope is None else claims.join(scope.select(key).distinct().withColumn("in_scope", F.lit(True)), key, "left")
    counts = inside.groupBy(thread).agg(F.count("*").alias("n"), F.count_if(F.coalesce("in_scope", F.lit(False))).alias("n_in_scope"))
    state = F.when(F.col("n").isNull(), "no rows").when(F.col("n_in_scope") == 0, "none in scope").otherwise("claims")
    found = best.join(counts, thread, "left").select(thread, "score", F.coalesce("n_in_scope", F.lit(0)).alias("n_in_scope"), state.alias("state"))
    return found.where("state <> 'none in scope'").orderBy(F.desc("score"), thread).limit(k)


def verified(manifest: DataFrame, parts: DataFrame, part: str = "part") -> DataFrame:
    """(part, state) of an import: ``manifest`` and ``parts`` hold (part, n, digest); whole, damaged, missing or unlisted."""
    a = manifest.select(part, F.col("n").alias("n1"), F.col("digest").alias("d1"))
    b = parts.select(part, F.col("n").alias("n2"), F.col("digest").alias("d2"))
    same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("d1").eqNullSafe(F.col("d2"))
    state = F.when(F.col("n2").isNull(), "missing").when(F.col("n1").isNull(), "unlisted").when(same, "whole").otherwise("damaged")
    return a.join(b, part, "full_outer").select(part, state.alias("state"))


def upgraded(members: DataFrame, doc: str, collection: str, changed: object, new: DataFrame) -> DataFrame:
    """(doc, action) for a collection's documents under its new version: stays, leaves, or is deleted (introduced by it and in no other collection)."""
    mine = members.where(F.col(collection) == F.lit(changed)).select(doc, "introduced")
    others = members.where(F.col(collection) != F.lit(changed)).select(doc).distinct().withColumn("elsewhere", F.lit(True))
    kept = new.select(doc).distinct().withColumn("listed", F.lit(True))
    action = F.when(F.col("listed"), "stays").when(F.col("introduced") & F.col("elsewhere").isNull(), "deleted").otherwise("leaves")
    return mine.join(others, doc, "left").join(kept, doc, "left").select(doc, action.alias("action"))


def shelf_moves(shelves: DataFrame, shelf: str, parent: str, most: int, fewest: int) -> DataFrame:
    """(shelf, action, into): shelves (shelf, parent, n) to split, and small ones with the largest other shelf under their parent."""
    order = Window.partitionBy(parent).orderBy(F.desc("n"), shelf)
    ranked = shelves.withColumn("place", F.row_number().over(order))
    first, second = (ranked.where(F.col("place") == p).select(parent, F.col(shelf).alias(name)) for p, name in ((1, "largest"), (2, "next")))
    into = F.when(F.col(shelf) == F.col("largest"), F.col("next")).otherwise(F.col("largest"))
    action = F.when(F.col("n") > most, "split").when((F.col("n") < fewest) & into.isNotNull(), "merge")
    found = ranked.join(first, parent).join(second, parent, "left").select(shelf, action.alias("action"), into.alias("into"))
    return found.where("action is not null").withColumn("into", F.when(F.col("action") == "merge", F.col("into")))


def illegal_transitions(events: DataFrame, key: str, state: str, number: str, allowed: dict[str, list[str]], first: list[str], time: str = "ts") -> DataFrame:
    """(key, number, before, state): a key's changes of state, in order of time and number, that ``allowed`` doesn't hold; it begins with one of ``first``."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(time, number))
    good = F.when(F.col("before").isNull(), F.col(state).isin(first))
    for was, after in allowed.items():
        good = good.when(F.col("before") == was, F.col(state).isin(after) if after else F.lit(False))
    rows = events.withColumn("before", before).where(~F.coalesce(good.otherwise(F.lit(False)), F.lit(False)))
    return rows.select(key, F.col(number).alias("number"), "before", F.col(state).alias("state"))


def latest(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each key's last row by a total order."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
