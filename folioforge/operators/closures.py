"""Iterated joins: what hangs on what goes, what names came to be called, vectors drawn on a plane.

``cascade`` follows owner edges from what is deleted, each round from what the
last one found (semi-naive); ``resolved`` halves the way to the end of every
chain of aliases in each round (pointer jumping) and tells those that never
end; ``plane`` is the first two principal components, whose sums of products
meet in a tree of partial sums.  Rounds are written and the last ones deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.vectors import _matrix
from folioforge.session import discard, materialise

#: Partial sums that one task of the tree adds up.
FAN = 32


def cascade(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, id, depth) of all that ``seeds`` (kind, id) own, themselves included, over ``edges`` (owner_kind, owner_id, kind, id); depth is the least number of steps.

    What several owners hold goes with any of them; circles of owners end.
    """
    found = [materialise(seeds.select("kind", "id").distinct().withColumn("depth", F.lit(0)), "round", narrow=True)]
    known = found[0].select("kind", "id")
    held = materialise(edges.select("owner_kind", "owner_id", "kind", "id"), "owned", narrow=True)
    while True:
        last = found[-1].select(F.col("kind").alias("owner_kind"), F.col("id").alias("owner_id"))
        reached = held.join(last, ["owner_kind", "owner_id"], "left_semi").select("kind", "id").distinct().join(known, ["kind", "id"], "left_anti")
        found.append(materialise(reached.withColumn("depth", F.lit(len(found))), "round", narrow=True))
        if not found[-1].limit(1).count():
            break
        known = known.unionByName(found[-1].select("kind", "id"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    whole = materialise(out, "gone", narrow=True)
    discard(held, *found)
    return whole


def resolved(aliases: DataFrame) -> DataFrame:
    """(old, now, steps, circular): where each chain of ``aliases`` (old, now) ends; now is null where it runs in a circle.

    An old name that was merged several times counts with the least of its survivors.
    """
    links = aliases.where("old is not null and now is not null").groupBy("old").agg(F.min("now").alias("now"))
    step = materialise(links.withColumn("steps", F.lit(1).cast("bigint")), "aliases", narrow=True)
    before = None
    while True:
        ahead = step.select(F.col("old").alias("now"), F.col("now").alias("then"), F.col("steps").alias("more"))
        # joined by sorting, as a broadcast goes by the driver
        moved = step.join(ahead.hint("merge"), "now", "left").select("old", F.coalesce("then", "now").alias("now"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("then").isNotNull().alias("open"))
        new = materialise(moved, "aliases", narrow=True)
        unfinished = new.where("open").count()
        discard(step)
        step = new.drop("open")
        step._folder = new._folder
        # a chain that ends and is longer than the last round's reach has a name that this round finishes: if none was, all that are left run in circles
        if unfinished in (0, before):
            break
        before = unfinished
    ends = step.join(links.select(F.col("old").alias("now"), F.lit(True).alias("_on")).hint("merge"), "now", "left")
    circular = F.coalesce("_on", F.lit(False))
    return ends.select("old", F.when(~circular, F.col("now")).alias("now"), F.when(~circular, F.col("steps")).alias("steps"), circular.alias("circular"))


def _sums(parts: DataFrame) -> DataFrame:
    """One level of the tree: rows (slot, n, total, gram) added up in groups of FAN slots."""

    def add(rows: pa.Table) -> pa.Table:
        total, gram = (sum(np.frombuffer(x, np.float64) for x in rows.column(c).to_pylist()) for c in ("total", "gram"))
        return pa.table({"slot": pa.array([rows.column("slot")[0].as_py() // FAN], pa.int64()), "n": pa.array([int(sum(rows.column("n").to_pylist()))], pa.int64()), "total": [total.tobytes()], "gram": [gram.tobytes()]})

    return parts.groupBy(F.floor(F.col("slot") / FAN).alias("up")).applyInArrow(lambda _, rows: add(rows), "slot bigint, n bigint, total binary, gram binary")


def plane(points: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x, y): the first two principal components of the vectors, each stretched to 0 to 1; null for a null vector.

    A component's sign is that its entry of the greatest size is positive.  An
    axis along which all points agree is 0.5 everywhere.
    """
    held = points.where(F.col(vector).isNotNull()).select(F.col(key).alias(key), F.col(vector).alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                n, total, gram = n + len(m), total + m.sum(axis=0), gram + m.T @ m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()]), pa.array([gram.tobytes()])], names=["n", "total", "gram"])

    first = held.select("v").mapInArrow(sums, "n bigint, total binary, gram binary").withColumn("slot", F.spark_partition_id().cast("bigint"))
    parts = materialise(first.select("slot", "n", "total", "gram"), "sums", narrow=False)
    rows = parts.agg(F.max("slot")).first()[0]
    while rows is not None and parts.count() > 1:
        smaller = materialise(_sums(parts), "sums", narrow=False)
        discard(parts)
        parts = smaller
    whole = parts.first()
    if whole is None:
        return points.select(key, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    mean = np.frombuffer(whole["total"]) / whole["n"]
    d = len(mean)
    spread = np.frombuffer(whole["gram"]).reshape(d, d) / whole["n"] - np.outer(mean, mean)
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :2]
    axes = np.column_stack([axes, np.zeros((d, 2 - axes.shape[1]))])
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_matrix(batch.column(1)) - mean) @ axes if batch.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], names=[key, "x", "y"])

    flat = materialise(held.mapInArrow(drawn, held.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).schema), "plane", narrow=True)
    ends = flat.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max))])
    wide = lambda c: F.col(f"most_{c}") - F.col(f"least_{c}")
    even = lambda c: F.when(wide(c) > 1e-12, (F.col(c) - F.col(f"least_{c}")) / wide(c)).otherwise(0.5).alias(c)
    scaled = flat.join(F.broadcast(ends), F.lit(True)).select(F.col(key), even("x"), even("y"))  # one row
    return points.where(F.col(vector).isNull()).select(key, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")).unionByName(scaled)
