"""An inverted file over vectors: cells around centres, stored as Parquet, searched by the cells near a query.

Centres come from a bounded sample; every vector is put into the cell of the
centre at the least angle, and rows are stored in the order of cells, so that a
search for few cells skips the files' other row groups.  A search probes the
cells nearest to each query and ranks what they hold by exact cosine.

The triangle inequality of angles tells which other cells can hold anything as
near as the k-th found: no point of a cell is nearer than the angle to its
centre less the cell's radius.  With ``exact`` those are read too, and the
result is that of comparing all pairs; without, it is what the probed cells
hold, and ``recall`` measures how much of the truth that is.

Cells are dealt into blocks of points and the queries of
a cell likewise, so that neither a large cell nor one that most queries fall
into is a single task.

Defined results: null vectors, and those of no length, are neither stored nor
searched; ties go to the lesser key; a query doesn't find its own key; an empty
table makes an index without cells, which finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators import vectors
from folioforge.operators.vectors import _matrix, _unit
from folioforge.session import materialise

#: Bound of the fit: cells, rows drawn for each, rounds of moving the centres.  At 1,024 dimensions that is 134 MB on the driver.
MAX_CELLS, SAMPLE_A_CELL, ROUNDS = 2048, 16, 10
#: Angles are compared with this slack, for what rounding does to them.
SLACK = 1e-6


@dataclass
class Index:
    """A stored index: its folder, the centres (one row a cell, of unit length), and each cell's radius and size."""

    path: str
    key: str
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def points(self, spark: SparkSession) -> DataFrame:
        """(id, v, cell) of all stored vectors."""
        return spark.read.parquet(f"{self.path}/points")


def centres_of(points: DataFrame, cells: int, key: str, vector: str) -> np.ndarray:
    """Unit centres fitted on the ``SAMPLE_A_CELL * cells`` rows whose hashed keys are least."""
    drawn = points.select(F.col(vector).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE_A_CELL * cells).select("v")
    rows = _unit(_matrix(drawn.toArrow().column(0).combine_chunks()))
    rows = rows[~np.isnan(rows).any(axis=1)] if rows.size else rows
    if not len(rows):
        return np.zeros((0, 0))
    at = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (rows @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(length > 0, sums / np.maximum(length, 1e-12), at)  # an empty cell keeps its centre
    return np.unique(at, axis=0)


def build(points: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", vector: str = "embedding") -> Index:
    """Store ``points`` as an index in the folder ``path``; about the square root of their number of cells, unless told."""
    spark = points.sparkSession
    held = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n = held.count()
    centres = centres_of(held, min(MAX_CELLS, cells or max(1, round(n**0.5))), "id", "v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1))) if len(centres) else np.zeros((batch.num_rows, 0))
            good = ~np.isnan(unit).any(axis=1) if len(centres) else np.zeros(batch.num_rows, bool)
            near = unit[good] @ centres.T if good.any() else np.zeros((0, 1))
            kept = batch.filter(pa.array(good))
            own = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(near)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own, pa.int32()), pa.array(angle, pa.float64())], names=["id", "v", "cell", "angle"])

    schema = held.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).schema
    placed = held.mapInArrow(assign, schema)
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/points")
    stored = spark.read.parquet(f"{path}/points")
    stats = stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("size")).collect()  # MAX_CELLS rows at most
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in stats:
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["size"]
    cells_table = spark.createDataFrame([(i, c.tolist(), float(r), int(s)) for i, (c, r, s) in enumerate(zip(centres, radius, size))], "cell int, centre array<double>, radius double, size bigint")
    cells_table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Index(path, key, centres, radius, size)


def load(spark: SparkSession, path: str, key: str = "vec_id") -> Index:
    """The index stored in a folder."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))
    return Index(path, key, centres, np.array([r["radius"] for r in rows]), np.array([r["size"] for r in rows], np.int64))


def _visit(index: Index, wanted: DataFrame, k: int, least: float, earlier: bool) -> DataFrame:
    """(query_id, id, sim): the k best of each query's cells, block by block; ``wanted`` has (query_id, qv, cell)."""
    stored = index.points(wanted.sparkSession).select("id", "v", "cell")
    asked = [r[0] for r in wanted.select("cell").distinct().collect()]  # a row a cell
    if len(asked) < len(index.centres):
        stored = stored.where(F.col("cell").isin(asked))
    return vectors.nearest_within(stored, wanted.select(F.col("query_id").alias("id"), F.col("qv").alias("v"), "cell"), "cell", k, least, earlier)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, least: float = -1.0, exact: bool = True, earlier: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, sim, rk): the k nearest other points of every query by cosine, above ``least``; ``earlier`` admits lesser keys alone."""
    spark = queries.sparkSession
    centres, radius = index.centres, index.radius
    asked = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).alias("qv"))
    empty = spark.createDataFrame([], f"query_id bigint, {index.key} bigint, sim double, rk int")
    if not len(centres):
        return empty
    probes = min(probes, len(centres))

    def cells(batches: Iterator[pa.RecordBatch], further: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1)))
            angles = np.arccos(np.clip(np.nan_to_num(unit, nan=0.0) @ centres.T, -1, 1))
            order = np.argsort(angles, axis=1, kind="stable")
            near = np.zeros(angles.shape, bool)
            np.put_along_axis(near, order[:, :probes], True, axis=1)
            # no point of the cell can be nearer than this
            bound = np.maximum(angles - radius[None, :] - SLACK, 0)
            may = bound < np.arccos(np.clip(least, -1, 1)) + SLACK if least > -1 else np.ones(angles.shape, bool)
            if further:
                worst = batch.column(2).to_numpy(zero_copy_only=False)
                may &= ~near & (bound <= np.arccos(np.clip(worst, -1, 1))[:, None] + SLACK)
            else:
                may &= near
            at, cell = np.nonzero(may & ~np.isnan(unit).any(axis=1)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cell, pa.int32())], names=["query_id", "qv", "cell"])

    schema = asked.select("*", F.lit(0).alias("cell")).schema
    wanted = asked.mapInArrow(lambda b: cells(b, False), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "id")
    found = _visit(index, wanted, k, least, earlier).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    if exact:
        found = materialise(found, "probed", narrow=True)
        worst = found.where(F.col("rk") == k).select("query_id", F.col("sim").alias("worst"))
        # what has fewer than k so far must look wherever anything can be
        rest = asked.join(worst, "query_id", "left").select("query_id", "qv", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
        more = _visit(index, rest.mapInArrow(lambda b: cells(b, True), schema), k, least, earlier)
        both = found.drop("rk").unionByName(more)
        found = both.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    return found.select("query_id", F.col("id").alias(index.key), "sim", "rk")


def curve(index: Index, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Of the true k nearest of all ``queries``, by comparing all pairs, the share that each number of probed cells finds, from none to all.

    A true neighbour is found as soon as its own cell is probed: what goes before it among all points is no more among fewer. So
    the place of its cell among those near the query tells, and nothing is searched again for each number.
    """
    spark = queries.sparkSession
    cells = len(index.centres)
    if not cells:
        return np.ones(1)
    asked = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    stored = index.points(spark)
    truth = vectors.nearest(stored, asked, k, key="id", vector="v").select("query_id", "id").join(stored.select("id", "cell"), "id")
    held = truth.groupBy("query_id").agg(F.collect_list("cell").alias("cells"))  # k a query
    met = asked.withColumnRenamed("id", "query_id").join(held, "query_id").select("v", "cells")
    centres = index.centres

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = np.arccos(np.clip(_unit(_matrix(batch.column(0))) @ centres.T, -1, 1))
            place = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1)
            own = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(place[own, batch.column(1).flatten().to_numpy()], pa.int64())], names=["place"])

    counts = np.zeros(cells)
    for r in met.mapInArrow(places, "place bigint").groupBy("place").agg(F.count("*").alias("n")).collect():  # a row a cell at most
        counts[r["place"]] = r["n"]
    total = counts.sum()
    return np.append(0.0, counts.cumsum() / total) if total else np.ones(cells + 1)


def recall(index: Index, queries: DataFrame, k: int, probes: list[int], key: str = "vec_id", vector: str = "embedding", known: np.ndarray | None = None) -> DataFrame:
    """(probes, recall, share): of the true k nearest of all ``queries``, what that many probed cells find, and the share of points they hold; ``known`` is their ``curve``."""
    found = curve(index, queries, k, key, vector) if known is None else known
    share = lambda p: float(np.sort(index.size)[::-1][:p].sum() / max(1, index.size.sum()))
    out = [(p, float(found[min(p, len(found) - 1)]), share(p)) for p in probes]
    return queries.sparkSession.createDataFrame(out, "probes int, recall double, share double")


def probes_for(index: Index, queries: DataFrame, k: int, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", known: np.ndarray | None = None) -> int:
    """The least power of two of probed cells that finds the share ``least`` of the true neighbours of ``queries``."""
    found = curve(index, queries, k, key, vector) if known is None else known
    probes = 1
    while probes < len(index.centres) and found[probes] < least:
        probes *= 2
    return min(probes, max(1, len(index.centres)))
