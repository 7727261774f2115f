"""Exact nearest neighbours in blocks, near-duplicate vectors, anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.vectors import cosine

#: Vectors of a block, about, and queries of it that are multiplied at a time.
BLOCK_VECTORS, STRIP = 4096, 256


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)


def _met(points: DataFrame, queries: DataFrame, key: str, vector: str):
    """Points and queries dealt into blocks, cogrouped by pair of blocks: one job, whatever the number of blocks."""
    held = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    sizes = held.agg(F.count("*").alias("p")).join(asked.agg(F.count("*").alias("q")), F.lit(True)).first()
    np_, nq = (max(least, -(-n // BLOCK_VECTORS)) for n, least in ((sizes[0], 8), (sizes[1], 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = held.select("id", "v", block(np_).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("y"))
    right = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))).alias("x"), block(nq).alias("y"))
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y"))


def _sides(points: pa.Table, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and unit vectors (NaN for one of no length) of a block's points and queries."""
    held = [(t.column("id").to_numpy(), _unit(_matrix(t.column("v").combine_chunks()))) for t in (points, queries)]
    return *held[0], *held[1]


def _strips(points: pa.Table, queries: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of a block's points and of some of its queries, and their cosines (query by point): a task holds a strip of the product, not all of it."""
    own, p, ids, q = _sides(points, queries)
    if len(own):
        for n in range(0, len(ids), STRIP):
            yield own, ids[n : n + STRIP], q[n : n + STRIP] @ p.T


def _best(points: pa.Table, queries: pa.Table, k: int, least: float, earlier: bool, slack: float, name: str) -> pa.Table:
    """(query_id, name, sim): each query's k best points of the block, and all that come within ``slack`` of the last of them."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for own, ids, sims in _strips(points, queries):
        sims[np.isnan(sims) | (sims <= least)] = -np.inf
        sims[(ids[:, None] <= own[None, :]) if earlier else (ids[:, None] == own[None, :])] = -np.inf
        cut = np.partition(sims, -k, axis=1)[:, -k][:, None] if len(own) > k else np.full((len(ids), 1), -np.inf)
        at, to = np.nonzero((sims >= cut - slack) & np.isfinite(sims))
        out.append((ids[at], own[to], sims[at, to]))
    return pa.table(dict(zip(("query_id", name, "sim"), map(np.concatenate, zip(*out)))))


def nearest(points: DataFrame, queries: DataFrame, k: int, least: float = -1.0, key: str = "vec_id", vector: str = "embedding", earlier: bool = False) -> DataFrame:
    """(query_id, key, sim, rk): the k nearest other points of every query vector by cosine.

    Both sides are dealt into blocks of about ``BLOCK_VECTORS``; each pair of
    blocks is multiplied in one task, which keeps k a query, and these
    candidates are ranked.  ``earlier`` admits lesser keys alone.
    """

    run = lambda p, q: _best(p, q, k, least, earlier, 1e-9, key)
    found = _met(points, queries, key, vector).applyInArrow(run, f"query_id bigint, {key} bigint, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), key)
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def nearest_within(points: DataFrame, queries: DataFrame, group: str, k: int, least: float = -1.0, earlier: bool = False) -> DataFrame:
    """(query_id, id, sim): for each query (id, v, group) the k best points of its group in each block, and all that equal the last of them.

    Points and queries of a group are dealt into blocks of about ``BLOCK_VECTORS`` each, so a
    group with most of the rows is many tasks, and no pair becomes a row but what a block keeps.
    """
    blocks = lambda df, name: df.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias(name))
    sizes = blocks(points, "np").join(blocks(queries, "nq"), group)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # named anew, as both sides may come from one frame
    own = [F.col(c).alias(c) for c in ("id", "v", group)]
    left = points.join(sizes, group).select(*own, deal("np").alias("x"), every("nq").alias("y"))
    right = queries.join(sizes, group).select(*own, every("np").alias("x"), deal("nq").alias("y"))

    run = lambda p, q: _best(p, q, k, least, earlier, 0.0, "id")
    return left.groupBy(group, "x", "y").cogroup(right.groupBy(group, "x", "y")).applyInArrow(run, "query_id bigint, id bigint, sim double")


def pairs_above(points: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b) with a < b: pairs of points, block by block, whose cosine is above ``least``, as far as they join parts.

    Of a block pair's links a spanning forest is kept, enough for connected parts: rows are bounded by the members of the blocks.
    """

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        names = np.unique(np.concatenate([p.column("id").to_numpy(), q.column("id").to_numpy()]))
        part, a, b = np.arange(len(names)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, ids, sims in _strips(p, q):
            i, j = np.nonzero((sims > least) & (ids[:, None] > own[None, :]))
            x, y = np.searchsorted(names, ids[i]), np.searchsorted(names, own[j])
            # links of points that are already in one part go at once; one of those left joins every two parts that meet
            while len(x):
                u, v = part[x], part[y]
                apart = u != v
                x, y, u, v = x[apart], y[apart], u[apart], v[apart]
                low, high = np.minimum(u, v), np.maximum(u, v)
                # each part is hung under a lesser one by a single link, so the links form no circle
                hung, first = np.unique(high, return_index=True)
                a.append(names[y[first]])
                b.append(names[x[first]])
                under = np.arange(len(names))
                under[hung] = low[first]
                while (under[under] != under).any():
                    under = under[under]
                part = under[part]
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _met(points, points, key, vector).applyInArrow(run, "a bigint, b bigint")


def lifted(sentences: DataFrame, owner: str, vector: str, point: Column, place: str) -> DataFrame:
    """``sentences`` that stand for their owners: of each the one nearest to the point, the first of equals; adds sim. Vectors without length say nothing."""
    scored = sentences.withColumn("sim", F.round(cosine(F.col(vector), point), 9)).where("sim is not null and not isnan(sim)")
    order = Window.partitionBy(owner).orderBy(F.desc("sim"), place)
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
