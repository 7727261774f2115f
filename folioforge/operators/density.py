"""Density clusters: the leaves of the hierarchy of mutual reachability, computed without a task or driver that holds it.

1. The minimum spanning tree.  Points are dealt into blocks; each pair of blocks
   gives the spanning tree of its own points, and since a link that isn't in the
   tree of some points isn't in the tree of more, these hold the whole tree.
   Boruvka rounds over them (each part takes its least link out) leave it.
2. Births.  A point is in a cluster once its part has ``min_size`` points; the
   link that makes it so is found from the least links of the points nearby,
   in ``min_size - 1`` steps over lists of that length.
3. Splits.  A link whose ends both are in clusters before it joins two
   clusters: seen from above, one cluster splits in two there.
4. Leaves.  Without those links the tree falls into groups of one birth each.  A
   group's first split ends its leaf: the leaf is what the group's links below
   that one connect with its end; what joins later is noise.

Links are ordered by length and then by ids, so the hierarchy is binary and
reruns agree.  Vectors are made unit length; a point's core distance is that to
its ``min_samples``-th nearest point, itself counted, so with 1 it is 0.

Defined results: a null vector or one of no length is noise; without any split
all points are noise; equal points are linked at distance 0; ids are unique, a
repeated one counts once with any of its vectors; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import vectors
from folioforge.operators.lifecycle import connected
from folioforge.session import discard, materialise

#: Points of a block, about: a pair of blocks is one task, which holds its points and no matrix of distances. A point is dealt to as
#: many pairs as there are blocks, so large ones make few copies; fewer points than these are dealt into up to ``LEAST_BLOCKS`` of ``SMALL_POINTS``.
BLOCK_POINTS, SMALL_POINTS, LEAST_BLOCKS = 8192, 1024, 8


def _tree(ids: np.ndarray, unit: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning tree (a, b, length) of some points, grown point by point in the order of length and ids."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, length = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    # the points outside the tree lie at the front; those taken are marked, and now and then the others move up
    own, at, far, best, lo, hi = ids[1:].copy(), unit[1:].copy(), core[1:].copy(), np.full(n - 1, np.inf), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    open_, taken = np.ones(n - 1, bool), 0
    last, point, reach = ids[0], unit[0], core[0]
    for step in range(n - 1):
        d = lengths(at @ point)
        np.maximum(d, far, out=d)
        np.maximum(d, reach, out=d)
        near = np.flatnonzero((d <= best) & open_)
        l2, h2 = np.minimum(own[near], last), np.maximum(own[near], last)
        d, b0, l0, h0 = d[near], best[near], lo[near], hi[near]
        nearer = (d < b0) | ((d == b0) & ((l2 < l0) | ((l2 == l0) & (h2 < h0))))
        near = near[nearer]
        best[near], lo[near], hi[near] = d[nearer], l2[nearer], h2[nearer]
        i = best.argmin()
        least = np.flatnonzero(best == best[i])
        if len(least) > 1:
            i = least[np.lexsort((hi[least], lo[least]))[0]]
        a[step], b[step], length[step] = lo[i], hi[i], best[i]
        last, point, reach = own[i], at[i].copy(), far[i]
        best[i], open_[i], taken = np.inf, False, taken + 1
        if 8 * taken > len(own) and taken < len(own):
            own, at, far, best, lo, hi = (x[open_] for x in (own, at, far, best, lo, hi))
            open_, taken = np.ones(len(own), bool), 0
    return a, b, length


def lengths(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their cosines, rounded so that equal points are at 0."""
    return np.sqrt(np.maximum(np.round(2 - 2 * cosines, 12), 0))


def _unit_points(points: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the points that have a direction, one row an id, v of unit length."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = points.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.withColumn("n", norm).where("n > 0").dropDuplicates(["id"]).select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _blocks(n: int, block_points: int) -> int:
    """Blocks of ``n`` points, which is how often a point is dealt."""
    return max(2, -(-n // block_points), min(LEAST_BLOCKS, -(-n // SMALL_POINTS)))


def links(points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(a, b, length), a < b: the union of the spanning trees of all pairs of blocks of ``points`` (id, v, core)."""
    n = points.count()
    blocks = _blocks(n, block_points)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # a point meets its own block's pairs: (block, other), the lesser first
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    met = points.withColumn("block", block).withColumn("pair", F.explode(others)).where("pair.x <> pair.y")

    def grow(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        order = np.argsort(ids)
        unit = vectors._matrix(part.column("v").combine_chunks())[order]
        a, b, length = _tree(ids[order], unit, part.column("core").to_numpy()[order])
        return pa.table({"a": a, "b": b, "length": length})

    found = met.select("id", "v", "core", F.col("pair.x").alias("x"), F.col("pair.y").alias("y")).groupBy("x", "y").applyInArrow(grow, "a bigint, b bigint, length double")
    return found.groupBy("a", "b").agg(F.min("length").alias("length"))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(a, b, length) of the least spanning forest of weighted ``edges``, by Boruvka rounds: every part takes its least link out."""
    own = F.struct("length", "a", "b")
    edges = materialise(edges.select("a", "b", "length"), "links", narrow=True)
    parts = materialise(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("c", F.col("v")), "parts", narrow=True)
    size, taken, picked = parts.count(), [], []
    if edges.count() == size - 1 and size > 1:  # as many links as one tree has; they hold the tree, so they are it
        return edges
    left = materialise(edges.select("*", F.col("a").alias("x"), F.col("b").alias("y")), "left", narrow=True)
    while left.limit(1).count():
        ends = left.select(own.alias("link"), F.col("x").alias("c"), F.col("y").alias("to")).union(left.select(own, "y", "x"))
        picks = materialise(ends.groupBy("c").agg(F.min(F.struct("link", "to")).alias("p")).select("c", "p.to", "p.link"), "picks", narrow=True)
        picked.append(picks)
        taken.append(picks.select("link.*").distinct())
        joined = connected(picks.select(F.col("c").alias("a"), F.col("to").alias("b")))
        renamed = lambda c: joined.select(F.col("v").alias(c), F.col("c").alias(f"n{c}"))
        after = left.join(renamed("x"), "x").join(renamed("y"), "y").where("nx <> ny").select("a", "b", "length", F.col("nx").alias("x"), F.col("ny").alias("y"))
        # of the links between two parts only the least can be in the tree
        least = after.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.min(own).alias("link")).select("link.*", F.col("p").alias("x"), F.col("q").alias("y"))
        before, left = left, materialise(least, "left", narrow=True)
        discard(joined, before)
    out = edges.limit(0)
    for more in taken:
        out = out.unionByName(more.select("a", "b", "length"))
    tree = materialise(out.distinct(), "tree", narrow=True)
    discard(edges, parts, left, *picked)
    return tree


def births(tree: DataFrame, min_size: int) -> DataFrame:
    """(v, born): the link, as (length, a, b), that brings each point's part to ``min_size`` points; null where none does."""
    link = F.struct("length", "a", "b")
    near = tree.select(F.col("a").alias("v"), link.alias("link"), F.col("b").alias("to")).union(tree.select("b", link, F.col("a")))
    # the least links of a point are enough: with min_size - 1 of them below a length the part has its size
    lists = near.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct("link", "to"))), 1, min_size - 1).alias("near"))
    lists = materialise(lists, "near", narrow=True)
    state = lists.select("v", F.array("v").alias("inside"), F.col("near").alias("open"), F.lit(None).cast("struct<length:double,a:bigint,b:bigint>").alias("most"))
    for left in range(min_size - 1, 0, -1):
        step = F.array_min(F.filter("open", lambda x: ~F.array_contains("inside", x["to"])))
        state = state.withColumn("step", step).where("step is not null")
        state = state.select("v", F.array_append("inside", F.col("step.to")).alias("inside"), "open", F.greatest("most", F.col("step.link")).alias("most"), F.col("step.to").alias("to"))
        if left > 1:
            state = state.join(lists.select(F.col("v").alias("to"), "near"), "to").select("v", "inside", F.concat("open", "near").alias("open"), "most")
    return lists.select("v").join(state.select("v", F.col("most").alias("born")), "v", "left")


def leaves(tree: DataFrame, min_size: int) -> DataFrame:
    """(v, cluster) of the points of the tree that lie in leaf clusters; a cluster is named by its least point."""
    born = materialise(births(tree, min_size), "births", narrow=True)
    side = lambda c: born.select(F.col("v").alias(c), F.col("born").alias(f"born_{c}"))
    link = F.struct("length", "a", "b")
    marked = tree.join(side("a"), "a").join(side("b"), "b").withColumn("link", link)
    marked = materialise(marked.select("a", "b", "length", "link", F.coalesce((F.col("born_a") < F.col("link")) & (F.col("born_b") < F.col("link")), F.lit(False)).alias("split")), "marked", narrow=True)
    inner = marked.where("not split").select("a", "b", "link")
    groups = connected(inner.select("a", "b"))
    ends = marked.where("split").select("link", F.col("a").alias("v")).union(marked.where("split").select("link", F.col("b")))
    # a group's first split, and the point of the group that it is at
    first = ends.join(groups, "v").groupBy("c").agg(F.min(F.struct("link", "v")).alias("e"))
    first = materialise(first.select("c", F.col("e.link").alias("ends"), F.col("e.v").alias("at")), "first_splits", narrow=True)
    below = inner.join(groups.withColumnRenamed("v", "a"), "a").join(first, "c").where("link < ends").select("a", "b")
    parts = connected(below)
    named = first.select(F.col("at").alias("v")).join(parts, "v").select("c")
    out = materialise(parts.join(named, "c", "left_semi").select("v", F.col("c").alias("cluster")), "leaves", narrow=True)
    discard(born, marked, groups, first, parts)
    return out


def core_distances(points: DataFrame, min_samples: int) -> DataFrame:
    """``points`` (id, v) with core: the distance to the ``min_samples``-th nearest point, itself counted."""
    if min_samples <= 1:
        return points.withColumn("core", F.lit(0.0))
    found = vectors.nearest(points, points, min_samples - 1, least=-2.0, key="id", vector="v")
    far = found.groupBy(F.col("query_id").alias("id")).agg(F.sqrt(F.greatest(F.round(2 - 2 * F.min("sim"), 12), F.lit(0.0))).alias("core"))
    return points.join(far, "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))


def density_clusters(points: DataFrame, min_size: int = 3, min_samples: int = 1, key: str = "vec_id", vector: str = "embedding", block_points: int = BLOCK_POINTS) -> DataFrame:
    """(key, cluster) of all points: leaf clusters of ``min_size`` points or more, named by their least key; -1 for noise."""
    held = materialise(core_distances(_unit_points(points, key, vector), min_samples), "points")
    tree = spanning_tree(links(held, block_points))
    found = leaves(tree, min_size).select(F.col("v").alias(key), "cluster")
    return points.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
