"""Digest trees: manifests of any size, compared by descent.

Rows are dealt by the hash of their key and content into the leaves of a tree: a leaf is
known by the first binary digits of that hash, a node above by fewer.  A leaf's
digest is that of its distinct rows in order, each with its count, an inner node's that of its
children's; so no row of any frame holds more than a leaf's lines or a node's
children, a changed row changes the paths of its old and new content, and two trees are compared from the
root down, level by level, reading below a node only where it differs.

The number of leaves follows from the number of rows (about ``LEAF_ROWS`` a
leaf), and is part of the manifest: trees are compared at the manifest's depth.

Defined results: a row is (part, key, content digest); null parts, keys and
digests are empty strings; rows that repeat count each; an empty part has no
node, an empty table no tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise

#: Rows of a leaf, about, and digits that a level adds: a node has 2 ** STEP children at most.
LEAF_ROWS, STEP = 1024, 4


def depth_for(rows: int) -> int:
    """Binary digits of a leaf for so many rows: a multiple of STEP."""
    digits = 0
    while rows > LEAF_ROWS << digits:
        digits += STEP
    return digits


def node_of(line: Column, digits: int) -> Column:
    """The first ``digits`` binary digits of a row's MD5, as hexadecimal: STEP is a hexadecimal digit."""
    return F.substring(F.md5(line), 1, digits // STEP)


def _lines(rows: DataFrame, digits: int, part: str, key: str, digest: str) -> DataFrame:
    """(part, key, line, node) of rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = rows.select(text(part).alias("part"), text(key).alias("key"), F.concat_ws("\t", text(key), text(digest)).alias("line"))
    return named.withColumn("node", node_of(F.col("line"), digits))


def leaves(rows: DataFrame, digits: int, part: str = "part", key: str = "key", digest: str = "digest") -> DataFrame:
    """(part, node, n, digest) of the leaves of ``rows`` (part, key, digest)."""
    each = _lines(rows, digits, part, key, digest).groupBy("part", "node", "line").count()
    counted = F.concat_ws("\t", "line", F.col("count").cast("string"))
    return each.groupBy("part", "node").agg(F.sum("count").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(counted)), "\n"), 256).alias("digest"))


def above(level: DataFrame, digits: int) -> DataFrame:
    """The level above one of nodes with ``digits`` digits."""
    up = F.substring("node", 1, max(0, digits // STEP - 1))
    child = F.concat_ws("\t", "node", "digest")
    return level.groupBy("part", up.alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("digest"))


def tree(rows: DataFrame, digits: int | None = None, **columns: str) -> DataFrame:
    """(part, level, node, n, digest): all nodes; level 0 is the parts' roots, the last one the leaves."""
    if digits is None:
        digits = depth_for(rows.count())
    level = materialise(leaves(rows, digits, **columns), "leaves")
    out = level.withColumn("level", F.lit(digits // STEP))
    for left in range(digits, 0, -STEP):
        level = materialise(above(level, left), "nodes", narrow=True)
        out = out.unionByName(level.withColumn("level", F.lit(left // STEP - 1)))
    return out.select("part", "level", "node", "n", "digest")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, node, state) of the leaves that differ between two trees of one depth: changed, missing (from ``b``) or added.

    Level by level the differing nodes' children are compared, so of the levels below only what lies under them is joined.
    """
    last = a.unionByName(b).agg(F.max("level")).first()[0]
    found = None
    for level in range((last or 0) + 1):
        mine = a.where(F.col("level") == level).select("part", "node", F.col("digest").alias("d1"))
        other = b.where(F.col("level") == level).select("part", "node", F.col("digest").alias("d2"))
        if found is not None:
            under = found.select("part", F.col("node").alias("up"))
            mine, other = (x.withColumn("up", F.substring("node", 1, level - 1)).join(under, ["part", "up"], "left_semi").drop("up") for x in (mine, other))
        both = mine.join(other, ["part", "node"], "full_outer").where(~F.col("d1").eqNullSafe(F.col("d2")))
        state = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "added").otherwise("changed")
        found = materialise(both.select("part", "node", state.alias("state")), "differing", narrow=True)
    return found


def changed_rows(a: DataFrame, b: DataFrame, digits: int, part: str = "part", key: str = "key", digest: str = "digest") -> DataFrame:
    """(part, key, state) of the keys whose rows are changed, missing from ``b`` or added there: only rows of differing leaves are compared."""
    nodes = differing(*(tree(df, digits, part=part, key=key, digest=digest) for df in (a, b))).select("part", "node")

    def under(df: DataFrame, name: str) -> DataFrame:
        cut = _lines(df, digits, part, key, digest).join(nodes, ["part", "node"], "left_semi")
        return cut.groupBy("part", "key", "line").count().select("part", "key", "line", F.col("count").alias(name))

    both = under(a, "n1").join(under(b, "n2"), ["part", "key", "line"], "full_outer").where(~F.col("n1").eqNullSafe(F.col("n2")))
    fewer, more = F.coalesce("n1", F.lit(0)) > F.coalesce("n2", F.lit(0)), F.coalesce("n1", F.lit(0)) < F.coalesce("n2", F.lit(0))
    sides = both.groupBy("part", "key").agg(F.bool_or(fewer).alias("less"), F.bool_or(more).alias("plus"))
    return sides.select("part", "key", F.when(F.col("less") & F.col("plus"), "changed").when(F.col("less"), "missing").otherwise("added").alias("state"))
