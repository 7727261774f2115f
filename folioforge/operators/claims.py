"""Claim rows of clusters: keys of what a cluster holds, rewriting of the clusters that changed, backfill from keys.

The table is Parquet in ``parts`` folders, a cluster's rows in one of them.  A
rewrite replaces the folders of the clusters that changed and leaves the others'
files as they are.  Each folder is swapped on its own when the job commits: a
driver lost in the middle leaves some folders new and some old, and running the
same rewrite again gives the same rows.

Defined results: a claim is known by (cluster, artifact, claim_index); of rows
that repeat it the greatest by text and document stays; rows without a cluster,
artifact or text are left out; a cluster without claims has no key and is never filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import discard, materialise

SCHEMA = "cluster bigint, artifact bigint, claim_index int, claim_hash string, text string, document bigint"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
#: Hexadecimal digits of a limb of a claim's digest, and limbs that a key adds up.
DIGITS, LIMBS = 12, 5


def set_key(artifact: Column, text: Column, counted: Column | None = None) -> Column:
    """Aggregate: the key of a multiset of claims, alike in any order; null for none.

    The claims' digests are added up limb by limb, so that every task adds up its own share and
    no row holds a cluster's claims.  ``counted`` says which rows are in the set.
    """
    digest = F.sha2(F.concat_ws("\t", artifact.cast("string"), text), 256)
    limb = lambda i: F.conv(F.substring(digest, 1 + i * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)")
    inside = F.lit(True) if counted is None else counted
    sums = [F.sum(F.when(inside, limb(i))).cast("string") for i in range(LIMBS)]
    n = F.count_if(inside)
    return F.when(n > 0, F.sha2(F.concat_ws(".", n.cast("string"), *sums), 256))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("cluster"), F.lit(parts)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The claim rows in ``path``; none where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{SCHEMA}, part int")
    return spark.read.schema(f"{SCHEMA}, part int").parquet(path)


def rewrite(rows: DataFrame, path: str, replaced: DataFrame | None = None, parts: int = 256) -> None:
    """Put ``rows`` (cluster, artifact, claim_index, text, document) in place of what their clusters held.

    Clusters of ``replaced`` (cluster) that have no rows any more are emptied.  ``parts`` must be the same
    at every rewrite.  A folder with a large cluster is written by several tasks.
    """
    spark = rows.sparkSession
    whole = rows.where("cluster is not null and artifact is not null and text is not null")
    best = F.max(F.struct("text", "document")).alias("_best")
    fresh = whole.groupBy("cluster", "artifact", F.col("claim_index").cast("int").alias("claim_index")).agg(best)
    fresh = fresh.select("cluster", "artifact", "claim_index", F.sha2("_best.text", 256).alias("claim_hash"), "_best.text", "_best.document")
    fresh = materialise(fresh.withColumn("part", _part(parts)), "claims")
    changed = fresh.select("cluster", "part")
    if replaced is not None:
        changed = changed.unionByName(replaced.where("cluster is not null").select(F.col("cluster").cast("bigint").alias("cluster")).withColumn("part", _part(parts)))
    changed = materialise(changed.distinct(), "changed", narrow=True)
    touched = [r[0] for r in changed.select("part").distinct().collect()]  # at most ``parts``
    if touched:
        carried = read(spark, path).where(F.col("part").isin(touched)).join(changed.select("cluster"), "cluster", "left_anti")
        new = materialise(carried.select(*NAMES, "part").unionByName(fresh.select(*NAMES, "part")), "rewritten")
        held = new.select("part").distinct()
        new.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        _drop(spark, path, set(touched) - {r[0] for r in held.collect()})
        discard(new)
    discard(fresh, changed)


def _drop(spark: SparkSession, path: str, emptied: set[int]) -> None:
    """Delete the folders of parts that hold no rows any more: a dynamic overwrite leaves these as they were."""
    for part in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part={part}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def backfill(clusters: DataFrame, members: DataFrame, claims: DataFrame, listed: DataFrame, path: str, parts: int = 256) -> DataFrame:
    """(cluster, how, n): clusters that have a key but no rows in ``path``, filled without clustering anew.

    ``clusters`` (cluster, size, member_key), ``members`` (cluster, artifact, document), ``claims`` (artifact, claim_index, text),
    ``listed`` (cluster, text): what the clusters' summaries state.  All claims of a cluster's members are tried first (``every``),
    then those that its summary states, if it states as many as the cluster has (``stated``); a cluster whose key neither gives is ``left``.
    Both keys come from one aggregation.
    """
    spark = clusters.sparkSession
    held = read(spark, path).select("cluster").distinct()
    open_ = clusters.where("cluster is not null and member_key is not null").join(held, "cluster", "left_anti")
    stated = listed.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("_told"))
    told = listed.where("cluster is not null and text is not null").select("cluster", "text").distinct().withColumn("_said", F.lit(True))
    # repeated members are one
    places = members.where("artifact is not null").groupBy("cluster", "artifact").agg(F.max("document").alias("document"))
    candidates = places.join(open_.select("cluster"), "cluster", "left_semi").join(claims.where("text is not null"), "artifact").join(told, ["cluster", "text"], "left")
    candidates = materialise(candidates.select("cluster", "artifact", "claim_index", "text", "document", F.coalesce("_said", F.lit(False)).alias("said")), "candidates")
    keys = candidates.groupBy("cluster").agg(
        set_key(F.col("artifact"), F.col("text")).alias("_every"), set_key(F.col("artifact"), F.col("text"), F.col("said")).alias("_said"), F.count("*").alias("_n"), F.count_if("said").alias("_m")
    )
    tried = open_.join(stated, "cluster", "left").join(keys, "cluster", "left")
    how = F.when(F.col("_every") == F.col("member_key"), "every").when((F.col("_told") == F.col("size")) & (F.col("_said") == F.col("member_key")), "stated").otherwise("left")
    n = F.when(F.col("how") == "every", F.col("_n")).when(F.col("how") == "stated", F.col("_m")).otherwise(0)
    out = materialise(tried.withColumn("how", how).select("cluster", "how", n.alias("n")), "filled", narrow=True)
    kept = candidates.join(out.where("how <> 'left'").select("cluster", "how"), "cluster").where("how = 'every' or said")
    rewrite(kept, path, parts=parts)
    discard(candidates)
    return out
