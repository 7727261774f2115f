"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken target / source size times on
average.  The whole part is certain; the fractional parts are rounded in pairs:
of two masses one is made integral by moving mass at random, the other carries
the rest on, so that sums are kept.  Documents are paired with others of their
source and size class, in blocks of about ``BLOCK`` documents; the rests of
``FAN`` blocks are rounded together, and so on up a tree, then the rests of a
source's size classes, largest first.  Masses are integers out of 2**30, so
nothing is lost on the way; random numbers are hashes of what is paired, so
reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, ranked last; repeated rows are documents of
their own; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialise

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BLOCK, FAN = 48, 48
_ONE = 1 << 30


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh WEIGHTS in turn; a target
    stops at MAX_COPIES times its source and the excess is shared by weight,
    so every other source gets the same amount per weight.  That amount follows
    from running sums over the sources, ordered by where they stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    ranked = sizes.withColumn("weight", cases.cast("double")).withColumn("stop", (MAX_COPIES * F.col("source_size")).cast("double"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    upto = by_stop.rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.withColumns(
        {
            "total": F.sum("source_size").over(every).cast("double"),
            "stopped": F.sum("stop").over(upto) - F.col("stop"),
            "open": F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"),
        }
    ).withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    # the first source that the level doesn't fill gives the level of all that follow
    found = summed.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct((F.col("stop") / F.col("weight")).alias("at"), "level"))).over(every)["level"])
    return found.select("source", "source_size", F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("level") * F.col("weight"))).alias("target"))


#: One step of rounding: the accumulator holds the unit that carries mass, and those that are settled.
_STEP = """(acc, x) -> if(acc.rest.mass = 0, named_struct('rest', x, 'done', if(acc.rest.size is null, acc.done, array_append(acc.done, named_struct('unit', acc.rest, 'up', 0)))),
  transform(array(named_struct('sum', acc.rest.mass + x.mass, 'u', pmod(xxhash64(acc.rest.key, x.key, acc.rest.mass, x.mass, '{seed}'), {one}L))), s ->
    if(s.sum < {one}L,
       if(s.u * s.sum < x.mass * {one}L,
          named_struct('rest', named_struct('size', x.size, 'key', x.key, 'doc_id', x.doc_id, 'mass', s.sum), 'done', array_append(acc.done, named_struct('unit', acc.rest, 'up', 0))),
          named_struct('rest', named_struct('size', acc.rest.size, 'key', acc.rest.key, 'doc_id', acc.rest.doc_id, 'mass', s.sum), 'done', array_append(acc.done, named_struct('unit', x, 'up', 0)))),
       if(s.u * (2 * {one}L - s.sum) < ({one}L - x.mass) * {one}L,
          named_struct('rest', named_struct('size', x.size, 'key', x.key, 'doc_id', x.doc_id, 'mass', s.sum - {one}L), 'done', array_append(acc.done, named_struct('unit', acc.rest, 'up', 1))),
          named_struct('rest', named_struct('size', acc.rest.size, 'key', acc.rest.key, 'doc_id', acc.rest.doc_id, 'mass', s.sum - {one}L), 'done', array_append(acc.done, named_struct('unit', x, 'up', 1))))))[0])"""

_UNIT = "struct<size:bigint,key:bigint,doc_id:bigint,mass:bigint>"


def _rounded(groups: DataFrame, keys: list[str], order: str, seed: str) -> DataFrame:
    """Round the units of each group in turn: a row with ``rest`` and ``done`` for each."""
    start = f"named_struct('rest', cast(named_struct('size', null, 'key', 0L, 'doc_id', null, 'mass', 0L) as {_UNIT}), 'done', cast(array() as array<struct<unit:{_UNIT},up:int>>))"
    step = _STEP.format(one=_ONE, seed=seed)
    listed = groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("at"), "unit"))).alias("_units"))
    return listed.withColumn("_out", F.expr(f"aggregate(transform(_units, y -> y.unit), {start}, {step})")).select(*keys, "_out.rest", "_out.done")


def _row_key(doc_id: str, text: str, source: str, seed: str) -> Column:
    """Hash of a row; its source counts, as one document may stand under several."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(source), F.col(source).isNull(), F.lit(seed))


def mix(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, row_key): one row per row of ``docs``."""
    key = _row_key(doc_id, text, source, seed)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), key.alias("row_key"))
    # rows that repeat are numbered, so that copies of one are dealt over all blocks
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
    rows = materialise(rows.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")), "sizes", narrow=True)
    goals = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets", narrow=True)
    most = rows.groupBy("source", "class").count().agg(F.max("count")).head()[0] or 0
    blocks = -(-most // BLOCK) or 1
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share_units = F.round(share * _ONE).cast("bigint")
    named = (
        rows.alias("r")
        .join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_units", F.when(F.col("size") > 0, share_units).otherwise(F.lit(0)))
        .withColumn("base", F.floor(F.col("_units") / _ONE).cast("bigint"))
        .withColumn("mass", (F.col("_units") - F.col("base") * _ONE).cast("bigint"))
        .drop("_units")
    )
    carried = ["source", "source_size", "target", "base"]
    unit = F.struct("size", F.col("row_key").alias("key"), "doc_id", "mass").cast(_UNIT).alias("unit")
    whole = named.where("mass = 0").select(*carried, unit, F.lit(0).alias("up"))
    level = named.where("mass > 0").select(*carried, "class", F.pmod(F.hash("row_key", "copy"), F.lit(blocks)).alias("block"), unit)
    done = [whole]
    while True:
        level = materialise(_rounded(level, [*carried, "class", "block"], "named_struct('size', unit.size, 'key', unit.key)", seed), "level", narrow=True)
        done.append(level.select(*carried, F.explode("done").alias("d")).select(*carried, "d.unit", "d.up"))
        level = level.select(*carried, "class", F.floor(F.col("block") / FAN).cast("int").alias("block"), F.col("rest").alias("unit"))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN)
    last = _rounded(level, carried, "named_struct('size', -class, 'key', unit.key)", seed)
    done.append(last.select(*carried, F.explode("done").alias("d")).select(*carried, "d.unit", "d.up"))
    # the root's rest: rounded up with the probability of its mass
    end = F.expr(f"cast(pmod(xxhash64(rest.key, rest.mass, '{seed}', 'root'), {_ONE}L) < rest.mass as int)")
    done.append(last.where("rest.size is not null").select(*carried, F.col("rest").alias("unit"), end.alias("up")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("up")).cast("bigint")
    return out.select(
        F.col("unit.doc_id").alias("doc_id"), F.col("unit.size").alias("size"), "source_size", "target", (F.col("unit.size") * copies).alias("taken"), "source", copies.alias("copies"), F.col("unit.key").alias("row_key")
    )


def mix_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target, taken and copies (1 or more)."""
    added = ["size", "source_size", "target", "taken", "copies"]
    by_key = Window.partitionBy("row_key")
    chosen = mix(docs, seed).where("copies > 0 and size > 0").select("row_key", *added).withColumn("turn", F.row_number().over(by_key.orderBy(F.desc("copies"))))
    # rows that repeat id, text and source are told apart by all their columns
    keyed = docs.drop(*added).withColumn("row_key", _row_key("doc_id", "text", "source", seed))
    keyed = keyed.withColumn("turn", F.row_number().over(by_key.orderBy(*[c for c in docs.columns if c not in (*added, "text")])))
    return keyed.join(chosen, ["row_key", "turn"]).drop("row_key", "turn")
