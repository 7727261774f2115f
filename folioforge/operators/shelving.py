"""Shelves: a gate for designed taxonomies, collections that a design is made for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that name an activity, not a field, and names that a form leaves.
BANNED = (
    "research education reference references resources general other misc tutorials preparation guides cheat sheets commands concepts methodologies methods techniques tools frameworks"
).split()
UNFILLED = r"(?i)\b(shelf|category|topic)\s*\d*$"
#: Letters above which a word that two top shelves share shows one field cut in two; volumes below which a collection isn't designed for.
LONG_WORD, FEWEST = 4, 20


def taxonomy_faults(shelves: DataFrame, most: int) -> DataFrame:
    """(design, tops, sizes, unfilled, activity, alike, single, repeated, sane): what speaks against each design.

    ``shelves``: (design, shelf, top, sub), a row for each sub-shelf, null where a shelf has none.  ``most``: top shelves wanted.
    Each fault is a boolean: more than one shelf too many (sizes), a name left over from a form, a top shelf named after an
    activity, two tops that hold one another or share a long word, a top with fewer than two subs, a sub named like a
    top or another sub.  Tops are compared in pairs only where ``sizes`` holds, so a design gives (most + 1) squared pairs at most.
    A null name is an empty one; a design without a top is too small.
    """
    name = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    each = shelves.groupBy("design", "shelf").agg(name(F.max("top")).alias("top"), F.count("sub").alias("subs"))
    words = F.split("top", r"[\s&/-]+")
    activity = F.exists(words, lambda w: w.isin(BANNED))
    tops = each.groupBy("design").agg(F.count("*").alias("tops"), (F.min("subs") < 2).alias("single"), F.bool_or(activity).alias("activity"))

    small = each.join(tops.where(F.col("tops") <= most + 1).select("design"), "design", "left_semi")
    long_words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > LONG_WORD)
    other = small.select("design", F.col("shelf").alias("shelf2"), F.col("top").alias("top2"))
    met = small.join(other, "design").where("shelf < shelf2")
    alike = F.col("top").contains(F.col("top2")) | F.col("top2").contains(F.col("top")) | F.arrays_overlap(long_words(F.col("top")), long_words(F.col("top2")))
    pairs = met.groupBy("design").agg(F.bool_or(alike).alias("alike"))

    subs = shelves.where("sub is not null").select("design", F.col("sub").alias("raw"))
    names = each.select("design", F.col("top").alias("raw")).unionByName(subs).select("design", name(F.col("raw")).alias("name"), F.trim("raw").rlike(UNFILLED).alias("form"), F.lit(1).alias("n"))
    # a name is counted before its design is, so that a large design is spread
    used = names.groupBy("design", "name").agg(F.sum("n").alias("n"), F.bool_or("form").alias("form"))
    naming = used.groupBy("design").agg(F.bool_or("form").alias("unfilled"), (F.max("n") > 1).alias("repeated"))

    none = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    out = tops.join(naming, "design", "left").join(pairs, "design", "left")
    out = out.select("design", "tops", (F.col("tops") <= most + 1).alias("sizes"), none("unfilled"), none("activity"), none("alike"), none("single"), none("repeated"))
    return out.withColumn("sane", F.expr("sizes and not (unfilled or activity or alike or single or repeated)"))


def collections(volumes: DataFrame, held: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """(volume, collection): each volume's first collection by name, then by id; those in none or in one of fewer than ``fewest`` are ``local``.

    ``volumes`` (volume), ``held`` (volume, collection, name).
    """
    first = held.groupBy("volume").agg(F.min(F.struct("name", "collection")).alias("_first")).select("volume", F.concat(F.lit("cart:"), F.col("_first.collection").cast("string")).alias("_key"))
    placed = volumes.select("volume").distinct().join(first, "volume", "left")
    large = placed.groupBy("_key").agg(F.count("*").alias("_n")).where((F.col("_n") >= fewest) & F.col("_key").isNotNull()).select("_key", F.col("_key").alias("_large"))
    return placed.join(large, "_key", "left").select("volume", F.coalesce("_large", F.lit("local")).alias("collection"))


#: What an answer says where a volume belongs on a sub-shelf that isn't there yet, and the lengths of a new one's name.
NEW, NEW_NAME = "(a new sub-shelf)", (3, 40)


def placements(answers: DataFrame, tree: DataFrame) -> DataFrame:
    """(volume, shelf, parent, how): where answers (volume, top, sub, new_name) put volumes in ``tree`` (name, parent), tops without a parent.

    A sub-shelf that is there is taken (``there``) if the answer names its top or names none that is there; a new name of a fitting
    length comes under the top named (``new``), or is that top's own sub-shelf of the name, case aside (``there``).  All else is ``unresolved``:
    a sub of another top, a top in place of a sub, a new name that is a top's or stands elsewhere.  Names in the tree are told apart by
    case for answers that choose them; of names that repeat the least parent counts.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    tops = tree.where("parent is null").select(F.col("name").alias("_top")).distinct()
    subs = tree.where("parent is not null").join(tops, F.col("name") == F.col("_top"), "left_anti").groupBy("name").agg(F.min("parent").alias("_under"))
    in_view = subs.join(tops.withColumnRenamed("_top", "_under"), "_under", "left_semi").withColumnRenamed("name", "_sub")
    lower_tops = tops.select(F.lower("_top").alias("_clash")).distinct()
    lower_subs = subs.groupBy(F.lower("name").alias("_key")).agg(F.min(F.struct("_under", "name")).alias("_held"))
    asked = answers.withColumn("_key", name(F.col("new_name")))
    met = asked.join(tops, F.col("top") == F.col("_top"), "left").join(in_view, F.col("sub") == F.col("_sub"), "left")
    met = met.join(lower_subs, "_key", "left").join(lower_tops, F.col("_key") == F.col("_clash"), "left")
    chosen = (F.col("sub") != NEW) & F.col("_sub").isNotNull() & (F.col("_top").isNull() | (F.col("_top") == F.col("_under")))
    fits = (F.col("sub") == NEW) & F.col("_top").isNotNull() & F.length("_key").between(*NEW_NAME) & F.col("_clash").isNull()
    own = fits & (F.col("_held._under") == F.col("_top"))
    fresh = fits & F.col("_held").isNull()
    how = F.when(chosen | own, "there").when(fresh, "new").otherwise("unresolved")
    shelf = F.when(chosen, F.col("_sub")).when(own, F.col("_held.name")).when(fresh, F.trim(F.regexp_replace("new_name", r"\s+", " ")))
    return met.select("volume", shelf.alias("shelf"), F.when(chosen, F.col("_under")).when(own | fresh, F.col("_top")).alias("parent"), how.alias("how"))
