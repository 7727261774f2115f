"""Word similarity by trigrams as a join: the titles that a line of text holds a stretch like.

A title's similarity with a text is the share of the trigrams of both that the
best stretch of the text reaches.  At least ``least`` of the title's own
trigrams must then be in the text, which is what the join uses: with the
trigrams of all titles in order of how many texts hold them, rarest first, a
text that holds enough of a title's trigrams holds one of the first few (all
but as many as it must hold, and one).  So only these are joined, each with the
texts that hold it; what is common among texts is never joined unless a title
has nothing rarer.  Pairs that meet are cut down by the number of trigrams they
share before a text is read.

Trigrams are those of words: letters and digits of any script in lower case,
each word with two spaces before and one after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import discard, materialise


def trigram_set(text: Column) -> Column:
    """The distinct trigrams of a text's words, as strings."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def needed(size: Column, least: float) -> Column:
    """How many of a title's trigrams a text must hold to reach ``least``; a little less, for what rounding does."""
    return F.greatest(F.ceil(size * least - 1e-6), F.lit(1)).cast("int")


def candidates(texts: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(text_id, title_id) of the pairs that share as many trigrams as ``least`` needs; texts and titles are (id, text)."""
    held = materialise(texts.select(F.col("id").alias("text_id"), trigram_set(F.col("text")).alias("grams")), "text_grams")
    wanted = materialise(titles.select(F.col("id").alias("title_id"), trigram_set(F.col("text")).alias("own")).where("size(own) > 0"), "title_grams")
    each = held.select("text_id", F.explode("grams").alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("n"))
    # only trigrams that some text holds can be met; of a title's others it is enough to know how many there are
    own = wanted.select("title_id", F.size("own").alias("size"), F.explode("own").alias("gram")).join(common, "gram", "left")
    place = F.row_number().over(Window.partitionBy("title_id").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    first = own.withColumn("place", place).where((F.col("place") <= F.col("size") - needed(F.col("size"), least) + 1) & F.col("n").isNotNull()).select("title_id", "gram")
    met = each.join(first, "gram").select("text_id", "title_id").distinct()
    shared = met.join(held, "text_id").join(wanted, "title_id").where(F.size(F.array_intersect("grams", "own")) >= needed(F.size("own"), least))
    out = materialise(shared.select("text_id", "title_id"), "candidates", narrow=True)
    discard(held, wanted)
    return out


def similar(texts: DataFrame, titles: DataFrame, least: float, similarity) -> DataFrame:
    """(text_id, title_id, similarity) of all pairs of ``least`` or more by ``similarity(title, text)``, rounded to six places."""
    pairs = candidates(texts, titles, least)
    full = pairs.join(texts.select(F.col("id").alias("text_id"), "text"), "text_id").join(titles.select(F.col("id").alias("title_id"), F.col("text").alias("title")), "title_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sims = [round(similarity(t, r), 6) for t, r in zip(batch["title"], batch["text"], strict=True)]
            yield pd.DataFrame({"text_id": batch["text_id"], "title_id": batch["title_id"], "similarity": sims})

    kinds = dict(full.dtypes)
    return full.select("text_id", "title_id", "text", "title").mapInPandas(run, f"text_id {kinds['text_id']}, title_id {kinds['title_id']}, similarity double").where(F.col("similarity") >= least)
