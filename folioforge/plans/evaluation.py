"""Evaluation queries: recall, reciprocal rank, agreement, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import evaluation
from folioforge.plans.registry import query
from folioforge.tables import table

_GOLD = """q as (select l.doc_id, l.quality, source, lang, row_number() over (partition by source order by n_chars desc, l.doc_id) as rank from labels l join documents d using (doc_id))"""


@query(f"""with {_GOLD}, g as (select source, min(rank) filter (where quality = 0) as rank from q group by source)
select count(*) as cases, round(avg(case when rank <= 1 then 1.0 else 0 end), 4) as recall_1, round(avg(case when rank <= 5 then 1.0 else 0 end), 4) as recall_5,
round(avg(case when rank <= 10 then 1.0 else 0 end), 4) as recall_10, round(avg(coalesce(1.0::double / rank, 0)), 4) as mrr from g""")
def a17_recall_mrr(spark, sf_dir):
    """Recall at k and mean reciprocal rank of the first sought row of each case."""
    ranked = evaluation.ranked(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id"), "source", [F.desc("n_chars"), F.asc("doc_id")])
    return evaluation.recall_mrr(ranked, "source", F.col("quality") == 0, (1, 5, 10))


@query(f"""with {_GOLD}, g as (select source, lang, min(rank) filter (where quality = 0) as first, count(*) filter (where quality = 0 and rank <= 10) as hits, count(*) filter (where quality = 0) as support,
count(*) filter (where quality = 1 and rank <= 5) as distractors from q group by source, lang)
select lang, count(*) as cases, round(avg(coalesce(1.0::double / first, 0)), 4) as rr, round(avg(case when support > 0 then hits::double / support end), 4) as recall_10, round(avg(distractors), 4) as distractors_5
from g group by grouping sets ((), (lang))""")
def a18_judged_scores(spark, sf_dir):
    """Scores of each case, summed up for all and by kind in one pass."""
    ranked = evaluation.ranked(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id"), "source", [F.desc("n_chars"), F.asc("doc_id")])
    return evaluation.judged(ranked, ["source", "lang"], "lang", F.col("quality") == 0, F.col("quality") == 1)


@query("""with j as (select lang, quality = 1 as a, toxic = 0 as b from labels join documents using (doc_id)),
c as (select lang, count(*) filter (where a and b) as tp, count(*) filter (where not a and b) as fp, count(*) filter (where a and not b) as fn, count(*) filter (where not a and not b) as tn from j group by grouping sets ((), (lang))),
k as (select *, (tp + fp + fn + tn)::double as n from c), m as (select *, (tp + tn) / n as po, ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n) as pe from k)
select lang, tp, fp, fn, tn, round(po, 3) as accuracy, round(case when pe < 1 then (po - pe) / (1 - pe) end, 3) as kappa, round(tp / nullif((tp + fp)::double, 0), 3) as "precision", round(tp / nullif((tp + fn)::double, 0), 3) as recall from m""")
def a20_agreement(spark, sf_dir):
    """Agreement of two raters, for all and by kind."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return evaluation.agreement(rows, "a", "b", "lang")


@query("""select event_type, round(quantile_cont(value, 0.5), 2) as p50, round(quantile_cont(value, 0.95), 2) as p95, round(avg(value), 4) as mean from events group by 1""")
def a21_percentiles(spark, sf_dir):
    """Interpolated percentiles and mean."""
    return evaluation.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("""select doc_id, case when substr(sha256(doc_id::varchar), 64, 1) in ('1','3','5','7','9','b','d','f') then 'held' else 'open' end as side from documents""")
def a20_split_sides(spark, sf_dir):
    """§2.8: a stable split by a hash's parity."""
    last = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 64, 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(last.isin(*"13579bdf"), "held").otherwise("open").alias("side"))


@query("""with m as (select conv_id, turn, regexp_extract_all(text || ' [1] and [' || (turn + 1) || ', 9] [3]', '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1) as g from conversations), n as (select conv_id, turn, unnest(g) as g from m),
c as (select conv_id, turn, unnest(string_split_regex(g, '\\s*,\\s*'))::int as n from n) select conv_id, turn, round(count(*) filter (where n between 1 and 3)::double / count(*), 4) as validity from c group by all""")
def t26_citation_validity(spark, sf_dir):
    """Share of cited numbers that resolve; citations are put in by turn, as the tables hold none."""
    text = F.concat("text", F.lit(" [1] and ["), (F.col("turn") + 1).cast("string"), F.lit(", 9] [3]"))
    return evaluation.citation_validity(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"], 3)
