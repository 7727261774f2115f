"""Retrieval queries: vector and lexical ranking, fusion, routing, literal and rare words, ordering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions.vectors import cosine
from folioforge.operators import postings, ranking, references, relational, vector_index
from folioforge.plans.registry import query
from folioforge.session import shared_dir
from folioforge.tables import table

POOL = 100
TERMS = ["thand", "ering", "tion", "and"]
#: The vector that stands for an embedded question: no embedder is at hand.
PROBE = 7

_COS = "list_cosine_similarity(e.embedding::double[], (select embedding::double[] from embeddings where vec_id = 7))"
_DENSE = f"select e.vec_id as id, {_COS} as sim, row_number() over (order by {_COS} desc nulls last, e.vec_id) as rk from embeddings e"
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_TERMS_SQL = "['thand', 'ering', 'tion', 'and']"
_LEX = f"""select doc_id as id, hits, row_number() over (order by hits desc, doc_id) as rk from (
    select doc_id, len(list_filter({_TOK}, lambda w: list_contains({_TERMS_SQL}, w))) as hits from documents) where hits > 0"""


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The question's vector; one row by its id."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").head()
    return [float(x) for x in row[0]]


def dense(spark: SparkSession, sf_dir: str, pool: int = POOL) -> DataFrame:
    """(id, sim, rk): the nearest vectors by cosine."""
    point = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    scored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), cosine(F.col("embedding"), point).alias("sim"))
    return ranking.top_ranked(scored, [F.desc_nulls_last("sim"), F.asc("id")], pool)


def lexical(spark: SparkSession, sf_dir: str, terms: list[str] = TERMS, pool: int = POOL) -> DataFrame:
    """(id, hits, rk): documents by the number of tokens that match a term, from stored postings."""
    index = postings.index_of(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    found = postings.search(index, terms, pool).select("id", F.col("hits").cast("int").alias("hits"))
    return ranking.top_ranked(found, [F.desc("hits"), F.asc("id")], pool)


@query(f"select id, round(sim, 6) as similarity, rk::int as rk from ({_DENSE}) where rk <= 100")
def w1_dense_topk(spark, sf_dir):
    """Exact nearest vectors by cosine, a top-k."""
    return dense(spark, sf_dir).select("id", F.round("sim", 6).alias("similarity"), "rk")


def _index(spark: SparkSession, sf_dir: str) -> vector_index.Index:
    """An index over all vectors in a folder of its own."""
    return vector_index.build(table(spark, sf_dir, "embeddings"), f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}")


@query("""with p as (select a.vec_id as query_id, b.vec_id as vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as rk from p) select query_id, vec_id, round(sim, 6) as similarity, rk::int as rk from r where rk <= 3""")
def v1_index_search(spark, sf_dir):
    """W1, J7 through an inverted file: the three nearest others of every twentieth vector; cells that can't hold any are left out, no other."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    found = vector_index.search(_index(spark, sf_dir), queries, 3, probes=8)
    return found.select("query_id", "vec_id", F.round("sim", 6).alias("similarity"), "rk")


@query()
def v2_index_recall(spark, sf_dir):
    """What probing ever more cells finds of the ten nearest of every twentieth vector, until nine tenths are found."""
    index = _index(spark, sf_dir)
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    found = vector_index.curve(index, queries, 10)
    best = vector_index.probes_for(index, queries, 10, 0.9, known=found)
    return vector_index.recall(index, queries, 10, sorted({max(1, best // 4), max(1, best // 2), best}), known=found)


@query(f"select id, hits::int as hits, rk::int as rk from ({_LEX}) where rk <= 100")
def w2_lexical_or_rank(spark, sf_dir):
    """OR search ranked by matched positions."""
    return lexical(spark, sf_dir).select("id", "hits", "rk")


@query(f"""with d as (select id, rk from ({_DENSE}) where rk <= 100), x as (select id, rk from ({_LEX}) where rk <= 100)
select id, d.rk::int as dense_rank, x.rk::int as lexical_rank, round(coalesce(1.0::double / (60 + d.rk), 0) + coalesce(0.2::double / (60 + x.rk), 0), 9) as score
from d full join x using (id) order by score desc, id limit 10""")
def hybrid_rrf(spark, sf_dir):
    """Dense and lexical lists fused by weighted reciprocal rank."""
    fused = ranking.fuse(dense(spark, sf_dir), lexical(spark, sf_dir), "id")
    return fused.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(10)


@query("""with v as (select vec_id, label, embedding from embeddings where vec_id % 2 = 0 union all select vec_id, label, embedding from embeddings where vec_id % 2 = 1),
p as (select embedding::double[] as q from embeddings where vec_id = 7)
select label, round(min(1 - list_cosine_similarity(embedding::double[], q)), 6) as distance from v, p group by label""")
def a1_best_vector_per_owner(spark, sf_dir):
    """Least distance of each owner over the union of its kinds of vectors."""
    point = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    rows = table(spark, sf_dir, "embeddings")
    both = rows.where("vec_id % 2 = 0").unionByName(rows.where("vec_id % 2 = 1"))
    return both.groupBy("label").agg(F.round(F.min(1 - cosine(F.col("embedding"), point)), 6).alias("distance"))


@query("""with p as (select embedding::double[] as q from embeddings where vec_id = 7),
s as (select vec_id, label, list_cosine_similarity(embedding::double[], q) as sim from embeddings, p),
l as (select label, max(sim) as best from s group by label),
top as (select label from l order by best desc, label limit 3),
routed as (select vec_id, row_number() over (order by sim desc, vec_id) as rk from s where label in (select label from top)),
every as (select vec_id, row_number() over (order by sim desc, vec_id) as rk from s),
u as (select vec_id, 0 as stage, rk from routed where rk <= 40 union all select vec_id, 1, rk from every where rk <= 10),
f as (select vec_id, min((stage, rk)) as place from u group by vec_id)
select vec_id, row_number() over (order by place, vec_id)::int as pos from f""")
def w4_route_then_search(spark, sf_dir):
    """Owners routed by their best vector, searched inside, with a share of the pool for the rest."""
    point = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    scored = table(spark, sf_dir, "embeddings").select("vec_id", "label", cosine(F.col("embedding"), point).alias("sim"))
    owners = scored.groupBy("label").agg(F.max("sim").alias("best")).orderBy(F.desc("best"), "label").limit(3)
    order = [F.desc("sim"), F.asc("vec_id")]
    routed = ranking.top_ranked(relational.in_scope(scored, "label", [owners]), order, 50)
    return ranking.routed_union(routed, ranking.top_ranked(scored, order, 50), "vec_id", 50).select("vec_id", "pos")


@query("""with h as (select doc_id, source, row_number() over (order by length(text), doc_id) as pos from documents order by pos limit 200),
n as (select *, row_number() over (partition by source order by pos) > 3 as held from h)
select doc_id, source, pos::int as pos from n order by held, pos limit 40""")
def w7_diversify_per_source(spark, sf_dir):
    """Three hits a source in rank order, then those held back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    hits = ranking.top_ranked(docs, [F.asc("n"), F.asc("doc_id")], 200, "pos")
    return ranking.diversify(hits, "source", 3, 40).select("doc_id", "source", "pos")


@query("""select doc_id, length(text)::int as n from documents where contains(lower(text), 'the') and contains(lower(text), 'license') order by n, doc_id limit 50""")
def p4_literal_search(spark, sf_dir):
    """Documents that hold every term, shortest first."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(tx.contains_all(F.col("text"), ["the", "license"])).select("doc_id", F.length("text").alias("n")).orderBy("n", "doc_id").limit(50)


@query(f"""with r as (select id as doc_id, rk from ({_LEX}) where rk <= 60),
x as (select doc_id, row_number() over (order by length(text), doc_id) as rk from documents where contains(lower(text), 'thand') order by rk limit 30)
select doc_id, (case when r.rk is not null and x.rk is not null then 0 when x.rk is not null then 1 else 2 end)::int as bucket,
  (case when r.rk is not null then r.rk else x.rk end)::int as pos from r full join x using (doc_id) order by bucket, pos, doc_id limit 40""")
def w8_exact_first(spark, sf_dir):
    """Literal hits before ranked ones."""
    found = table(spark, sf_dir, "documents").where(tx.contains_all(F.col("text"), ["thand"])).select("doc_id", F.length("text").alias("n"))
    literal = ranking.top_ranked(found, [F.asc("n"), F.asc("doc_id")], 30)
    return ranking.exact_first(lexical(spark, sf_dir, pool=60).withColumnRenamed("id", "doc_id"), literal, "doc_id", 40)


@query(f"""with o as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from documents), p as (select doc_id, lower(w) as term, max(regexp_matches(w, '^[A-Z]'))::int as named from o where length(w) >= 10 group by all),
r as (select *, count(*) over (partition by term) as df, row_number() over (partition by term order by doc_id) as n from p), t as (select count(*) as total from documents)
select term, max(df)::bigint as df, round(avg(named), 6) as named from r, t where n <= 30 and df <= greatest(20, 0.002 * total) group by term having avg(named) >= 0.6""")
def p9_rare_terms(spark, sf_dir):
    """Words of ten letters or more, held by few documents (20, or 0.2 percent) and written as a name in most of them, by the first 30."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w")).where(F.length("w") >= 10)
    held = words.groupBy("doc_id", F.lower("w").alias("term")).agg(F.max(F.col("w").rlike("^[A-Z]").cast("int")).alias("named"))
    return ranking.rare_names(held, docs.agg(F.count("*").alias("total")), "doc_id").withColumn("named", F.round("named", 6))


@query(f"""with p as (select doc_id, length(text) as n, unnest(list_distinct({_TOK})) as term from documents),
r as (select term, doc_id, row_number() over (partition by term order by n, doc_id) as rk from p where term in ('thand', 'inthe', 'license', 'ering'))
select term, doc_id, rk::int as rk from r where rk <= 4""")
def p10_rare_hits(spark, sf_dir):
    """P10: each looked-up word's four shortest documents."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    hits = words.where(F.col("term").isin("thand", "inthe", "license", "ering"))
    return ranking.top_per_group(hits, ["term"], [F.asc("n"), F.asc("doc_id")], 4).select("term", "doc_id", "rk")


@query(f"""with r as (select id as doc_id, rk from ({_LEX}) where rk <= 30),
e as (select doc_id, row_number() over (order by length(text) desc, doc_id) as rk from documents order by rk limit 5),
u as (select doc_id, case when rk <= 3 then 0 else 2 end as part, rk from r union all select doc_id, 1, rk from e),
f as (select doc_id, min((part, rk)) as place from u group by doc_id)
select doc_id, row_number() over (order by place, doc_id)::int as pos from f""")
def w5_rare_splice(spark, sf_dir):
    """Extra hits spliced in after the third place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    extra = ranking.top_ranked(docs, [F.desc("n"), F.asc("doc_id")], 5)
    return ranking.splice(lexical(spark, sf_dir, pool=30).withColumnRenamed("id", "doc_id"), extra, "doc_id")


@query(f"""with r as (select id as doc_id, hits, rk from ({_LEX}) where rk <= 50)
select r.doc_id, rk::int as pos, row_number() over (order by case when rk <= 20 then 0 else 1 end, case when rk <= 20 then n_chars end desc, rk)::int as new_pos
from r join documents d on d.doc_id = r.doc_id""")
def w6_rerank_head(spark, sf_dir):
    """The head ordered by a second scorer (here the length), the tail as it was."""
    hits = lexical(spark, sf_dir, pool=50).select(F.col("id").alias("doc_id"), F.col("rk").alias("pos"))
    scored = hits.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return ranking.rerank_head(scored, F.col("n_chars"), 20).select("doc_id", "pos", "new_pos")


@query("""with n as (select doc_id, source, row_number() over (partition by source order by doc_id) as turn from documents)
select doc_id, source, turn::int as turn from n order by turn, doc_id limit 60""")
def w12_round_robin(spark, sf_dir):
    """One document a source in turn."""
    turns = ranking.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.asc("doc_id")])
    return turns.orderBy("turn", "doc_id").limit(60)


@query("""with t as (select doc_id, row_number() over (order by doc_id) as n, count(*) over () as total from documents)
select doc_id from t where (n - 1) % greatest(1, total // 300) = 0 order by doc_id limit 300""")
def w19_systematic_sample(spark, sf_dir):
    """Every step-th row by id, 300 at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    step = F.greatest(F.lit(1), F.floor(F.col("total") / 300))
    numbered = ranking.numbered(docs, "doc_id").join(docs.agg(F.count("*").alias("total")), F.lit(True))  # one row
    return numbered.where((F.col("n") - 1) % step == 0).select("doc_id").orderBy("doc_id").limit(300)


@query("""with q as (select * from (values (0, ['thand']), (1, ['ering', 'tion'])) t(q, terms)),
h as (select q, doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: list_contains(terms, w)))::int as hits from documents, q),
b as (select doc_id, max(hits) as score from h where hits > 0 group by doc_id)
select doc_id, score from b order by score desc, doc_id limit 25""")
def w16_multi_query_union(spark, sf_dir):
    """Several searches, a document's best score, best first."""
    docs = table(spark, sf_dir, "documents")
    words = tx.tokens(F.col("text"))
    hits = lambda terms: docs.select("doc_id", F.size(F.filter(words, lambda w: w.isin(terms))).alias("hits"))
    parts = [hits(["thand"]), hits(["ering", "tion"])]
    found = parts[0].unionByName(parts[1]).where("hits > 0")
    return found.groupBy("doc_id").agg(F.max("hits").alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("""with ids as (select unnest([42, 7, 99999999, 13]) as doc_id, unnest([0, 1, 2, 3]) as i)
select d.doc_id, round(10 - 0.001::double * i, 6) as score from ids join documents d using (doc_id)""")
def w17_held_passages(spark, sf_dir):
    """Passages held by id in the order asked; unknown ids are skipped."""
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (42, 7, 99999999, 13)))).alias("i", "doc_id"))
    return table(spark, sf_dir, "documents").join(F.broadcast(ids), "doc_id").select("doc_id", F.round(10 - F.col("i") * 0.001, 6).alias("score"))


@query("""with q as (select * from (values ('Nation report on region five'), ('part of the SUPPLIER list'), ('nothing here'), ('a shelf on Middle East') ) t(question)),
n as (select question, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) as norm from q),
t as (select distinct trim(regexp_replace(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g'), '^(the|a|an) ', '')) as title from region union select 'supplier list')
select question, title from n join t on contains(norm, title) and length(title) >= 10""")
def p13_named_volumes(spark, sf_dir):
    """Titles that a question names."""
    asked = spark.createDataFrame([("Nation report on region five",), ("part of the SUPPLIER list",), ("nothing here",), ("a shelf on Middle East",)], "question string")
    clean = F.regexp_replace(tx.plain_words(F.col("r_name")), "^(the|a|an) ", "")
    titles = table(spark, sf_dir, "region").select(F.trim(clean).alias("title")).union(spark.createDataFrame([("supplier list",)], "title string")).distinct()
    found = references.named_titles(asked.withColumn("question_id", F.col("question")), titles.withColumn("title_id", F.col("title")))
    return found.select(F.col("question_id").alias("question"), F.col("title_id").alias("title"))
