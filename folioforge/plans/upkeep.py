"""Queries of sentence lifts, threads in scope, imports, upgrades, shelves and parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.functions import params
from folioforge.functions import text as tx
from folioforge.functions.vectors import cosine
from folioforge.operators import digests, lifecycle, relational, store, vectors
from folioforge.plans.registry import query
from folioforge.plans.retrieval import probe
from folioforge.session import shared_dir
from folioforge.sources import records
from folioforge.tables import table

_SIM = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7))"


@query(f"""with s as (select label, vec_id, round({_SIM}, 9) as sim from embeddings), r as (select *, row_number() over (partition by label order by sim desc, vec_id) as n from s where not isnan(sim))
select label, vec_id, round(sim, 6) as sim, case when vec_id % 3 = 0 then 'words' else 'meaning' end as kind from r where n = 1""")
def t21_cosine_lift(spark, sf_dir):
    """Of each owner's sentences (vectors) the nearest to the question, and whether it holds a word of it (ids divisible by 3, here) or only its meaning."""
    point = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    best = vectors.lifted(table(spark, sf_dir, "embeddings"), "label", "embedding", point, "vec_id")
    return best.select("label", "vec_id", F.round("sim", 6).alias("sim"), F.when(F.col("vec_id") % 3 == 0, "words").otherwise("meaning").alias("kind"))


@query(r"""with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents),
s as (select doc_id, list_transform(string_split(regexp_replace(flat, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)) as parts from f),
k as (select doc_id, list_transform(list_filter(parts, lambda x: length(x) >= 25), lambda x: substr(x, 1, 400))[1:12] as sents from s),
h as (select doc_id, list_filter(sents, lambda x: contains(lower(x), 'the') and contains(lower(x), 'ering'))[1] as every, list_filter(sents, lambda x: contains(lower(x), 'the') or contains(lower(x), 'ering'))[1] as one from k)
select doc_id, coalesce(every, one) as sentence, case when every is not null then 'all' when one is not null then 'any' end as holds from h""")
def t21_holding_sentence(spark, sf_dir):
    """A text's first sentence that holds all the terms, else one of them."""
    terms = ["the", "ering"]
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    first = lambda test: F.get(F.filter("s", test), F.lit(0))
    has = lambda x, t: F.lower(x).contains(t)
    found = rows.select("doc_id", first(lambda x: has(x, terms[0]) & has(x, terms[1])).alias("every"), first(lambda x: has(x, terms[0]) | has(x, terms[1])).alias("one"))
    return found.select("doc_id", F.coalesce("every", "one").alias("sentence"), F.when(F.col("every").isNotNull(), "all").when(F.col("one").isNotNull(), "any").alias("holds"))


@query(f"""with t as (select label, round(max({_SIM}), 9) as score from embeddings group by label), best as (select * from t order by score desc, label limit 15),
c as (select label, count(*) as n, count(*) filter (where vec_id % 40 = 3) as n_in_scope from embeddings where label % 4 <> 1 group by label)
select label, round(score, 6) as score, coalesce(n_in_scope, 0) as n_in_scope, case when n is null then 'no rows' else 'claims' end as state from best left join c using (label) where n is null or n_in_scope > 0 order by score desc, label limit 5""")
def w11_scoped_threads(spark, sf_dir):
    """The five best threads (labels) with claims in scope, or with no claims at all; three times as many are looked at."""
    point = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    rows = table(spark, sf_dir, "embeddings")
    threads = rows.groupBy("label").agg(F.round(F.max(cosine(F.col("embedding"), point)), 9).alias("score"))
    found = lifecycle.scoped_threads(threads, rows.where("label % 4 <> 1").select("label", "vec_id"), 5, "label", rows.where("vec_id % 40 = 3"), "vec_id")
    return found.withColumn("score", F.round("score", 6))


_PARTS = "select source as part, count(*) as n, md5(string_agg(line, chr(10) order by line)) as digest from (select source, doc_id || chr(9) || md5(text) as line from {}) group by source"


@query(f"""with m as ({_PARTS.format("documents where source <> 'src3'")}), p as ({_PARTS.format("(select doc_id, source, case when doc_id = 5 then text || '.' else text end as text from documents where source <> 'src4')")})
select coalesce(m.part, p.part) as part, case when p.part is null then 'missing' when m.part is null then 'unlisted' when m.n = p.n and m.digest = p.digest then 'whole' else 'damaged' end as state from m full join p on m.part = p.part""")
def s14_verified_import(spark, sf_dir):
    """An import's parts against its manifest; here one part isn't listed, one is missing, and a text of one was changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")

    def parts(rows):
        line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.md5("text"))
        return rows.groupBy(F.col("source").alias("part")).agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("digest"))

    changed = F.when(F.col("doc_id") == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return lifecycle.verified(parts(docs.where("source <> 'src3'")), parts(docs.where("source <> 'src4'").withColumn("text", changed)))


@query("""with m as (select l_suppkey as coll, l_orderkey as doc, bool_or(l_linenumber <= 2) as introduced from lineitem group by all), mine as (select * from m where coll = 3)
select doc, case when doc % 2 = 0 then 'stays' when introduced and not exists (select 1 from m o where o.doc = mine.doc and o.coll <> 3) then 'deleted' else 'leaves' end as action from mine""")
def m18a_upgrade(spark, sf_dir):
    """A collection's documents under its new version (the even ones are in it)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("coll"), F.col("l_orderkey").alias("doc")).agg(F.max(F.col("l_linenumber") <= 2).alias("introduced"))
    return lifecycle.upgraded(rows, "doc", "coll", 3, rows.where("doc % 2 = 0"))


@query("""with loc as (select sha256(text) as h, min(doc_id) as local_id from documents where doc_id % 2 = 0 group by 1), inc as (select doc_id, sha256(text) as h from documents where doc_id % 2 <> 0),
ids as (select doc_id, coalesce(local_id, 1000000 + doc_id) as new_doc from inc left join loc using (h)),
v as (select vec_id, label, case when vec_id % 5 = 0 then 'other' else 'm1' end as model, len(embedding) as dims from embeddings)
select vec_id, new_doc, case when model = 'm1' and dims = (select max(len(embedding)) from embeddings) then 'shipped' else 'queued' end as vector from v join ids on ids.doc_id = v.vec_id""")
def m18c_remap(spark, sf_dir):
    """Sections of imported documents under local ids; a shipped vector is used where model and dimension are the local ones, else it is queued."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    local = docs.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("local_id"))
    ids = docs.where("doc_id % 2 <> 0").join(local, "h", "left").select("doc_id", F.coalesce("local_id", 1_000_000 + F.col("doc_id")).alias("new_doc"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, "other").otherwise("m1").alias("model"), F.size("embedding").alias("dims"))
    held = rows.join(table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("own")), F.lit(True))  # one row
    vector = F.when((F.col("model") == "m1") & (F.col("dims") == F.col("own")), "shipped").otherwise("queued")
    return held.join(ids, F.col("vec_id") == F.col("doc_id")).select("vec_id", "new_doc", vector.alias("vector"))


@query("""with s as (select n_nationkey as shelf, n_regionkey as parent, count(c_custkey) as n from nation join customer on c_nationkey = n_nationkey group by all),
r as (select *, row_number() over (partition by parent order by n desc, shelf) as place, avg(n) over () as mean from s)
select a.shelf, case when a.n > (select max(n) * 0.95 from s) then 'split' else 'merge' end as action, case when a.n > (select max(n) * 0.95 from s) then null else b.shelf end as into
from r a join r b on b.parent = a.parent and b.place = case when a.place = 1 then 2 else 1 end where a.n > (select max(n) * 0.95 from s) or a.n < (select min(n) * 1.1 from s)""")
def m12_shelf_moves(spark, sf_dir):
    """The fullest shelves split, the emptiest merged into the largest other one under their parent; the bounds follow the table here."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shelf"), F.col("n_regionkey").alias("parent"))
    customer = table(spark, sf_dir, "customer")
    shelves = nation.join(customer, F.col("c_nationkey") == F.col("shelf")).groupBy("shelf", "parent").agg(F.count("c_custkey").alias("n"))
    ends = shelves.agg((F.max("n") * 0.95).alias("most"), (F.min("n") * 1.1).alias("fewest")).first()  # one row
    return lifecycle.shelf_moves(shelves, "shelf", "parent", ends[0], ends[1])


@query(r"""with v as (select event_id, nullif(trim(case event_id % 6 when 0 then user_id::varchar when 1 then ' 12 ' when 2 then 'red' when 3 then '' when 4 then '-3' else 'x9' end), '') as t from events),
e as (select event_id, t, coalesce(t, 'red') as c, case when t is null then 'missing' when try_cast(t as integer) is null then 'not a integer' when t::integer < 0 then 'too small' when t::integer > 20 then 'too large' end as number_error,
case when coalesce(t, 'red') not in ('red', 'blue') then 'not a choice' end as colour_error, case when not regexp_matches(t, '^(?:[a-z][0-9])$') then 'wrong form' end as code_error from v)
select event_id, case when number_error is null then t end as number, number_error, case when colour_error is null then c end as colour, colour_error, case when code_error is null then t end as code, code_error from e""")
def p28_parameters(spark, sf_dir):
    """§2.8 parameter check: values as text against type, bounds, choices and pattern; a sixth are users' numbers, the others are put in by id, as the tables hold none."""
    kinds = F.array(F.col("user_id").cast("string"), *map(F.lit, (" 12 ", "red", "", "-3", "x9")))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("raw"))
    number = params.checked(F.col("raw"), "integer", least=0, most=20, required=True)
    colour = params.checked(F.col("raw"), "string", choices=["red", "blue"], default="red")
    code = params.checked(F.col("raw"), "string", pattern="[a-z][0-9]")
    out = rows.select("event_id", number.alias("n"), colour.alias("c"), code.alias("k"))
    return out.select("event_id", *(F.col(f"{x}.{f}").alias(name + ("_error" if f == "error" else "")) for x, name in (("n", "number"), ("c", "colour"), ("k", "code")) for f in ("value", "error")))


@query("""with x as (select event_id, unnest([event_type, 'second']) as title, unnest([0, 1]) as i from events) select event_id, title from x""")
def s17_xml_rows(spark, sf_dir):
    """Records of an XML document by their tag; the documents are made from the rows, as the tables hold none."""
    body = F.concat(F.lit("<feed><item><title>"), "event_type", F.lit("</title></item><item><title>second</title></item></feed>"))
    return records.xml_rows(table(spark, sf_dir, "events").select("event_id", body.alias("x")), "x", "item", ["title"]).select("event_id", "title")


@query("""select event_id, unnest([user_id::varchar, 'a,b']) as host, unnest([event_type, 'quoted']) as os from events""")
def s17_csv_rows(spark, sf_dir):
    """Records of a CSV text below its header, quoted fields among them."""
    body = F.concat(F.lit("host,os\n"), F.col("user_id").cast("string"), F.lit(","), "event_type", F.lit('\n"a,b",quoted\n'))
    return records.csv_rows(table(spark, sf_dir, "events").select("event_id", body.alias("c")), "c", ["host", "os"]).select("event_id", "host", "os")


@query("""with m as (select distinct l_orderkey as doc, l_returnflag as tag, case when l_linenumber = 1 then 'shelf' else 'reader' end as origin from lineitem), h as (select distinct doc, tag from m where origin = 'shelf')
select doc, tag, 'shelf' as origin from h union all select distinct doc, 'N', 'reader' from m where not exists (select 1 from h where h.doc = m.doc and h.tag = 'N')""")
def m11_assign_tags(spark, sf_dir):
    """A document's tags replaced by new ones (N, here), its shelf tag preserved."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("tag"), F.when(F.col("l_linenumber") == 1, "shelf").otherwise("reader").alias("origin")).distinct()
    fresh = rows.select("doc").distinct().select("doc", F.lit("N").alias("tag"))
    return relational.assign_tags(rows, fresh, "doc", "tag")


_LINES = "select coalesce(source, '') as part, doc_id::varchar as key, doc_id || chr(9) || {} as line from {}"
_NODE = "select part, {level}::int as level, node, n::bigint as n, digest from {table}"


@query(f"""with l as ({_LINES.format("sha256(text)", "documents")}), c as (select part, left(md5(line), 2) as node, line, count(*) as k from l group by all),
n2 as (select part, node, sum(k) as n, sha256(string_agg(line || chr(9) || k, chr(10) order by line || chr(9) || k)) as digest from c group by all),
n1 as (select part, left(node, 1) as node, sum(n) as n, sha256(string_agg(n2.node || chr(9) || digest, chr(10) order by n2.node || chr(9) || digest)) as digest from n2 group by part, left(node, 1)),
n0 as (select part, '' as node, sum(n) as n, sha256(string_agg(n1.node || chr(9) || digest, chr(10) order by n1.node || chr(9) || digest)) as digest from n1 group by part)
{" union all ".join(_NODE.format(level=i, table=f"n{i}") for i in range(3))}""")
def s13_digest_tree(spark, sf_dir):
    """An export's manifest as a digest tree by source: every node of three levels."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return digests.tree(rows, 8, part="source", key="doc_id", digest="h").select("part", "level", "node", "n", "digest")


@query(f"""with a as ({_LINES.format("sha256(text)", "documents where source <> 'src3'")}), b as ({_LINES.format("sha256(case when doc_id % 97 = 5 then text || '.' else text end)", "documents where source <> 'src4'")}),
m as (select part, key, string_agg(line, ';' order by line) as x from a group by all), o as (select part, key, string_agg(line, ';' order by line) as x from b group by all)
select coalesce(m.part, o.part) as part, coalesce(m.key, o.key) as key, case when o.x is null then 'missing' when m.x is null then 'added' else 'changed' end as state
from m full join o on m.part = o.part and m.key = o.key where m.x is distinct from o.x""")
def s14_changed_rows(spark, sf_dir):
    """The rows of an import that differ from what was sent, found by descent of two digest trees; here a source is missing, one isn't listed, and some texts were changed."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    changed = F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    sent, came = (df.select("source", "doc_id", F.sha2("text", 256).alias("h")) for df in (rows.where("source <> 'src3'"), rows.where("source <> 'src4'").withColumn("text", changed)))
    return digests.changed_rows(sent, came, 8, part="source", key="doc_id", digest="h")


@query("""with d as (select sha256(text) as h, length(text) as n from documents where text is not null), f as (select distinct h from d where h < '8')
select h as hash, max(n)::bigint as n_chars, h in (select h from f) as first_run from d group by h""")
def s12_write_once(spark, sf_dir):
    """A store of texts' lengths by content, filled in two runs, the second of which writes what the first hasn't; what each run wrote."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), F.length("text").cast("bigint").alias("n_chars"))
    held = store.Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", "hash string, n_chars bigint")
    held.append(texts.where("hash < '8'"))
    held.append(texts)
    first = held.read(1).select("hash", F.lit(True).alias("first_run"))
    return held.read().join(first, "hash", "left").select("hash", "n_chars", F.coalesce("first_run", F.lit(False)).alias("first_run"))
