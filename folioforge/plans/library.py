"""Library queries: graphs, anchors, near duplicates, clusters, upkeep of derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.operators import claims, closures, density, lifecycle, relational, vectors
from folioforge.plans.registry import query
from folioforge.session import shared_dir
from folioforge.tables import table

_SIM = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"""with p as (select a.vec_id as a, b.vec_id as b, {_SIM} as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select a, b, sim, row_number() over (partition by a order by round(sim, 9) desc, b) as rk from p where sim > 0.2)
select a, b, round(sim, 6) as similarity, rk::int as rk from r where rk <= 3""")
def j7_knn_graph(spark, sf_dir):
    """Every vector's three nearest others above a threshold (0.2 here: these vectors are nearly orthogonal)."""
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.nearest(rows, rows, 3, 0.2)
    return found.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.round("sim", 6).alias("similarity"), "rk")


@query(f"""with p as (select a.vec_id as a, b.vec_id as b, {_SIM} as sim from embeddings a join embeddings b on b.vec_id < a.vec_id),
r as (select a, b, sim, row_number() over (partition by a order by round(sim, 9) desc, b) as rk from p where sim > 0.35) select a as vec_id, b as duplicate_of, round(sim, 6) as similarity from r where rk = 1""")
def t18_near_duplicates(spark, sf_dir):
    """Each vector's nearest earlier one above a threshold (0.35 here, 0.93 by default elsewhere)."""
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.nearest(rows, rows, 1, 0.35, earlier=True)
    return found.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("duplicate_of"), F.round("sim", 6).alias("similarity"))


@query(f"""with c as (select vec_id, label, embedding from embeddings where vec_id % 5 = 0), p as (select vec_id, label, embedding from embeddings where vec_id % 5 <> 0),
s as (select a.vec_id as claim, b.vec_id as passage, {_SIM} as sim from c a join p b on a.label = b.label),
r as (select *, row_number() over (partition by claim order by round(sim, 9) desc, passage) as n from s)
select claim, passage, round(sim, 6) as similarity, case when sim >= 0.25 then 'anchored' when sim >= 0.15 then 'weak' else 'unsupported' end as state from r where n = 1""")
def j12_anchors(spark, sf_dir):
    """Each claim's nearest passage of its own section, and how well it holds; sections are multiplied in blocks."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label").where("label is not null and v is not null")
    scored = vectors.nearest_within(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), "label", 1).select(F.col("query_id").alias("claim"), F.col("id").alias("passage"), "sim")
    best = relational.first_per_key(scored, ["claim"], [F.desc(F.round("sim", 9)), F.asc("passage")])
    state = F.when(F.col("sim") >= 0.25, "anchored").when(F.col("sim") >= 0.15, "weak").otherwise("unsupported")
    return best.select("claim", "passage", F.round("sim", 6).alias("similarity"), state.alias("state"))


@query("""with m as (select vec_id, label, chr(65 + (vec_id % 3)::int) as src from embeddings),
n as (select *, row_number() over (partition by label, src order by vec_id) as turn, min(vec_id) over (partition by label, src) as seen from m),
k as (select label, vec_id, src, row_number() over (partition by label order by turn, seen) as pos from n), s as (select label from m group by label having count(distinct src) >= 2)
select label, vec_id, src, pos::int as pos from k where pos <= 8 and label in (select label from s)""")
def w12_scoped_threads(spark, sf_dir):
    """Threads with two sources in scope, one claim a source in turn, eight at most."""
    source = F.chr(F.lit(65) + F.col("vec_id") % 3)
    claims = table(spark, sf_dir, "embeddings").select("vec_id", "label", source.alias("src"))
    return lifecycle.thread_claims(claims, "label", "src", "vec_id", 8)


@query("""select label, sha256(string_agg(vec_id::varchar || chr(9) || (vec_id % 7)::varchar, chr(10) order by vec_id::varchar || chr(9) || (vec_id % 7)::varchar)) as member_key, count(*) as n from embeddings group by label""")
def m4_member_key(spark, sf_dir):
    """M4, M6: a cluster's key from its members in order."""
    line = F.concat_ws("\t", F.col("vec_id").cast("string"), (F.col("vec_id") % 7).cast("string"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("member_key"), F.count("*").alias("n"))


@query(f"""with l as (select label, sha256(vec_id || chr(9) || (vec_id % 7)) as h from embeddings where label is not null)
select label, sha256(count(*) || '.' || {" || '.' || ".join(f"sum(('0x' || substr(h, {1 + i * claims.DIGITS}, {claims.DIGITS}))::bigint)" for i in range(claims.LIMBS))}) as member_key, count(*) as n from l group by label""")
def m4_set_key(spark, sf_dir):
    """M4, M6: a cluster's key from its members in any order, added up by every task, so that no row holds a cluster's members."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null")
    return rows.groupBy("label").agg(claims.set_key(F.col("vec_id"), (F.col("vec_id") % 7).cast("string")).alias("member_key"), F.count("*").alias("n"))


@query("""with old as (select c_custkey as id, c_nationkey as key, case when c_custkey % 11 = 0 then null else 'm1' end as model from customer where c_custkey % 7 <> 0),
new as (select c_custkey as id, case when c_custkey % 5 = 0 then c_nationkey + 1 else c_nationkey end as key from customer where c_custkey % 13 <> 0)
select coalesce(old.id, new.id) as id, case when new.id is null then 'dead' when old.id is null then 'fresh' when old.key is distinct from new.key or old.model is distinct from 'm1' then 'redo' else 'keep' end as state from old full join new using (id)""")
def m2_staleness(spark, sf_dir):
    """M2, M3, M4, M7: what an incremental rebuild keeps, redoes, adds and drops."""
    customer = table(spark, sf_dir, "customer")
    old = customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"), F.when(F.col("c_custkey") % 11 != 0, "m1").alias("model"))
    shifted = F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    new = customer.where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("id"), shifted.alias("key"))
    return lifecycle.rebuild_plan(old, new, "id", "key", F.col("model"), "m1")


@query("""with base as (select o_orderkey, o_custkey, o_orderstatus from orders), ch as (select case when o_orderkey % 3 = 0 then -1 - o_orderkey else o_orderkey end as o_orderkey, o_custkey, 'X' as o_orderstatus from orders where o_orderkey % 5 = 0)
select * from base where o_orderkey not in (select o_orderkey from ch) union all select * from ch""")
def m1_upsert(spark, sf_dir):
    """Rows replaced by key; a fifth of all orders changes, and a third of these comes under new keys."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key = F.when(F.col("o_orderkey") % 3 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    changes = rows.where("o_orderkey % 5 = 0").select(key.alias("o_orderkey"), "o_custkey", F.lit("X").alias("o_orderstatus"))
    return relational.upsert(rows, changes, ["o_orderkey"])


@query("""with m as (select distinct case when l_partkey in (1, 2) then 0 else l_partkey end as part, l_orderkey from lineitem) select part, l_orderkey from m""")
def m8_fold_category(spark, sf_dir):
    """M8: memberships moved to another category without doubling."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey")
    return lifecycle.fold(rows, "part", [1, 2], 0)


@query("""with s as (select conv_id as artifact, conv_id % 50 as cluster, turn, role, text, conv_id || chr(9) || text as line from conversations where text is not null and turn is not null),
told as (select distinct cluster, text from s where role = 'user'), c as (select s.*, t.text is not null as said from s left join told t on t.cluster = s.cluster and t.text = s.text),
k as (select cluster, cluster % 3 as turnout, string_agg(line, chr(10) order by line) as every, string_agg(line, chr(10) order by line) filter (where said) as stated,
string_agg(line, chr(10) order by line) filter (where case cluster % 3 when 0 then true when 1 then said else turn > 0 end) as built, count(*) as n, count(*) filter (where said) as m from c group by cluster)
select cluster, case when built is null then null when every = built then 'every' when stated = built then 'stated' else 'left' end as how, case when every = built then n when stated = built then m else 0 end as claims from k where built is not null""")
def m6_backfill(spark, sf_dir):
    """M6: claim rows of clusters built before they were kept, recomputed from their keys; here conversations are sections, a third of the clusters kept all claims, a third what users said, the rest lost their first turns."""
    rows = table(spark, sf_dir, "conversations").where("text is not null and turn is not null")
    said = rows.select(F.col("conv_id").alias("artifact"), F.col("turn").cast("int").alias("claim_index"), "text", "role", (F.col("conv_id") % 50).alias("cluster"))
    listed = said.where("role = 'user'").select("cluster", "text").distinct()
    marked = said.join(listed.withColumn("told", F.lit(True)), ["cluster", "text"], "left")
    kept = F.when(F.col("cluster") % 3 == 0, F.lit(True)).when(F.col("cluster") % 3 == 1, F.coalesce("told", F.lit(False))).otherwise(F.col("claim_index") > 0)
    built = marked.groupBy("cluster").agg(claims.set_key(F.col("artifact"), F.col("text"), kept).alias("member_key"))
    clusters = built.join(listed.groupBy("cluster").agg(F.count("*").alias("size")), "cluster", "left")
    members = said.select("cluster", "artifact", (F.col("artifact") % 7).alias("document")).distinct()
    path = f"{shared_dir(spark).rstrip('/')}/claims-{uuid.uuid4().hex}"
    filled = claims.backfill(clusters, members, said.select("artifact", "claim_index", "text"), listed, path)
    written = claims.read(spark, path).groupBy("cluster").agg(F.count("*").alias("claims"))
    return filled.join(written, "cluster", "left").select("cluster", "how", F.coalesce("claims", F.lit(0)).alias("claims"))


@query("""with names(raw) as (values ('Asia'), ('EUROPA'), ('orient'), ('Nowhere')), alias(old, now) as (values ('orient', 'ASIA'), ('europa', 'EUROPE')), r as (select r_name from region)
select raw, coalesce(a.r_name, b.now, raw) as resolved, case when a.r_name is not null then 'same' when b.now is not null then 'merged' else 'new' end as how
from names left join r a on upper(raw) = a.r_name left join alias b on lower(raw) = b.old""")
def m9_resolve_names(spark, sf_dir):
    """M9: names resolved by equality, then by what was merged into a survivor."""
    names = spark.createDataFrame([("Asia",), ("EUROPA",), ("orient",), ("Nowhere",)], "raw string")
    merged = spark.createDataFrame([("orient", "ASIA"), ("europa", "EUROPE")], "old string, now string")
    return lifecycle.resolve_names(names, table(spark, sf_dir, "region").select("r_name"), "r_name", merged)


@query("""with t as (select l_partkey % 40 as tag, l_suppkey as doc, case when l_linenumber = 1 then 'shelf' else 'reader' end as origin from lineitem), k as (select distinct p_size as tag from part where p_size < 30)
select case when k.tag is null then 'unknown' when origin = 'shelf' then 'home' when doc % 9 = 0 then 'stale' else 'reader' end as kind, count(*) as n from t left join k using (tag) group by 1""")
def m10_tag_audit(spark, sf_dir):
    """Tags by where they come from."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("tag"), F.col("l_suppkey").alias("doc"), F.when(F.col("l_linenumber") == 1, "shelf").otherwise("reader").alias("origin"))
    known = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_size").cast("bigint").alias("tag")).distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("known").isNull(), "unknown").when(F.col("origin") == "shelf", "home").when(F.col("doc") % 9 == 0, "stale").otherwise("reader")
    return rows.join(known, "tag", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""with gone as (select o_orderkey from orders where o_custkey in (1, 2, 4, 5, 7)) select 'orders' as kind, count(*) as n from orders where o_orderkey not in (select o_orderkey from gone)
union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from gone)""")
def m13_purge(spark, sf_dir):
    """A deletion's cascade over every table that refers to what goes."""
    gone = table(spark, sf_dir, "orders").where(F.col("o_custkey").isin(1, 2, 4, 5, 7)).select("o_orderkey")
    kept = lifecycle.purge({"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "lineitem": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, gone, "o_orderkey")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1])


@query("""with m as (select distinct l_suppkey as coll, l_orderkey as doc, l_linenumber <= 2 as introduced from lineitem), i as (select coll, doc, bool_or(introduced) as introduced from m group by all)
select doc from i a where coll = 3 and introduced and not exists (select 1 from i b where b.doc = a.doc and b.coll <> 3)""")
def m16_eject(spark, sf_dir):
    """What a collection introduced and no other holds."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("coll"), F.col("l_orderkey").alias("doc")).agg(F.max(F.col("l_linenumber") <= 2).alias("introduced"))
    return lifecycle.ejected(rows, "coll", "doc", 3)


@query("""with loc as (select sha256(text) as h, min(doc_id) as local_id from documents where doc_id % 2 = 0 group by 1), inc as (select doc_id, sha256(text) as h from documents where doc_id % 2 <> 0)
select doc_id, local_id, case when local_id is null then 'introduced' else 'joined' end as how from inc left join loc using (h)""")
def m18b_import_match(spark, sf_dir):
    """Incoming documents (the odd ones) matched with local ones (the even ones) by content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    local = docs.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("local_id"))
    matched = docs.where("doc_id % 2 <> 0").join(local, "h", "left")
    return matched.select("doc_id", "local_id", F.when(F.col("local_id").isNull(), "introduced").otherwise("joined").alias("how"))


@query("""with a as (select l_orderkey, l_partkey as target, l_linenumber as seq from lineitem), t as (select p_partkey as target from part where p_partkey % 4 <> 0),
r as (select *, row_number() over (partition by l_orderkey, target order by seq) as n from a join t using (target)) select l_orderkey, target, seq from r where n = 1""")
def m18d_import_artifacts(spark, sf_dir):
    """M18d: artifacts whose target resolves, the first of repeats."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("seq"))
    targets = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("target"))
    return relational.first_per_key(relational.in_scope(rows, "target", [targets]), ["l_orderkey", "target"], [F.asc("seq")])


@query("""select doc_id, case when doc_id % 3 = 0 then 'full' when doc_id % 3 = 1 then 'readings' else 'catalogue' end as level,
case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then substr(text, 1, 200) end as body, n_chars from documents""")
def m15_export_levels(spark, sf_dir):
    """What each export level lets out of a document."""
    level = F.when(F.col("doc_id") % 3 == 0, "full").when(F.col("doc_id") % 3 == 1, "readings").otherwise("catalogue")
    body = F.when(F.col("level") == "full", F.col("text")).when(F.col("level") == "readings", F.substring("text", 1, 200))
    return table(spark, sf_dir, "documents").withColumn("level", level).select("doc_id", "level", body.alias("body"), "n_chars")


@query("""with s as (select c_nationkey as shelf, count(*) as n from customer group by 1), t as (select count(*) as total, count(*) filter (where c_mktsegment is null or c_acctbal < -900) as unshelved from customer),
h as (select count(*) filter (where n > 70) as crowded, count(*) filter (where n < 45) as sparse, count(*) as shelves from s)
select total, unshelved, crowded, sparse, shelves, case when unshelved > 20 and unshelved > 0.25 * total then 'redesign' when crowded > 0 then 'split' when sparse > 0 then 'merge' else 'fine' end as reason from t, h""")
def a23_shelf_health(spark, sf_dir):
    """Counts over the shelves and the first rule that holds."""
    customer = table(spark, sf_dir, "customer")
    sizes = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    shelves = sizes.agg(F.count_if(F.col("n") > 70).alias("crowded"), F.count_if(F.col("n") < 45).alias("sparse"), F.count("*").alias("shelves"))
    whole = customer.agg(F.count("*").alias("total"), F.count_if(F.col("c_mktsegment").isNull() | (F.col("c_acctbal") < -900)).alias("unshelved"))
    reason = F.when((F.col("unshelved") > 20) & (F.col("unshelved") > 0.25 * F.col("total")), "redesign").when(F.col("crowded") > 0, "split").when(F.col("sparse") > 0, "merge").otherwise("fine")
    # both sides are one row
    return whole.join(shelves, F.lit(True)).withColumn("reason", reason)


@query("""with c as (select conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations where role = 'user'),
d as (select conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations where role = 'assistant'),
j as (select c.conv_id, c.turn, d.turn as source, case when c.text = d.text then 2.0::double else len(list_intersect(c.w, d.w))::double / len(list_distinct(list_concat(c.w, d.w))) end as score from c join d using (conv_id)),
r as (select *, row_number() over (partition by conv_id, turn order by round(score, 9) desc, source) as n from j) select conv_id, turn, source, round(score, 6) as score from r where n = 1""")
def j17_evidence(spark, sf_dir):
    """Each claim's best evidence by shared words; equal texts count double."""
    rows = table(spark, sf_dir, "conversations").withColumn("w", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    claims = rows.where("role = 'user'").select("conv_id", "turn", "text", "w")
    held = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("source"), F.col("text").alias("t2"), F.col("w").alias("w2"))
    score = F.when(F.col("text") == F.col("t2"), 2.0).otherwise(F.size(F.array_intersect("w", "w2")) / F.size(F.array_union("w", "w2")))
    best = relational.first_per_key(claims.join(held, "conv_id").withColumn("score", score), ["conv_id", "turn"], [F.desc(F.round("score", 9)), F.asc("source")])
    return best.select("conv_id", "turn", "source", F.round("score", 6).alias("score"))


@query()
def m5_clusters(spark, sf_dir):
    """M5: density clusters of vectors, the leaves of the hierarchy of mutual reachability; -1 is noise."""
    return density.density_clusters(table(spark, sf_dir, "embeddings"), min_size=3, min_samples=1)


@query()
def m5_similar_parts(spark, sf_dir):
    """M5, the coarse way: connected parts of the graph above a similarity; labels of fewer than three are noise."""
    return lifecycle.clusters(table(spark, sf_dir, "embeddings"), 0.3, 3)


@query("""with f as (select n_nationkey as id, lower(n_name) as name, r_name as top from nation join region on r_regionkey = n_regionkey)
select top, count(*) as subs, count(distinct name) = count(*) and count(*) >= 2 and not bool_or(regexp_matches(name, '^(other|misc|general|various)')) as sane from f group by top""")
def p22_taxonomy_sane(spark, sf_dir):
    """Top categories with two subcategories or more, distinct names and no fillers."""
    tree = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("n_name").alias("name"), F.col("r_name").alias("top"))
    filler = F.max(F.col("name").rlike("^(other|misc|general|various)"))
    return tree.groupBy("top").agg(F.count("*").alias("subs"), F.count_distinct("name").alias("d"), filler.alias("f")).select("top", "subs", ((F.col("d") == F.col("subs")) & (F.col("subs") >= 2) & ~F.col("f")).alias("sane"))


@query("""with recursive e as (select 'nation' as owner_kind, c_nationkey::bigint as owner_id, 'customer' as kind, c_custkey::bigint as id from customer
union all select 'customer', o_custkey, 'orders', o_orderkey from orders union all select 'orders', l_orderkey, 'lineitem', l_orderkey * 10 + l_linenumber from lineitem),
g(kind, id, depth) as (select 'nation', n_nationkey::bigint, 0 from nation where n_regionkey = 2 union select e.kind, e.id, depth + 1 from g join e on e.owner_kind = g.kind and e.owner_id = g.id)
select kind, depth::int as depth, count(distinct id) as n, min(id) as least, max(id) as most from g group by all""")
def m13_cascade(spark, sf_dir):
    """All that goes with a region's nations, over three levels of owners of any kind: counts and ends of each."""
    owned = lambda name, owner, of, kind, key: table(spark, sf_dir, name).select(F.lit(owner).alias("owner_kind"), F.col(of).cast("bigint").alias("owner_id"), F.lit(kind).alias("kind"), key.cast("bigint").alias("id"))
    edges = owned("customer", "nation", "c_nationkey", "customer", F.col("c_custkey"))
    edges = edges.unionByName(owned("orders", "customer", "o_custkey", "orders", F.col("o_orderkey")))
    edges = edges.unionByName(owned("lineitem", "orders", "l_orderkey", "lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    seeds = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"))
    gone = closures.cascade(edges, seeds)
    return gone.groupBy("kind", "depth").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query("""with recursive l as (select p_partkey as old, case when p_partkey % 60 = 30 then p_partkey + 4 else p_partkey - 1 end as now from part where p_partkey % 6 <> 0 or p_partkey % 60 = 30),
w(old, now, steps) as (select old, now, 1 from l union all select w.old, l.now, steps + 1 from w join l on l.old = w.now where steps < 12),
r as (select old, max(steps) as steps, max_by(now, steps) as now from w group by old)
select old, case when steps < 12 then now end as now, case when steps < 12 then steps end::bigint as steps, steps = 12 as circular from r""")
def m9_alias_chains(spark, sf_dir):
    """What names came to be called over chains of merges, and those merged in a circle; here runs of six keys and some circles."""
    key = F.col("p_partkey")
    merged = table(spark, sf_dir, "part").where((key % 6 != 0) | (key % 60 == 30)).select(key.alias("old"), F.when(key % 60 == 30, key + 4).otherwise(key - 1).alias("now"))
    return closures.resolved(merged)


@query()
def v3_plane(spark, sf_dir):
    """§2.8: vectors drawn on a plane by their first two principal components, each stretched to 0 to 1."""
    return closures.plane(table(spark, sf_dir, "embeddings")).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
