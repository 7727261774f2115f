"""Relational queries: predicates, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import ranking, relational
from folioforge.plans.registry import query
from folioforge.tables import table


@query("""select c_custkey, c_mktsegment from customer c where
 (exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')
  or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000))
 and c_nationkey in (select n_nationkey from nation where n_regionkey < 3)""")
def p1_scope_semi_or(spark, sf_dir):
    """A row is in scope by one tag or another, and by membership."""
    orders = table(spark, sf_dir, "orders")
    tags = [orders.where(c).select(F.col("o_custkey").alias("c_custkey")) for c in (F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 400000)]
    members = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    scoped = relational.in_any_scope(table(spark, sf_dir, "customer"), "c_custkey", tags)
    return relational.in_scope(scoped, "c_nationkey", [members, None]).select("c_custkey", "c_mktsegment")


@query("""with l(o_orderstatus, level) as (values ('F', 'secret'))
select o_orderkey, coalesce(level, case when o_orderpriority = '1-URGENT' then 'internal' end, 'public') as level from orders left join l using (o_orderstatus)
where coalesce(level, case when o_orderpriority = '1-URGENT' then 'internal' end, 'public') in ('internal', 'secret')""")
def p2_level_coalesce(spark, sf_dir):
    """A row's level is its own, its owner's or the default; only allowed levels pass."""
    own = spark.createDataFrame([("F", "secret")], "o_orderstatus string, own string")
    level = F.coalesce("own", F.when(F.col("o_orderpriority") == "1-URGENT", "internal"), F.lit("public"))
    return table(spark, sf_dir, "orders").join(own, "o_orderstatus", "left").select("o_orderkey", level.alias("level")).where(F.col("level").isin("internal", "secret"))


@query("""select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'A')
 and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_returnflag = 'R')""")
def p3_reading_scope(spark, sf_dir):
    """Owners with an allowed part and without a forbidden one."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    some = table(spark, sf_dir, "orders").join(parts.where("l_returnflag = 'A'"), "o_orderkey", "left_semi")
    return some.join(parts.where("l_returnflag = 'R'"), "o_orderkey", "left_anti").select("o_orderkey")


@query("""(select c_custkey from customer where c_mktsegment = 'BUILDING' union select o_custkey from orders where o_totalprice > 300000)
intersect select c_custkey from customer where c_acctbal > 0 except select o_custkey from orders where o_orderstatus = 'P'""")
def p11_scope_sets(spark, sf_dir):
    """Scopes joined, intersected and reduced as sets."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    ids = lambda df, c: df.select(F.col(c).alias("c_custkey"))
    either = ids(customer.where("c_mktsegment = 'BUILDING'"), "c_custkey").union(ids(orders.where("o_totalprice > 300000"), "o_custkey")).distinct()
    return either.intersect(ids(customer.where("c_acctbal > 0"), "c_custkey")).exceptAll(ids(orders.where("o_orderstatus = 'P'"), "o_custkey").distinct())


@query("""with c as (select r_regionkey as id, null::int as parent from region union all select 100 + n_nationkey, n_regionkey from nation)
select distinct id from c where id in (1, 3, 107) or parent in (1, 3, 107)""")
def p12_expand_children(spark, sf_dir):
    """Categories with their children, one level."""
    tree = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"))
    tree = tree.union(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), "n_regionkey"))
    wanted = spark.createDataFrame([(1,), (3,), (107,)], "id int")
    children = tree.join(wanted.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")
    return tree.join(wanted, "id", "left_semi").select("id").union(children).distinct()


@query("""select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and o_custkey not in (select c_custkey from customer where c_acctbal < 0)
order by o_orderdate, o_orderkey limit 50""")
def p14_backfill(spark, sf_dir):
    """Ready rows that aren't busy, oldest first, a limited number."""
    busy = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    ready = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(busy, "o_custkey", "left_anti")
    return ready.select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(50)


@query("""select n_name, r_name from nation left join region on r_regionkey = n_regionkey + 1 where r_name is distinct from 'ASIA'""")
def p16_distinct_from(spark, sf_dir):
    """Inequality under which nulls count as values."""
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") - 1).alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(regions, "n_regionkey", "left").where(~F.col("r_name").eqNullSafe("ASIA")).select("n_name", "r_name")


@query("""select doc_id from documents order by md5(doc_id || ':42'), doc_id limit 20""")
def p21_random_rows(spark, sf_dir):
    """Twenty rows in a random order that stays the same for a seed."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))), "doc_id").limit(20)


@query("""select o_orderkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c_acctbal > 1000)""")
def j5_orphans(spark, sf_dir):
    """Rows whose owner isn't there."""
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("o_custkey"))
    return relational.orphans(table(spark, sf_dir, "orders"), owners, "o_custkey").select("o_orderkey")


@query("""select c_custkey, o_orderkey as last_order, o_totalprice from customer left join
(select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) on o_custkey = c_custkey and n = 1""")
def j6_lateral_first(spark, sf_dir):
    """Each owner's first related row, by a window before the join."""
    last = relational.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("last_order"), "o_totalprice")


@query("""with p as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
select doc_id, (i - 1)::int as i, length(line)::int as n from p where length(line) > 300""")
def j8_unnest_ordinality(spark, sf_dir):
    """Arrays unnested with their ordinal."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", F.length("line").alias("n")).where("n > 300")


@query("""with m as (select distinct l_orderkey, l_partkey from lineitem)
select a.l_partkey as a, b.l_partkey as b, count(*) as shared, round(least(1.0, 0.5 + 0.15 * count(*))::double, 6) as weight
from m a join m b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by all""")
def j10_co_members(spark, sf_dir):
    """Pairs of members that share groups, and the weight of their edge."""
    rows = table(spark, sf_dir, "lineitem")
    pairs = relational.co_members(rows, "l_orderkey", "l_partkey")
    return pairs.withColumn("weight", F.round(F.least(F.lit(1.0), 0.5 + 0.15 * F.col("shared")), 6))


@query("""select n.n_name, s.s_suppkey, r.r_name from supplier s join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey""")
def j13_endpoints(spark, sf_dir):
    """Both endpoints' attributes by joins to small tables."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_name", "s_suppkey", "r_name")
    )


@query("""select p_partkey, coalesce(cites, 0)::bigint as cites, (case when p_size > 45 then 1000 else 0 end + coalesce(cites, 0) * 50 + p_size)::bigint as score,
case when p_size > 45 then 'starred' when coalesce(cites, 0) > 0 then 'cited' else 'used' end as reason
from part left join (select l_partkey, count(*) as cites from lineitem group by 1) on l_partkey = p_partkey order by score desc, p_partkey limit 30""")
def w18_promotion(spark, sf_dir):
    """Candidates by a weighted score, with the reason."""
    cites = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part").join(cites, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("cites", F.coalesce("n", F.lit(0)).cast("bigint"))
    starred = F.col("p_size") > 45
    score = (F.when(starred, 1000).otherwise(0) + F.col("cites") * 50 + F.col("p_size")).cast("bigint")
    reason = F.when(starred, "starred").when(F.col("cites") > 0, "cited").otherwise("used")
    return part.select("p_partkey", "cites", score.alias("score"), reason.alias("reason")).orderBy(F.desc("score"), "p_partkey").limit(30)


@query("""select c.n_name as shelf, p.r_name as parent from nation c left join region p on p.r_regionkey = c.n_regionkey and p.r_name <> 'EUROPE'""")
def j15_parent(spark, sf_dir):
    """A shelf with its parent, where it has one."""
    parent = table(spark, sf_dir, "region").where("r_name <> 'EUROPE'")
    return table(spark, sf_dir, "nation").join(parent, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("shelf"), F.col("r_name").alias("parent"))


@query("""select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderstatus <> 'F', o_orderdate, o_orderkey) as n from orders) where n = 1""")
def j16_overlay(spark, sf_dir):
    """One row per key, preferred kinds first."""
    rows = relational.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [(F.col("o_orderstatus") != "F").asc(), F.asc("o_orderdate"), F.asc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""select o_custkey, count(*) as n, o_orderpriority from orders group by all""")
def a2_grouped_count(spark, sf_dir):
    """Rows per group."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""select p_name, count(*) as cited from lineitem join part on p_partkey = l_partkey group by p_partkey, p_name order by cited desc, p_name limit 20""")
def a3_hubs(spark, sf_dir):
    """A3: the most referenced, counted before names are joined."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cited"))
    return counts.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_name", "cited").orderBy(F.desc("cited"), "p_name").limit(20)


@query("""select label, list_sort(list_distinct(list(vec_id % 7))) as residues, count(*) as n from embeddings group by label""")
def a4_distinct_lists(spark, sf_dir):
    """A4: sorted lists of distinct values per group."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_set(F.col("vec_id") % 7)).alias("residues"), F.count("*").alias("n"))


@query("""select conv_id, list(turn order by turn) as turns, string_agg(role, '>' order by turn) as roles from conversations group by conv_id""")
def a5_ordered_lists(spark, sf_dir):
    """A5: lists in the order of another column."""
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return listed.select("conv_id", F.col("l.turn").alias("turns"), F.array_join("l.role", ">").alias("roles"))


@query("""with k as (select l_orderkey, l_returnflag, arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) as q from lineitem group by all) select l_orderkey, list(l_returnflag order by l_returnflag) as flags, list(q order by l_returnflag) as quantities from k group by 1""")
def a6_map_aggregate(spark, sf_dir):
    """A map per group; of equal keys the last by order."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    made = relational.map_of_last(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", order)
    return made.select("l_orderkey", F.map_keys("entries").alias("flags"), F.map_values("entries").alias("quantities"))


@query("""select l_suppkey, round(count(*) filter (where l_returnflag = 'R')::double / count(*), 6) as ratio from lineitem group by 1 having count(*) >= 5""")
def a7_ratio_having(spark, sf_dir):
    """Filtered share of each group of five or more."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("n"))
    return counts.where("n >= 5").select("l_suppkey", F.round(F.col("hits") / F.col("n"), 6).alias("ratio"))


@query("""select text as seed, max(turn) as last from conversations where role = 'user' and length(text) between 8 and 600 group by text""")
def a9_message_seeds(spark, sf_dir):
    """Distinct user messages of a usable length, with their last use."""
    rows = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & F.length("text").between(8, 600))
    return rows.groupBy(F.col("text").alias("seed")).agg(F.max("turn").alias("last"))


@query("""select conv_id, count(*) as n, max(turn) as last from conversations group by conv_id""")
def a10_conversation_counts(spark, sf_dir):
    """A10: messages and last turn of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))


@query("""with e(a, b, weight, kind) as (select l_suppkey, l_partkey % 97, 0.6, 'near' from lineitem where l_linenumber = 1
 union all select l_partkey % 97, l_suppkey, 1.0, 'cite' from lineitem where l_linenumber = 2 union all select l_suppkey, l_partkey % 97, 0.8, 'thread' from lineitem where l_linenumber = 3)
select least(a, b) as a, greatest(a, b) as b, max(weight)::double as weight, case max(case kind when 'cite' then 2 when 'thread' then 1 else 0 end) when 2 then 'cite' when 1 then 'thread' else 'near' end as kind from e group by 1, 2""")
def a11_edge_merge(spark, sf_dir):
    """Edges of several kinds as one graph."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 97).alias("p"), "l_linenumber")
    kinds = [(1, "s", "p", 0.6, "near"), (2, "p", "s", 1.0, "cite"), (3, "s", "p", 0.8, "thread")]
    edges = None
    for line, a, b, weight, kind in kinds:
        part = rows.where(F.col("l_linenumber") == line).select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"))
        edges = part if edges is None else edges.unionByName(part)
    return relational.merge_edges(edges)


@query("""select r_name, n_name, coalesce(c, 0) as customers, coalesce(s, 0) as suppliers from nation join region on r_regionkey = n_regionkey
left join (select c_nationkey, count(*) as c from customer group by 1) on c_nationkey = n_nationkey left join (select s_nationkey, count(*) as s from supplier group by 1) on s_nationkey = n_nationkey""")
def a12_shelf_counts(spark, sf_dir):
    """Two counts for each category."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    shelves = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    out = shelves.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select("r_name", "n_name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "suppliers")))


@query("""select p_brand, count(*) as n, list_sort(list(p_name))[1:6] as first_names from part group by p_brand""")
def a13_subjects(spark, sf_dir):
    """Count and first six titles of each subject, picked before they are gathered."""
    names = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    counts = names.groupBy("p_brand").agg(F.count("*").alias("n"))
    first = ranking.top_per_group(names, ["p_brand"], [F.asc("p_name"), F.asc("p_partkey")], 6)
    listed = first.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("first_names"))
    return counts.join(listed, "p_brand")


@query("""with c as (select source, lang, count(*) as n from documents group by all) select source, lang, n from (select *, row_number() over (partition by source order by n desc, lang) as k from c) where k = 1""")
def a14_mode(spark, sf_dir):
    """Dominant value of each group, ties by value."""
    return relational.mode(table(spark, sf_dir, "documents"), ["source"], "lang")


@query("""with v as (select o_custkey, lower(o_orderpriority) as vote, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders),
g as (select o_custkey, vote, count(*) as n, min(pos) as first from v group by all)
select o_custkey, vote, n, k::int as k from (select *, row_number() over (partition by o_custkey order by n desc, first) as k from g) where k <= 3""")
def a15_votes(spark, sf_dir):
    """Pooled votes, the three most frequent in order of first mention."""
    seen = table(spark, sf_dir, "orders").withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    votes = seen.groupBy("o_custkey", F.lower("o_orderpriority").alias("vote")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return ranking.top_per_group(votes, ["o_custkey"], [F.desc("n"), F.asc("first")], 3, "k").select("o_custkey", "vote", "n", "k")


@query("""select l_orderkey, sum(case when l_returnflag = 'R' then 1 else 0 end) >= 2 as verdict, count(*) as votes from lineitem where l_linenumber <= 3 group by 1""")
def a16_majority(spark, sf_dir):
    """Yes where two of at most three votes say so."""
    votes = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    return votes.groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") == "R") >= 2).alias("verdict"), F.count("*").alias("votes"))


@query("""with f as (select o_custkey, o_clerk, n from (select c_nationkey as o_clerk, c_custkey as o_custkey from customer), (select 1 as n)),
g as (select o_clerk, count(*) as n from f group by 1) select case when n < 60 then -1 else o_clerk end as collection, sum(n)::bigint as n from g group by 1""")
def a26_collections(spark, sf_dir):
    """Small groups merged into one."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return sizes.groupBy(F.when(F.col("n") < 60, -1).otherwise(F.col("k")).alias("collection")).agg(F.sum("n").alias("n"))


@query("""select source, count(*) as n, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes from documents group by source""")
def a24_export_size(spark, sf_dir):
    """Counts and sizes of what an export would hold."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""with r as (select o_custkey, max(case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 else 0 end) as rank from orders group by 1)
select o_custkey, ['public', 'internal', 'secret', 'top'][rank + 1] as level from r""")
def a25_highest_level(spark, sf_dir):
    """The highest level by rank."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(0)
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("r"))
    return top.select("o_custkey", F.element_at(F.array(*map(F.lit, ("public", "internal", "secret", "top"))), F.col("r") + 1).alias("level"))


@query("""select conv_id, turn, role, row_number() over (partition by conv_id order by turn // 2, role = 'assistant', turn)::int as pos from conversations""")
def w15_message_order(spark, sf_dir):
    """Questions before answers of the same time."""
    order = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), F.col("role") == "assistant", "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).alias("pos"))


@query("""with u as (select doc_id, 'a' as setup, row_number() over (order by n_chars desc, doc_id) as rk from documents union all select doc_id, 'b', row_number() over (order by n_chars, doc_id) from documents
 union all select doc_id, 'c', row_number() over (order by doc_id) from documents), p as (select distinct doc_id from u where rk <= 8)
select doc_id, lower(source) as title, row_number() over (order by lower(source), doc_id)::int as pos from p join documents using (doc_id)""")
def u5_pool(spark, sf_dir):
    """The union of several setups' first eight, by title."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    orders = [[F.desc("n_chars"), F.asc("doc_id")], [F.asc("n_chars"), F.asc("doc_id")], [F.asc("doc_id")]]
    tops = [docs.orderBy(*o).limit(8).select("doc_id", "source") for o in orders]
    pooled = tops[0].unionByName(tops[1]).unionByName(tops[2]).dropDuplicates(["doc_id"])
    title = F.lower("source")
    return pooled.select("doc_id", title.alias("title"), F.row_number().over(Window.orderBy(title, "doc_id")).alias("pos"))
