"""Queries of verdicts, gates and ceilings: explanations and votes, designed shelves, named and cited volumes, what a question may read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import guards
from folioforge.functions import text as tx
from folioforge.operators import classify, ranking, references, shelving, votes
from folioforge.plans.registry import query
from folioforge.tables import table

#: Explanations put before the tables' own texts, as these speak of no conflict; the last stands alone.
_SAID = [
    "The claims directly conflict because A requires a majority and B one acknowledgement.",
    "They seem to conflict at first, but they describe different systems in practice.",
    "These sources do not directly contradict each other; they cover separate topics.",
    "Explain why the claims conflict or why they do not, in one sentence please.",
    "The content of this page has been moved elsewhere, and both pages say so now.",
    "short",
]
_WHEN = " ".join(f"when {i} then '{s}'" + ("" if s == "short" else " || ' ' || text") for i, s in enumerate(_SAID, 1))
_DENIES = f"coalesce(regexp_matches(substr(x, 1, 400), '{guards.DENIES}'), false)"
_AFFIRMS = (
    rf"coalesce(len(list_filter(list_transform(string_split_regex(substr(x, 1, 400), '[.\n]'), lambda s: regexp_extract(s, '(?s)^.*?(?:{guards.AFFIRMS})', 0)), "
    rf"lambda u: u <> '' and not regexp_matches(u, '{guards.HEDGES}'))) > 0 and not {_DENIES}, false)"
)
_JUNK = f"coalesce(length(trim(x)) < 40 or regexp_matches(x, '{guards.INSTRUCTION}') or regexp_matches(substr(x, 1, 300), '{guards.MOVED}'), true)"
_EXPLAINED = f"(select *, {_DENIES} as denies, {_AFFIRMS} as affirms, {_JUNK} as junk from (select *, case (conv_id + turn) % 7 {_WHEN} else text end as x from conversations))"


def _explained(spark, sf_dir):
    """Conversations with an explanation: a text of the table, or one that begins with a verdict, dealt by id and turn."""
    rows = table(spark, sf_dir, "conversations")
    said = F.col("text")
    for i, s in enumerate(_SAID, 1):
        said = F.when((F.col("conv_id") + F.col("turn")) % 7 == i, F.lit(s) if s == "short" else F.concat(F.lit(s + " "), "text")).otherwise(said)
    return rows.withColumn("explanation", said)


@query(f"select conv_id, turn, denies, affirms, junk from {_EXPLAINED}")
def p24_explanations(spark, sf_dir):
    """What explanations say, whatever verdict they come with; the same rules over the tables' texts."""
    text = F.col("explanation")
    return _explained(spark, sf_dir).select("conv_id", "turn", guards.denies(text).alias("denies"), guards.affirms(text).alias("affirms"), guards.is_junk(text).alias("junk"))


@query(f"""with v as (select conv_id, turn, (conv_id + turn) % 3 <> 0 as said, length(trim(case when turn % 5 = 4 then 'x' else coalesce(substr(text, 1, 12), '') end)) >= 3 as named, denies, affirms, junk from {_EXPLAINED}),
g as (select conv_id, turn, bool_or((said or (affirms and named and not junk)) and not junk and not denies and named) as yes from v group by all),
r as (select *, row_number() over (partition by conv_id order by turn) as n from g), w as (select conv_id, list(yes order by turn) as y, list(turn order by turn) as t from r where n <= 3 group by conv_id),
c as (select conv_id, case when len(y) >= 2 and y[1] = y[2] then y[1:2] else y end as y, t from w), s as (select *, len(list_filter(y, lambda v: v)) as ayes from c)
select conv_id, ayes >= 2 as disagreement, ayes::int as yes, len(y)::int as votes, case when ayes >= 2 and not y[1] then t[2] else t[1] end as chosen from s""")
def a16_guarded_votes(spark, sf_dir):
    """Verdicts by majority of at most three votes, each held against its own explanation and subject first."""
    subject = F.when(F.col("turn") % 5 == 4, "x").otherwise(F.substring("text", 1, 12))
    cast = _explained(spark, sf_dir).select("conv_id", "turn", "explanation", subject.alias("subject"), ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("disagreement"))
    return votes.majority(votes.guarded(cast), "conv_id", "turn")


@query(rf"""with d as (select p_partkey // 6 as design, case when p_size > 45 then 3 else p_partkey % 3 end as shelf, case when p_partkey % 11 = 0 then 'Topic ' || p_size when p_partkey % 13 = 0 then 'Guides & ' || p_name else p_name end as top,
case when p_partkey % 29 = 0 then null when p_partkey % 31 = 0 then 'shelf ' || p_size when p_partkey % 37 = 0 then p_name else p_brand end as sub from part),
e as (select design, shelf, lower(max(top)) as top, count(sub) as subs from d group by all),
t as (select design, count(*) as tops, min(subs) < 2 as single, bool_or(len(list_intersect(string_split_regex(top, '[\s&/-]+'), {shelving.BANNED})) > 0) as activity from e group by design),
l as (select *, list_filter(string_split(top, ' '), lambda w: length(w) > 4) as w from e),
p as (select a.design, bool_or(contains(a.top, b.top) or contains(b.top, a.top) or len(list_intersect(a.w, b.w)) > 0) as alike from l a join l b on a.design = b.design and a.shelf < b.shelf group by a.design),
n as (select design, top as raw from e union all select design, sub from d where sub is not null), u as (select design, lower(raw) as name, count(*) as n, bool_or(regexp_matches(raw, '{shelving.UNFILLED}')) as form from n group by all),
m as (select design, bool_or(form) as unfilled, max(n) > 1 as repeated from u group by design)
select design, tops, tops <= 3 as sizes, unfilled, activity, tops <= 3 and coalesce(alike, false) as alike, single, repeated, tops <= 3 and not (unfilled or activity or coalesce(alike, false) or single or repeated) as sane
from t join m using (design) left join p using (design)""")
def p22_taxonomy_gate(spark, sf_dir):
    """Designs of shelves against every rule of the gate; six parts are a design here, and some of their names are spoilt by id."""
    key = F.col("p_partkey")
    top = F.when(key % 11 == 0, F.concat(F.lit("Topic "), F.col("p_size").cast("string"))).when(key % 13 == 0, F.concat(F.lit("Guides & "), "p_name")).otherwise(F.col("p_name"))
    sub = F.when(key % 29 == 0, None).when(key % 31 == 0, F.concat(F.lit("shelf "), F.col("p_size").cast("string"))).when(key % 37 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    shelf = F.when(F.col("p_size") > 45, F.lit(3)).otherwise(key % 3)
    return shelving.taxonomy_faults(table(spark, sf_dir, "part").select(F.floor(key / 6).alias("design"), shelf.alias("shelf"), top.alias("top"), sub.alias("sub")), 2)


@query("""with h as (select l_orderkey as volume, l_partkey as coll, 'S' || l_partkey % 50 as name from lineitem), f as (select volume, min((name, coll)) as x from h group by volume),
p as (select o_orderkey as volume, 'cart:' || x[2] as k from orders left join f on volume = o_orderkey), g as (select *, count(*) over (partition by k) as n from p),
c as (select case when k is null or n < 20 then 'local' else k end as collection, count(*) as n from g group by 1)
select collection, n, row_number() over (order by n desc, collection)::int as place from c""".replace("x[2]", "x.c").replace("min((name, coll))", "min({'n': name, 'c': coll})"))
def a26_first_collections(spark, sf_dir):
    """Volumes by their first collection by name, small ones with those of none, largest first."""
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("volume"), F.col("l_partkey").alias("collection"), F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string")).alias("name"))
    placed = shelving.collections(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("volume")), held)
    sizes = placed.groupBy("collection").agg(F.count("*").alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "collection")))  # a row a collection


_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""with q as (select conv_id || ':' || turn as question_id, ' ' || {_NORM.format("text")} || ' ' as asked from conversations where text is not null),
t as (select 'd' || doc_id as title_id, array_to_string(string_split(text, ' ')[1:2], ' ') as title from documents union all select 'c' || conv_id || ':' || turn, 'The ' || array_to_string(string_split(text, ' ')[3:7], ' ') from conversations where turn % 4 = 0),
b as (select title_id, regexp_replace({_NORM.format("title")}, '^(the|a|an) ', '') as bare from t where length(title) >= 10)
select question_id, title_id from q join b on length(bare) >= 10 and contains(asked, ' ' || bare || ' ')""")
def p13_named_documents(spark, sf_dir):
    """The titles that messages name as whole words; titles are documents' first words and later words of messages, as the tables hold none."""
    rows = table(spark, sf_dir, "conversations")
    words = F.split("text", " ")
    first = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title_id"), F.array_join(F.slice(words, 1, 2), " ").alias("title"))
    place = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    later = rows.where("turn % 4 = 0").select(F.concat(F.lit("c"), place).alias("title_id"), F.concat(F.lit("The "), F.array_join(F.slice(words, 3, 5), " ")).alias("title"))
    return references.named_titles(rows.where("text is not null").select(place.alias("question_id"), F.col("text").alias("question")), first.unionByName(later))


@query(r"""with e as (select conv_id, turn, substr(text, 1, 24) as title, text from conversations where text is not null), w as (select conv_id, min_by(title, turn) as title, min_by(text, turn) as text from e group by conv_id),
r as (select conv_id, substr(title, 1, 10 + conv_id % 10) || ' — notes' as source, case when conv_id % 2 = 0 then replace(text, ' ', '  ') else substr(text, 1, 60) end as claim from w),
s as (select e.conv_id, turn, text, claim, lower(regexp_replace(split_part(source, ' — ', 1), '^\s+|\s+$', '', 'g')) as name, lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) as own from e join r on e.conv_id = r.conv_id),
k as (select *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') as a, list_filter(string_split_regex(claim, '\s+'), lambda w: w <> '') as b from s where name <> '' and own <> '' and (name = own or length(name) >= 12 and (starts_with(own, name) or starts_with(name, own)))),
c as (select conv_id, turn, a, b, list_distinct(list_transform(a, lambda w: lower(w))) as x, list_distinct(list_transform(b, lambda w: lower(w))) as y from k),
d as (select conv_id, turn, case when array_to_string(a, ' ') = array_to_string(b, ' ') then 2.0::double when len(x) + len(y) = 0 then 0.0 else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end as score from c),
o as (select *, row_number() over (partition by conv_id order by round(score, 9) desc, turn) as n from d) select conv_id, turn, round(score, 6) as score from o where n = 1""")
def j17_loose_sources(spark, sf_dir):
    """The passage behind one claim a conversation, its source named by a title cut short; every other claim is whole but for white space."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.substring("text", 1, 24).alias("title"), "text")
    first = rows.groupBy("conv_id").agg(F.min_by("title", "turn").alias("title"), F.min_by("text", "turn").alias("text"))
    source = F.concat(F.substring("title", F.lit(1), (10 + F.col("conv_id") % 10).cast("int")), F.lit(" — notes"))
    claim = F.when(F.col("conv_id") % 2 == 0, F.replace(F.col("text"), F.lit(" "), F.lit("  "))).otherwise(F.substring("text", 1, 60))
    found = references.evidence(rows, first.select("conv_id", source.alias("source"), claim.alias("claim")), "conv_id", "turn")
    return found.select("conv_id", "turn", F.round("score", 6).alias("score"))


_SCALE = "['public', 'internal', 'secret', 'top']"


@query(f"""with d as (select distinct conv_id, greatest(list_position({_SCALE}, ['public', 'internal', 'secret', 'odd', null][conv_id % 5 + 1]), 1) as own from conversations),
p as (select conv_id, max(list_position({_SCALE}, case length(text) % 7 when 0 then 'top' when 1 then 'secret' when 2 then 'unheard of' when 3 then 'internal' end)) as mark from conversations group by conv_id),
h as (select conv_id, greatest(coalesce(own, 1), coalesce(nullif(mark, 0), 1)) as place from d join p using (conv_id)) select conv_id, {_SCALE}[place] as highest, place <= 3 as kept from h""")
def p15_ceiling_split(spark, sf_dir):
    """Volumes that a ceiling keeps and those above it, each at the highest of its own level and its passages' marks; levels and marks are dealt by id and length."""
    rows = table(spark, sf_dir, "conversations")
    level = F.element_at(F.array(*(F.lit(x) for x in ("public", "internal", "secret", "odd", None))), (F.col("conv_id") % 5 + 1).cast("int"))
    turn = F.length("text") % 7
    mark = F.when(turn == 0, "top").when(turn == 1, "secret").when(turn == 2, "unheard of").when(turn == 3, "internal")
    return classify.within(rows.select("conv_id", level.alias("level")), rows.select("conv_id", mark.alias("portion")), "secret", "conv_id")


@query(f"""with o as (select p_partkey, regexp_extract(p_brand, '[0-9]+')::int as b, case p_partkey % 4 when 0 then 'local' when 1 then 'any' when 2 then '' end as clearance from part),
q as (select * from (values ('remote', 2, true), ('trusted', 2, false), ('open', 4, true)) t(question, top, remote))
select p_partkey, question, case when b % 4 + 1 > top then 'level' when remote and (clearance = 'local' or (coalesce(clearance, '') = '' and b % 2 = 0)) then 'local' end as held from o, q""")
def c8_cleared_operations(spark, sf_dir):
    """The operations of modules that three questions may use: under a ceiling with a remote model, with trusted ones, and a remote one without a ceiling."""
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    clearance = F.when(F.col("p_partkey") % 4 == 0, "local").when(F.col("p_partkey") % 4 == 1, "any").when(F.col("p_partkey") % 4 == 2, "")
    rows = table(spark, sf_dir, "part").select("p_partkey", classify.level_at(brand % 4).alias("level"), (brand % 2 == 0).alias("local_only"), clearance.alias("clearance"))
    asked = [("remote", "internal", True), ("trusted", "internal", False), ("open", None, True)]
    parts = [classify.cleared(rows, ceiling, remote).select("p_partkey", F.lit(name).alias("question"), "held") for name, ceiling, remote in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with d as (select doc_id, coalesce(source, '') as source, row_number() over (partition by coalesce(source, '') order by md5(doc_id || ':7'), doc_id) as turn from documents where n_chars >= 200)
select doc_id, source, turn::int as turn from d order by turn, source limit 100""")
def w13_seeded_sample(spark, sf_dir):
    """A hundred documents of some length, one a source in turn, in an order that a seed shuffles within each source."""
    docs = table(spark, sf_dir, "documents").where("n_chars >= 200").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    shuffled = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("7")))
    # of no source more than a hundred can be taken, so each task passes on its first hundred
    turns = ranking.top_per_group(docs, ["source"], [shuffled.asc(), F.asc("doc_id")], 100, "turn")
    return turns.orderBy("turn", "source").limit(100).select("doc_id", "source", "turn")


@query(r"""with b as (select conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') as body, case when turn % 4 = 1 then regexp_replace(substr(text, 1, 30), '^\s+|\s+$', '', 'g') end as note from conversations)
select conv_id, turn, '[' || (turn + 1) || '] ' || coalesce(role, '') || ', p.' || turn || case when turn % 3 = 0 then '' else ' — part ' || (turn % 3) end || chr(10)
|| case when length(coalesce(body, '')) <= 80 then coalesce(body, '') else regexp_replace(substr(body, 1, 80), ' [^ ]*$', '') || ' …' end || case when coalesce(note, '') <> '' then chr(10) || '(the library''s note on this passage: ' || note || ')' else '' end as block from b""")
def t34_passage_blocks(spark, sf_dir):
    """Numbered passages as a model reads them, cut at a word, with the notes on some of them."""
    section = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("part "), (F.col("turn") % 3).cast("string")))
    note = F.when(F.col("turn") % 4 == 1, F.substring("text", 1, 30))
    block = tx.passage_block(F.col("turn") + 1, F.col("role"), F.col("text"), 80, section, F.col("turn"), note)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("block"))


@query("""with t as (select distinct p_type as name from part), b as (select p_brand as name, min(p_type) as parent from part group by 1),
a as (select p_partkey as volume, case when p_partkey % 5 = 0 then 'Nowhere' else p_type end as top, case when p_partkey % 4 = 0 then '(a new sub-shelf)' when p_partkey % 7 = 0 then p_type else p_brand end as sub,
case p_partkey % 16 when 0 then 'ab' when 4 then lower(p_type) when 8 then lower(p_brand) else p_name end as new_name from part),
m as (select a.*, t.name as held_top, b.parent as under, k.name as key_name, k.parent as key_parent, c.name as clash from a left join t on t.name = top left join b on b.name = sub left join b k on lower(k.name) = new_name left join t c on lower(c.name) = new_name),
w as (select *, case when sub <> '(a new sub-shelf)' then case when under is not null and (held_top is null or held_top = under) then 'chosen' end
when held_top is not null and length(new_name) between 3 and 40 and clash is null then case when key_name is null then 'new' when key_parent = held_top then 'own' end end as way from m)
select volume, case way when 'chosen' then sub when 'own' then key_name when 'new' then new_name end as shelf, case way when 'chosen' then under when 'own' then held_top when 'new' then held_top end as parent,
case when way in ('chosen', 'own') then 'there' when way = 'new' then 'new' else 'unresolved' end as how from w""")
def m12_placements(spark, sf_dir):
    """Where answers put volumes among the shelves; types are tops and brands sub-shelves here, and some answers name what isn't there."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    tops = part.select(F.col("p_type").alias("name"), F.lit(None).cast("string").alias("parent")).distinct()
    tree = tops.unionByName(part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("parent")))
    top = F.when(key % 5 == 0, "Nowhere").otherwise(F.col("p_type"))
    sub = F.when(key % 4 == 0, shelving.NEW).when(key % 7 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    new = F.when(key % 16 == 0, "ab").when(key % 16 == 4, F.lower("p_type")).when(key % 16 == 8, F.lower("p_brand")).otherwise(F.col("p_name"))
    return shelving.placements(part.select(key.alias("volume"), top.alias("top"), sub.alias("sub"), new.alias("new_name")), tree)
