"""Queries of what goes out and comes back: review packets and paged answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import reviews
from folioforge.plans.registry import query
from folioforge.session import materialise
from folioforge.sources import manifests, paging, records
from folioforge.tables import table

_CASES = r"""k as (select conv_id * 1000 + turn as case_id, conv_id, text as question, role from conversations where role = 'user'),
c as (select * from (select *, row_number() over (partition by lower(regexp_replace(question, '^\s+|\s+$', '', 'g')) order by case_id) as n from k) where n = 1),
s as (select case_id, question, conv_id, unnest(range(6)) as spot from c where case_id % 3 <> 0 and question is not null),
h as (select s.*, 'P' || row_number() over (partition by s.case_id order by spot) as label, p.conv_id * 1000 + p.turn as chunk_id, p.text as body, row_number() over (partition by s.case_id order by spot) as nth
from s join conversations p on p.conv_id * 1000 + p.turn = s.conv_id * 1000 + spot),
i as (select substr(sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::blob || encode(question)), 1, 12) as id, case_id, question, label, nth, chunk_id, substr(trim(regexp_replace(coalesce(body, ''), '\s+', ' ', 'g')), 1, 2000) as text from h)"""


def _cases(spark, sf_dir):
    """Users' questions as judged cases (a third by the owner, the others by a model), each question once, and the turns as passages."""
    turns = table(spark, sf_dir, "conversations").withColumn("chunk_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = turns.where("role = 'user'").select(F.col("chunk_id").alias("case_id"), F.col("text").alias("question"), F.lit("ask").alias("source"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("conv_id") * 1000 + i).alias("pooled"))
    once = Window.partitionBy(reviews.same_question(F.col("question"))).orderBy("case_id")
    judge = F.when(F.col("case_id") % 3 == 0, "human").otherwise("model")
    cases = asked.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").withColumns({"judge": judge, "model_marks": F.concat(F.lit("m"), F.col("case_id").cast("string"))})
    return cases, turns.select("chunk_id", F.col("role").alias("title"), "text")


@query(f"with {_CASES} select id, label, chunk_id, text from i")
def m19_review_packet(spark, sf_dir):
    """Questions that a model judged, with the passages it was shown and none of its marks."""
    return reviews.packet(*_cases(spark, sf_dir)).select("id", "label", "chunk_id", "text")


_ANSWERS = f"""with {_CASES}, a as (select case_id, id, question, case when case_id % 11 = 0 then 'nothing' else id end as named, ['P1', 'P' || (case_id % 9)] as supporting, ['P1', 'P2'] as distractors,
case case_id % 4 when 0 then 'mechanism' when 1 then 'odd' when 2 then 'conflict' end as type, case_id % 5 = 0 as unanswerable, list(chunk_id order by nth) as pooled from i group by all),
v as (select *, list_transform(list_filter(supporting, lambda x: substr(x, 2)::int between 1 and len(pooled)), lambda x: pooled[substr(x, 2)::int]) as sup, list_transform(list_filter(distractors, lambda x: substr(x, 2)::int between 1 and len(pooled)), lambda x: pooled[substr(x, 2)::int]) as dis from a where named <> 'nothing'),
w as (select *, unanswerable or len(sup) = 0 as none, case_id % 7 = 0 as owner, 4 - len(sup) - len(dis) as bad from v)"""


def _answered(spark, sf_dir):
    """A reviewer's answers to the packet, made from its ids: labels beyond the pool, unknown items and kinds among them; the owner has judged a seventh since."""
    cases, passages = _cases(spark, sf_dir)
    items = reviews.packet(cases, passages)
    case = F.col("case_id")
    answers = cases.where("judge = 'model' and question is not null").select(
        case.alias("place"), F.when(case % 11 == 0, "nothing").otherwise(reviews.item_id(F.col("question"))).alias("id"),
        F.when(case % 4 == 0, "mechanism").when(case % 4 == 1, "odd").when(case % 4 == 2, "conflict").alias("type"), (case % 5 == 0).alias("unanswerable"),
        F.array(F.lit("P1"), F.concat(F.lit("P"), (case % 9).cast("string"))).alias("supporting"), F.array(F.lit("P1"), F.lit("P2")).alias("distractors"), F.lit(None).cast("string").alias("notes"),
    )
    since = cases.withColumn("judge", F.when(case % 7 == 0, "human").otherwise(F.col("judge")))
    return reviews.answered(answers, items, since, "Model")


@query(f"""{_ANSWERS} select id, case when none then 'unanswerable' when type in ('mechanism', 'conflict') then type else 'concept' end as type, case when none then [] else sup end as supporting,
case when none then dis else list_filter(dis, lambda x: not list_contains(sup, x)) end as distractors, 'model-reviewer' as judge, pooled, 'm' || case_id as model_marks, case_id as replaces from w where not owner""")
def m19_review_import(spark, sf_dir):
    """A reviewer's answers as cases, labels mapped back to passages; the owner's own judgements stand."""
    return reviews.saved_cases(_answered(spark, sf_dir)).select("id", "type", "supporting", "distractors", "judge", "pooled", "model_marks", "replaces")


@query(f"""{_ANSWERS} select (select count(*) from w where not owner) as saved, (select count(*) from a) - (select count(*) from w where not owner) as skipped, (select coalesce(sum(bad), 0)::bigint from w) as unknown_labels""")
def m19_review_tally(spark, sf_dir):
    """How many answers were saved and skipped, and labels that no item has."""
    return reviews.tally(_answered(spark, sf_dir))


def _answers(spark, sf_dir, size):
    """Customers as endpoints, their orders as pages of ``size`` rows with the next page's cursor; stored answers, one after the last full page."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), "o_orderkey")
    place = F.row_number().over(Window.partitionBy("key").orderBy("o_orderkey")) - 1
    pages = orders.withColumn("at", F.floor(place / size)).groupBy("key", "at").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    last = Window.partitionBy("key")
    pages = pages.withColumn("last", F.max("at").over(last))
    return materialise(pages.withColumn("body", F.to_json(F.struct(F.struct(F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("items")).alias("data"), F.when(F.col("at") < F.col("last"), F.concat(F.lit("c"), (F.col("at") + 1).cast("string"))).alias("next")))), "answers")


def _endpoints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")).distinct().withColumn("url", F.concat(F.lit("http://orders.invalid/"), "key"))


_LISTED = "l as (select o_custkey::varchar as key, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place from orders)"


@query(f"with {_LISTED} select key, (place // 3 + 1)::int as page, id from l where place < 9")
def s16_paged_rows(spark, sf_dir):
    """Numbered pages of three rows from every endpoint until eight rows are had; the answers are stored ones, made from the orders."""
    held = _answers(spark, sf_dir, 3).select("key", (F.col("at") + 1).cast("string").alias("token"), "body", F.lit(None).cast("string").alias("link"))
    got = paging.calls(_endpoints(spark, sf_dir), paging.stored(held), "page", "data.items", limit=8, size=3)
    return paging.rows(got, "data.items").select("key", "page", records.dig(F.col("row"), "id").cast("bigint").alias("id"))


@query(f"with {_LISTED} select key, (place // 4 + 1)::int as page, min(id) as first, count(*)::int as n from l where place < 20 group by 1, 2")
def s16_cursor_pages(spark, sf_dir):
    """Pages of four rows by the cursor that each answer names, five at most."""
    held = _answers(spark, sf_dir, 4).select("key", F.when(F.col("at") > 0, F.concat(F.lit("c"), F.col("at").cast("string"))).alias("token"), "body", F.lit(None).cast("string").alias("link"))
    got = paging.calls(_endpoints(spark, sf_dir), paging.stored(held), "cursor", "data.items", limit=1000, pages=5, cursor_path="next")
    return got.select("key", "page", records.dig(F.col("body"), "data.items[0].id").cast("bigint").alias("first"), "n")


_ADDRESS = r"a as (select page_id, split_part(url, '#', 1) as u from pages), p as (select page_id, regexp_extract(u, '^https?://[^/?]*', 0) as base_url, regexp_extract(u, '^https?://[^/?]*([^?]*)', 1) as path, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '') as q from a)"


@query(rf"""with {_ADDRESS} select page_id, case when page_id % 5 = 4 then null else base_url end as base_url, case when page_id % 5 = 4 then null else coalesce(nullif(trim(regexp_replace(lower(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$', 0)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'query') end as id,
case page_id % 5 when 4 then null when 2 then 'POST' else 'GET' end as method, case when page_id % 5 = 4 then null else coalesce(nullif(path, ''), '/') end as path,
case when page_id % 5 = 4 then null else list_transform(q, lambda x: split_part(x, '=', 1) || ':' || case when regexp_matches(split_part(x, '=', 2), '^[0-9]+$') then 'int' else 'string' end || ':' || split_part(x, '=', 2)) end as params,
case page_id % 5 when 0 then 'none' when 1 then 'bearer' when 2 then 'basic' when 3 then 'query' end as auth, case when page_id % 5 = 4 then 'changes data' end as refused from p""")
def s19_curl_drafts(spark, sf_dir):
    """A draft of an operation for every page's address as a curl command, with credentials of several kinds, a fifth of them deleting."""
    url = F.regexp_replace("url", "#.*$", "")
    keyed = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("api_key=k1"))
    forms = (
        F.concat(F.lit("curl "), F.lit("'"), url, F.lit("' -H 'Accept: x'")), F.concat(F.lit('curl -s -H "Authorization: Bearer abc" --url "'), url, F.lit('"')),
        F.concat(F.lit("curl -u me:pw --data '{\"a\": 1}' \\\n '"), url, F.lit("'")), F.concat(F.lit("curl '"), keyed, F.lit("'")), F.concat(F.lit("curl -X delete '"), url, F.lit("'")),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % 5 + 1).cast("int")).alias("command"))
    return manifests.from_curl(rows, "page_id", "command").withColumn("params", F.transform("params", lambda p: F.concat_ws(":", p["key"], p["type"], p["default"])))


@query(rf"""with {_ADDRESS}, o as (select page_id, base_url || '/v1' as base_url, path, unnest(['GET', 'POST']) as method, list_filter(list_transform(q, lambda x: split_part(x, '=', 1)), lambda k: k <> 'token') as q from p)
select page_id, base_url, case method when 'GET' then 'read_' || page_id else trim(regexp_replace(lower('post_' || path), '[^a-z0-9]+', '_', 'g'), '_') end as id, method, path, case method when 'GET' then list_transform(q, lambda k: k || ':int:false') || ['lang:string:true'] else ['lang:string:true'] end as params from o""")
def s19_openapi_drafts(spark, sf_dir):
    """The reading operations of an OpenAPI document for every page's address, its query's names as parameters; one that deletes, and credentials, are left out."""
    url = F.regexp_replace("url", "#.*$", "")
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))
    number, word = F.lit("integer"), F.lit("string")
    param = lambda k, where, kind: F.struct(k.alias("name"), F.lit(where).alias("in"), F.struct(kind.alias("type")).alias("schema"))
    own = F.concat(F.transform(keys, lambda k: param(k, "query", number)), F.array(param(F.lit("token"), "query", word)), F.array(param(F.lit("X-A"), "header", word)))
    verbs = F.struct(
        F.struct(F.concat(F.lit("read "), F.col("page_id").cast("string")).alias("operationId"), own.alias("parameters")).alias("get"), F.struct(F.lit("s").alias("summary")).alias("post"),
        F.struct(F.lit("gone").alias("operationId")).alias("delete"), F.array(param(F.lit("lang"), "path", word)).alias("parameters"),
    )
    path = F.regexp_extract(url, "^https?://[^/?]*([^?]*)", 1)
    spec = F.to_json(F.struct(F.array(F.struct(F.concat(F.regexp_extract(url, "^https?://[^/?]*", 0), F.lit("/v1/")).alias("url"))).alias("servers"), F.create_map(path, verbs).alias("paths")))
    drafts = manifests.from_openapi(table(spark, sf_dir, "pages").select("page_id", spec.alias("spec")), "page_id", "spec")
    return drafts.withColumn("params", F.transform("params", lambda p: F.concat_ws(":", p["key"], p["type"], p["required"].cast("string")))).drop("summary")
