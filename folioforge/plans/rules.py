"""Rules over the tables' own texts: terms, titles, labels, citations, levels, messages, commands, quotes, references, parameters.

The SQL states each rule anew. The tables hold no citations, so some queries put numbers or marks at places that the text itself gives.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import guards, params
from folioforge.functions import text as tx
from folioforge.operators import classify, references, relational
from folioforge.plans.registry import query
from folioforge.sources import html as html_source
from folioforge.tables import table

_QUOTED = tx._QUOTED
_WORDISH = tx._WORDISH
_PAGE_TITLE = r"(?is)<title[^>]*>([^<]*)</title>"


def _literal_sql(rows: str) -> str:
    """SQL of literal terms over ``rows`` (key, q)."""
    word = (
        r"length(t) >= 3 and (regexp_matches(t, '^--|^-\p{L}|\p{L}.*\p{N}|\p{N}.*\p{L}|[\p{L}\p{N}_][_./:#][\p{L}\p{N}_]|[a-z].*[A-Z]|^.+[A-Z].*[a-z]|^[a-z]*[A-Z][A-Z]+[a-z]')"
        r" or (short and regexp_matches(t, '^\p{Lu}+$')))"
    )
    return rf"""t as (select key, q, list_transform(regexp_extract_all(q, '{_QUOTED}'), lambda x: trim(substr(x, 2, length(x) - 2))) as quoted, regexp_extract_all(regexp_replace(q, '{_QUOTED}', ' ', 'g'), '{_WORDISH}') as raw, len(regexp_extract_all(q, '{_WORDISH}')) <= 3 as short from ({rows})),
u as (select key, short, unnest(raw) as r, generate_subscripts(raw, 1) as i from t), b as (select *, regexp_replace(r, '^[.,;:!?()\[\]{{}}''"]+|[.,;:!?()\[\]{{}}''"]+$', '', 'g') as t from u),
a as (select *, coalesce(lead(r) over (partition by key order by i), '') as after from b),
n as (select key, list(case when regexp_matches(t, '^\p{{Lu}}{{2,}}$') and regexp_matches(after, '^\p{{N}}+$') then t || ' ' || after when {word} then t end order by i) as named, list(t order by i) as bare from a group by key),
f as (select t.key, list_filter(t.quoted || coalesce(n.named, []), lambda x: x is not null and x <> '') as found, len(raw) as size, n.bare from t left join n on n.key = t.key)
select f.key, case when len(found) = 0 and size = 1 then list_filter(bare, lambda x: length(x) >= 3) else list_transform(list_sort(list_transform(list_distinct(found), lambda x: {{'p': list_position(found, x), 'x': x}})), lambda s: s.x) end as terms from f"""


@query("with " + _literal_sql("select page_id as key, " + f"regexp_extract(html, '{_PAGE_TITLE}', 1) as q from pages").replace("{{", "{").replace("}}", "}"))
def p6_title_terms(spark, sf_dir):
    """What pages' titles name exactly, as a question would."""
    title = F.regexp_extract("html", _PAGE_TITLE, 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), tx.literal_terms(title).alias("terms"))


_USABLE = r"""length(trim(t)) >= 6 and not regexp_matches(trim(t), '(?i)^(tmp[a-z0-9_]{4,}|[0-9a-f]{8,}|.+\.(pdf|docx?|tex|dvi|txt|md|html?))$') and not regexp_matches(trim(t), '(?i)^(untitled|document|unknown|no title|title|microsoft word)\b.{0,12}$')"""


@query(f"with l as (select doc_id, string_split(text, chr(10))[1] as t from documents) select doc_id, coalesce({_USABLE}, false) as usable from l")
def t3_first_lines(spark, sf_dir):
    """Whether a text's first line can be its title."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.usable_title(F.substring_index("text", "\n", 1)).alias("usable"))


@query(r"""select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '~~(.+?)~~', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\s+', ' ', 'g'))) as label from pages""")
def t25_page_labels(spark, sf_dir):
    """Whole pages as labels, without tags, emphasis and code marks; their digests."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(guards.plain_label(F.col("html"))).alias("label"))


# every line of a text cites the numbers 1 to its length modulo 5, after its first word
_CITING = r"""d as (select doc_id, string_split(text, chr(10)) as ls from documents), e as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from d),
c as (select doc_id, i, case when i % 4 = 0 then '- ' when i % 7 = 0 then '# ' else '' end || case when length(l) % 5 = 0 then l else regexp_replace(l, '^[^ ]*', '\0 [' || (length(l) % 5) || ', ' || (length(l) % 3 + 1) || ']') end as l from e)"""


def _citing(spark, sf_dir):
    """Documents whose lines cite two numbers by their length after the first word; every fourth line is a list's, every seventh a heading."""
    n = lambda x: F.length(x)
    front = lambda i: F.when((i + 1) % 4 == 0, "- ").when((i + 1) % 7 == 0, "# ").otherwise("")

    def cite(line):
        mark = F.concat(F.regexp_extract(line, "^[^ ]*", 0), F.lit(" ["), (n(line) % 5).cast("string"), F.lit(", "), (n(line) % 3 + 1).cast("string"), F.lit("]"))
        return F.when(n(line) % 5 == 0, line).otherwise(F.concat(mark, F.regexp_replace(line, "^[^ ]*", "")))

    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(front(i), cite(x)))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))


@query(rf"""with {_CITING}, s as (select doc_id, i, regexp_extract(l, '\[(\d+(?:\s*,\s*\d+)*)\]', 1) as g, l from c),
v as (select doc_id, i, case when g = '' then l else replace(l, '[' || g || ']', (select case when len(k) = 0 then '' else '[' || array_to_string(k, ', ') || ']' end from (select list_filter(string_split_regex(g, '\s*,\s*'), lambda x: try_cast(x as int) between 1 and 2) as k))) end as l from s),
j as (select doc_id, string_agg(l, chr(10) order by i) as t from v group by doc_id)
select doc_id, md5(trim(regexp_replace(regexp_replace(t, ' +([.,;:]|$)', '\1', 'g'), ' +', ' ', 'g'))) as text from j""")
def t26_cited_texts(spark, sf_dir):
    """Whole texts with the citations taken out that name none of two sources; their digests."""
    rows = _citing(spark, sf_dir)
    return rows.select("doc_id", F.md5(guards.valid_citations(F.array_join("lines", "\n"), 2)).alias("text"))


_NUMBERS = r"list_transform(string_split_regex(regexp_extract(l, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), '\s*,\s*'), lambda x: try_cast(x as int))"


@query(rf"""with {_CITING}, n as (select doc_id, i, l, list_filter({_NUMBERS}, lambda x: x between 1 and 3) as ns from c where trim(l) <> '' and trim(l) <> '-' and trim(l) <> '#'),
r as (select *, case when len(ns) > 0 then list_max(list_transform(ns, lambda x: (doc_id + x) % 4)) else 2 end as rank from n),
o as (select *, not starts_with(l, '#') as counts, case when starts_with(l, '#') then l when starts_with(l, '- ') then '- (' || ['U', 'I', 'S', 'TS'][rank + 1] || ') ' || substr(l, 3) else '(' || ['U', 'I', 'S', 'TS'][rank + 1] || ') ' || ltrim(l) end as m from r)
select doc_id, md5(string_agg(m, chr(10) || chr(10) order by i)) as marked, ['public', 'internal', 'secret', 'top'][coalesce(max(rank) filter (counts), 0) + 1] as banner from o group by doc_id""")
def c7_marked_texts(spark, sf_dir):
    """A portion mark before each paragraph and list item, by the sources it cites, and the whole text's banner; digests of the marked texts."""
    sources = F.map_from_arrays(F.array(*map(F.lit, (1, 2, 3))), F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: classify.level_at(((F.col("doc_id") + n) % 4).cast("int"))))
    rows = _citing(spark, sf_dir).select("doc_id", F.array_join("lines", "\n\n").alias("text"), sources.alias("sources"), F.lit("secret").alias("context"))
    return classify.marked_output(rows).where("marked <> ''").select("doc_id", F.md5("marked").alias("marked"), "banner")


@query(r"""select page_id, md5(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<id>', 'g'), '/[A-Za-z0-9_./-]+', '<path>', 'g'), '''[^'']{0,80}''', '''…''', 'g'), '[0-9]+', 'N', 'g'), 1, 400)) as html_key,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<id>', 'g'), '/[A-Za-z0-9_./-]+', '<path>', 'g'), '''[^'']{0,80}''', '''…''', 'g'), '[0-9]+', 'N', 'g') as url_key from pages""")
def t31_page_keys(spark, sf_dir):
    """Pages and their addresses as messages, without ids, paths, quoted parts and numbers."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.incident_key(F.col("html"))).alias("html_key"), tx.incident_key(F.col("url")).alias("url_key"))


_SECRET = r"(?i)(api[_-]?key|token|password|secret)\s*[=:]\s*\S+"


@query(rf"""with m as (select page_id, replace(replace(url, 'ref=', 'token='), '://', '://h/home/') as u, html from pages)
select page_id, regexp_replace(regexp_replace(regexp_replace(u, '/Users/[^/\s]+', '~', 'g'), '/home/[^/\s]+', '~', 'g'), '{_SECRET}', '\1=<redacted>', 'g') as url,
md5(regexp_replace(regexp_replace(regexp_replace(html, '/Users/[^/\s]+', '~', 'g'), '/home/[^/\s]+', '~', 'g'), '{_SECRET}', '\1=<redacted>', 'g')) as html from m""")
def t36_page_scrub(spark, sf_dir):
    """Home folders and secrets out of whole pages and of addresses whose hosts stand for users, their ref for a token."""
    url = F.replace(F.replace("url", F.lit("ref="), F.lit("token=")), F.lit("://"), F.lit("://h/home/"))
    return table(spark, sf_dir, "pages").select("page_id", tx.scrub(url).alias("url"), F.md5(tx.scrub(F.col("html"))).alias("html"))


_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@query(rf"""with k as (select distinct {_WORDS.format("s")} as w from (select unnest(string_split(text, '.')) as s from documents)), d as (select distinct w[1:2] as two, w[3] as third from k where len(w) > 0),
c as (select doc_id, {_WORDS.format("string_split(text, chr(10))[1]")} as w from documents)
select doc_id, len(w) > 0 and (coalesce(w[1] in ('The', 'Is'), false) or exists (select 1 from d where d.two = c.w[1:2] and (d.third is null or c.w[3] is null or d.third = c.w[3] or not (starts_with(d.third, '-') or starts_with(c.w[3], '-'))))) as known from c""")
def p23_known_openings(spark, sf_dir):
    """Whether a text's first line, as a command, is borne out by the sentences of all texts; a join by two words, not a list of all that is known."""
    docs = table(spark, sf_dir, "documents")
    said = docs.select(F.explode(F.split("text", r"\.")).alias("command"))
    asked = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("command"))
    return relational.borne_out(asked, said, ["The", "Is"]).select("doc_id", "known")


@query(r"""with g as (select conv_id, lower(string_agg(text, chr(10) order by turn)) as held from conversations where turn % 2 = 0 group by conv_id),
q as (select conv_id, turn, trim(regexp_replace('[' || role || '] ' || case when turn % 3 = 0 then lower(text) else text end, '^\s*\[[^\]]*\]\s*', '')) as bare from conversations)
select q.conv_id, turn, case when bare <> '' and contains(coalesce(held, ''), lower(substr(bare, 1, 60))) then bare else '' end as quoted from q left join g on g.conv_id = q.conv_id""")
def p25_quoted_turns(spark, sf_dir):
    """P25: each turn, with its role as a title in front, kept where its first 60 characters stand in the conversation's even turns."""
    rows = table(spark, sf_dir, "conversations")
    given = rows.where("turn % 2 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    claim = F.concat(F.lit("["), "role", F.lit("] "), F.when(F.col("turn") % 3 == 0, F.lower("text")).otherwise(F.col("text")))
    return rows.join(given, "conv_id", "left").select("conv_id", "turn", guards.quoted(claim, F.coalesce(F.col("said.text"), F.array().cast("array<string>"))).alias("quoted"))


@query(r"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), n as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from l), m as (select doc_id, i, '[' || (i % 200 + 1) || '] A' || l || case when i % 3 = 0 then ' doi:10.' || (1000 + i) || '/' || regexp_replace(l, '[^A-Za-z]+', '', 'g') else '' end as e from n where i <= 300),
t as (select doc_id, i, trim(regexp_replace(regexp_replace(e, '^\[\d+\]\s+', ''), '\s+', ' ', 'g')) as entry from m), c as (select doc_id, count(*) as k from n group by doc_id)
select t.doc_id, i::int as pos, entry, nullif(regexp_extract(entry, '\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b'), '') as doi from t join c on c.doc_id = t.doc_id where k >= 3 and length(entry) between 20 and 600""")
def t22_line_references(spark, sf_dir):
    """Entries of the reference list that a text's own lines make, a third of them with an identifier of their letters."""
    letters = lambda x: F.regexp_replace(x, "[^A-Za-z]+", "")
    doi = lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit(" doi:10."), (1001 + i).cast("string"), F.lit("/"), letters(x))).otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), ((i + 1) % 200 + 1).cast("string"), F.lit("] A"), x, doi(x, i)))
    body = F.concat(F.lit("Text [1] before.\nReferences\n[9] Old\n3. References \n"), F.array_join(lines, "\n"))
    return references.entries(table(spark, sf_dir, "documents").select("doc_id", body.alias("text")))


@query(r"""with p as (select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) as t, regexp_extract(url, '://([^/?#]*)', 1) as h from pages), l as (select page_id, [t, h, t, 'Ed ' || (page_id % 3)] as a from p),
f as (select page_id, list_filter(list_transform(a, lambda x: trim(x)), lambda x: x <> '') as a from l)
select page_id, list_transform(list_sort(list_transform(list_distinct(a), lambda x: {'p': list_position(a, x), 'x': x})), lambda s: s.x) as authors from f""")
def s10_page_bylines(spark, sf_dir):
    """A byline of the page's own title and host, each author once and in order; it is put before the page, whose other elements name none."""
    name = F.trim(F.regexp_extract("html", _PAGE_TITLE, 1))
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    one = lambda kind, x: F.concat(F.lit(f'<p><span class="{kind}"> <i>'), x, F.lit("</i></span></p>"))
    page = F.concat(one("author", name), one("url author", host), one("editor", name), one("lead editor", F.concat(F.lit("Ed "), (F.col("page_id") % 3).cast("string"))), "html")
    return table(spark, sf_dir, "pages").select("page_id", html_source.authors(page).alias("authors"))


@query(r"""with v as (select event_id, nullif(trim(user_id::varchar), '') as t, props ->> '$.k' as k, event_type as c from events)
select event_id, case when try_cast(k as integer) is null then case when k is null then 'missing' else 'not a integer' end when k::integer < 10 then 'too small' when k::integer > 60 then 'too large' end as number_error,
case when c not in ('click', 'view') then 'not a choice' end as colour_error, case when not regexp_matches(t, '^(?:[1-4][0-9]?)$') then 'wrong form' end as code_error from v""")
def p28_event_parameters(spark, sf_dir):
    """§2.8 parameter check: every event's field, kind and user as values of a number, a choice and a pattern."""
    number = params.checked(F.get_json_object("props", "$.k"), "integer", least=10, most=60, required=True)
    colour = params.checked(F.col("event_type"), "string", choices=["click", "view"])
    code = params.checked(F.col("user_id").cast("string"), "string", pattern="[1-4][0-9]?")
    return table(spark, sf_dir, "events").select("event_id", *(c["error"].alias(f"{n}_error") for c, n in ((number, "number"), (colour, "colour"), (code, "code"))))


@query(r"""select conv_id, turn, coalesce(regexp_matches(trim(v), '(?i)^[.…\s]*$|^(string|text|summary|todo|n/a)$|^(the |a |your )?(theme|topic|document|section)?\s*(name|label|title|summary)( here| goes here)?\.?$'), false) as placeholder
from (select conv_id, turn, unnest(regexp_split_to_array(text, '[.,\n]+')) as v from conversations)""")
def p17_clauses(spark, sf_dir):
    """Which clauses of the turns are placeholders; those before an ending mark are blank."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"[.,\n]+")).alias("v"))
    return rows.select("conv_id", "turn", F.coalesce(guards.is_placeholder(F.col("v")), F.lit(False)).alias("placeholder"))
