"""Text queries: sources, clean-up, structure, spans, markings, references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import chunking, classify, references
from folioforge.plans.registry import query
from folioforge.sources import html as html_source
from folioforge.sources import records
from folioforge.tables import table

_COLLAPSE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(r"""with l as (select doc_id, text, list_filter(string_split(substr(text, 1, 6000), chr(10)), lambda x: trim(x) <> '') as lines from documents),
s as (select doc_id, strlen(text) as bytes, len(lines) as n, list_sum(list_transform(lines, lambda x: length(x))) as chars, len(list_filter(lines, lambda x: contains(trim(x), ' '))) as spaced,
  array_to_string(lines, '') as body from l)
select doc_id, bytes >= 200 and (n < 12 or ((chars::double / n >= 40 or spaced::double / n >= 0.6) and length(regexp_replace(body, '[A-Za-z0-9\sÀ-ÿ]', '', 'g')) < 0.12 * length(body))) as prose from s""")
def s3_prose_gate(spark, sf_dir):
    """Reading matter told from word lists by its lines and symbols."""
    return records.prose_gate(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"""with h as (select page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) as h1, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)
select page_id, case when trim(h1) <> '' then trim(h1) else trim(title) end as page_title from h""")
def s9_page_title(spark, sf_dir):
    """A page's heading, else its title."""
    return html_source.titles(table(spark, sf_dir, "pages"))


@query()
def s8_html_markdown(spark, sf_dir):
    """Pages as Markdown with headings, lists and code kept and page furniture left out."""
    return html_source.to_markdown(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(r"""with r as (select event_id, cast(props as json) as j from events)
select event_id, json_keys(j)[1] as first_key, json_extract_string(j, '$.' || json_keys(j)[1]) as first_value from r""")
def s17_json_rows(spark, sf_dir):
    """Fields dug out of JSON records by path."""
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    key = F.element_at(F.json_object_keys("props"), 1)
    return rows.select("event_id", key.alias("first_key"), F.element_at(F.from_json("props", "map<string,string>"), key).alias("first_value"))


@query(r"""with k as (select conv_id, turn, regexp_replace(lower(trim(string_split(text, chr(10))[1])), '[0-9]', '#', 'g') as first, regexp_replace(lower(trim(string_split(text, chr(10))[-1])), '[0-9]', '#', 'g') as last, count(*) over (partition by conv_id) as pages from conversations),
e as (select conv_id, turn, pages, first as key from k union all select conv_id, turn, pages, last from k where last <> first),
r as (select conv_id, key from e where key <> '' and length(key) < 80 group by conv_id, key having max(pages) >= 4 and count(*) >= 0.5 * max(pages))
select k.conv_id, turn, f.key is not null as head, l.key is not null as foot from k left join r f on f.conv_id = k.conv_id and f.key = k.first left join r l on l.conv_id = k.conv_id and l.key = k.last""")
def s6_running_heads(spark, sf_dir):
    """First and last blocks, under 80 characters, that half of a document's pages or more repeat, digits aside (four pages at least)."""
    key = lambda block: F.regexp_replace(F.lower(F.trim(block)), "[0-9]", "#")
    blocks = F.split("text", "\n")
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", key(F.get(blocks, F.lit(0))).alias("first"), key(F.element_at(blocks, -1)).alias("last"))
    ends = pages.select("conv_id", "turn", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
    counts = pages.groupBy("conv_id").agg(F.count("*").alias("pages")).where("pages >= 4")
    repeated = ends.where("key <> '' and length(key) < 80").groupBy("conv_id", "key").agg(F.count("*").alias("n")).join(counts, "conv_id").where("n >= 0.5 * pages").select("conv_id", "key", F.lit(True).alias("hit"))
    out = pages
    for place, name in (("first", "head"), ("last", "foot")):
        out = out.join(repeated.withColumnsRenamed({"key": place, "hit": name}), ["conv_id", place], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("conv_id", "turn", "head", "foot")


@query(r"""select doc_id, sha256(text) as content_hash, substr(sha256(text), 1, 2) as shard from documents""")
def t2_content_hash(spark, sf_dir):
    """Content addresses."""
    digest = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("content_hash"), F.substring(digest, 1, 2).alias("shard"))


@query(r"""select doc_id, n > 1 as duplicate, first from (select doc_id, row_number() over (partition by sha256(text) order by doc_id) as n, min(doc_id) over (partition by sha256(text)) as first from documents)""")
def t17_exact_duplicates(spark, sf_dir):
    """Copies of an earlier text; the first holder by a partial aggregation, so one text's copies don't meet in a task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").select("doc_id", (F.col("doc_id") > F.col("first")).alias("duplicate"), "first")


@query(rf"""select doc_id, {_COLLAPSE} as flat from documents""")
def t1_collapse(spark, sf_dir):
    """White space collapsed (the whole clean-up is t1_normalise)."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.col("text")).alias("flat"))


@query()
def t1_normalise(spark, sf_dir):
    """Control characters out, compatibility forms, hyphens and soft wraps joined, blanks collapsed."""
    return chunking.normalised(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"""select doc_id, source || ' ' || substr(text, 1, 4000) as fingerprint from documents""")
def t16_fingerprint(spark, sf_dir):
    """Title and the first 4,000 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", F.substring("text", 1, 4000)).alias("fingerprint"))


@query(r"""select doc_id, case when n_chars > 5000 then 'book' when n_chars > 1000 then 'paper' else 'note' end as kind, not regexp_matches(source, '(?i)^(tmp[a-z0-9_]{4,}|[0-9a-f]{8,}|.+\.(pdf|txt|md))$') as titled from documents""")
def t19_kind_and_title(spark, sf_dir):
    """Kind by length, and whether a name is one that people give."""
    kind = F.when(F.col("n_chars") > 5000, "book").when(F.col("n_chars") > 1000, "paper").otherwise("note")
    machine = F.col("source").rlike(r"(?i)^(tmp[a-z0-9_]{4,}|[0-9a-f]{8,}|.+\.(pdf|txt|md))$")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), (~machine).alias("titled"))


@query(r"""select doc_id, concat_ws(' › ', nullif(source, ''), nullif(lang, ''), case when doc_id % 2 = 0 then 'orientation' end) as prefix from documents""")
def t15_context_prefix(spark, sf_dir):
    """Title, breadcrumb and orientation, blanks skipped."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" › ", F.nullif("source", F.lit("")), F.nullif("lang", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "orientation")).alias("prefix"))


@query(r"""with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents),
s as (select doc_id, list_transform(string_split(regexp_replace(flat, '([.!?])\s+([A-Z0-9("''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)) as parts from f),
k as (select doc_id, list_transform(list_filter(parts, lambda x: length(x) >= 25), lambda x: substr(x, 1, 400))[1:12] as sents from s)
select doc_id, len(sents)::int as n, list_filter(sents, lambda x: contains(lower(x), 'the'))[1] as lifted from k""")
def t20_sentence_lift(spark, sf_dir):
    """A text's first sentences, and the first that holds a term."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.get(F.filter("s", lambda x: F.lower(x).contains("the")), F.lit(0)).alias("lifted"))


@query(r"""with b as (select d.doc_id, 'Intro by ' || source || chr(10) || 'References' || chr(10) || '[1] Smith A. First work of ' || source || ', 2001. 10.1000/a' || doc_id || chr(10)
 || '[2] Jones B. Second work on language ' || lang || ', 2005.' || chr(10) || '[3] Brown C. Third work with a longer title, 10.2000/b.' || doc_id as body, doc_id, source, lang from documents d),
r as (select doc_id, unnest(['Smith A. First work of ' || source || ', 2001. 10.1000/a' || doc_id, 'Jones B. Second work on language ' || lang || ', 2005.', 'Brown C. Third work with a longer title, 10.2000/b.' || doc_id]) as entry, unnest([1, 2, 3]) as pos from b)
select doc_id, pos::int as pos, entry, nullif(regexp_extract(entry, '\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b'), '') as doi from r""")
def t22_references(spark, sf_dir):
    """Entries of a reference list, with their DOIs; the lists are built from the rows, as the tables hold none."""
    docs = table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("Intro by "), "source", F.lit("\nReferences\n[1] Smith A. First work of "), "source", F.lit(", 2001. 10.1000/a"), F.col("doc_id").cast("string"),
        F.lit("\n[2] Jones B. Second work on language "), "lang", F.lit(", 2005.\n[3] Brown C. Third work with a longer title, 10.2000/b."), F.col("doc_id").cast("string"),
    )
    return references.entries(docs.select("doc_id", body.alias("text")))


@query()
def t23_word_similarity(spark, sf_dir):
    """Each reference's best title by trigram word similarity."""
    parts = table(spark, sf_dir, "part")
    refs = parts.select(F.col("p_partkey").alias("ref_id"), F.concat(F.lit("Author X. "), "p_name", F.lit(". Journal 2004")).alias("reference"))
    return references.best_titles(refs, parts.select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title")))


@query(r"""with g as (select item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as grams from (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from benchmark) where len(w) >= 5),
d as (select doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as grams from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) where len(w) >= 5),
a as (select doc_id, unnest(grams) as gram from d), b as (select item_id, unnest(grams) as gram from g)
select doc_id, item_id, count(*) as shared from a join b using (gram) group by all having count(*) >= 3""")
def t28_shingle_overlap(spark, sf_dir):
    """Five-word runs that documents share with a set of texts."""
    words = lambda df, k: df.select(k, F.explode(tx.shingle_set(tx.tokens(F.col("text")), 5)).alias("gram"))
    d, b = words(table(spark, sf_dir, "documents"), "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id")
    return d.join(b, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).where("shared >= 3")


@query(r"""with q as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as body from conversations),
n as (select conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as q, trim(regexp_replace(lower(coalesce(body, '')), '[^a-z0-9]+', ' ', 'g')) as b from q),
w as (select *, string_split(q, ' ') as qw, string_split(b, ' ') as bw from n)
select conv_id, turn, len(qw) >= 3 and q <> '' and (contains(b, q) or contains(b, array_to_string(qw[1:6], ' ')) or len(list_intersect(list_distinct(qw), bw))::double / len(list_distinct(qw)) >= 0.75) as anchored from w""")
def t27_anchored_quotes(spark, sf_dir):
    """Quotes found in the text that follows them."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", nxt.alias("body")).select("conv_id", "turn", tx.anchored(F.col("text"), F.col("body")).alias("anchored"))


@query()
def t29_clip(spark, sf_dir):
    """Texts cut at a sentence or word end."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.clip(F.col("text"), 160).alias("clipped"))


@query(r"""select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: case when regexp_matches(w, '^[A-Z]{2,5}$') then w else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end), ' ') as name from part""")
def t30_names(spark, sf_dir):
    """Names in title case, short capitals kept."""
    words = F.transform(F.split("p_name", " "), lambda w: F.when(w.rlike("^[A-Z]{2,5}$"), w).otherwise(F.initcap(F.lower(w))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("name"))


@query(r"""with m as (select event_id, event_type, 'failed /srv/data/' || event_id || '.bin for ''user ' || user_id || ''' after ' || round(value)::int || ' s' as message from events),
k as (select event_type, substr(regexp_replace(regexp_replace(regexp_replace(message, '/[A-Za-z0-9_./-]+', '<path>', 'g'), '''[^'']{0,80}''', '''…''', 'g'), '[0-9]+', 'N', 'g'), 1, 400) as key from m)
select event_type, key, count(*) as n from k group by all""")
def t31_incident_keys(spark, sf_dir):
    """Messages that differ in ids, paths and numbers alone fall together."""
    rows = table(spark, sf_dir, "events")
    message = F.concat(F.lit("failed /srv/data/"), F.col("event_id").cast("string"), F.lit(".bin for 'user "), F.col("user_id").cast("string"), F.lit("' after "), F.round("value").cast("int").cast("string"), F.lit(" s"))
    return rows.select("event_type", tx.incident_key(message).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query(r"""with q(words) as (values (['thand', 'ering', 'the', 'license'])), d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w from documents),
n as (select count(*) as n from documents), f as (select w, count(*) as df from d where list_contains((select words from q), w) group by w)
select doc_id, round(sum(1.0::double / (1 + 10.0::double * df / n)), 6) as score from d join f using (w), n group by doc_id order by score desc, doc_id limit 20""")
def t32_relevant_docs(spark, sf_dir):
    """Documents by shared words, rare ones counting more."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("w")).where(F.col("w").isin("thand", "ering", "the", "license"))
    weights = words.groupBy("w").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    score = F.round(F.sum(1.0 / (1 + 10.0 * F.col("df") / F.col("total"))), 6)
    return words.join(weights.join(total, F.lit(True)), "w").groupBy("doc_id").agg(score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(r"""select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug from part""")
def t33_slugs(spark, sf_dir):
    """Names for files."""
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(F.lower(F.concat_ws(" / ", "p_name", "p_brand")), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


@query(r"""select conv_id, string_agg('[' || (turn + 1) || '] ' || substr(text, 1, 60), chr(10) order by turn) as context from conversations group by conv_id""")
def t34_context(spark, sf_dir):
    """Numbered passages as one text."""
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.substring("text", 1, 60))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return rows.select("conv_id", F.array_join("l.line", "\n").alias("context"))


@query(r"""select event_id, regexp_replace(regexp_replace('at /home/u' || user_id || '/x token=' || event_id || ' ok', '/home/[^/\s]+', '~'), '(?i)(api[_-]?key|token|password|secret)\s*[=:]\s*\S+', '\1=<redacted>') as clean from events""")
def t36_scrub(spark, sf_dir):
    """Home folders and secrets out of messages."""
    message = F.concat(F.lit("at /home/u"), F.col("user_id").cast("string"), F.lit("/x token="), F.col("event_id").cast("string"), F.lit(" ok"))
    return table(spark, sf_dir, "events").select("event_id", tx.scrub(message).alias("clean"))


@query(r"""with f as (select source, min(doc_id) as first from documents group by source), n as (select source, row_number() over (order by first) as number from f) select doc_id, number::int as number from documents join n using (source)""")
def t37_numbering(spark, sf_dir):
    """One number per source in order of first appearance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    return docs.join(first.select("source", F.row_number().over(Window.orderBy("first")).alias("number")), "source").select("doc_id", "number")


@query()
def t12_chunks(spark, sf_dir):
    """Sections and token-bounded passages with their spans."""
    return chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(r"""with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents), e as (select doc_id, text, array_to_string(string_split(trim(lines[least(len(lines), 3)]), ' ')[1:6], ' ') as title from d)
select doc_id, case when title = '' then -1 else strpos(lower(chr(10) || text), lower(chr(10) || title)) - 1 end::int as place from e""")
def t5_toc_location(spark, sf_dir):
    """T5: where a title of a table of contents stands in the text; the titles are beginnings of the texts' lines, as the tables hold no contents."""
    lines = F.split("text", "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(F.slice(F.split(F.trim(F.get(lines, F.least(F.size(lines), F.lit(3)) - 1)), " "), 1, 6), " ").alias("title"))
    return docs.select("doc_id", chunking.located(F.col("text"), F.col("title")).alias("place"))


@query(r"""select doc_id, (length(text) // 2 // 1800 + 1)::int as middle, (greatest(length(text) - 1, 0) // 1800 + 1)::int as last from documents""")
def t9_pages(spark, sf_dir):
    """The pages that a text's middle and end lie on; pages begin every 1,800 characters here."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(1800))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), starts.alias("starts"))
    middle = F.floor(F.col("n") / 2).cast("int")
    return docs.select("doc_id", chunking.page_of(middle, F.col("starts")).alias("middle"), chunking.page_of(F.greatest(F.col("n") - 1, F.lit(0)), F.col("starts")).alias("last"))


@query()
def t38_as_read(spark, sf_dir):
    """Documents as read, section by section, passages without what they share."""
    return chunking.as_read(chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query()
def t13_spans(spark, sf_dir):
    """Every passage against its span of the text, white space aside."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.check_spans(docs, chunking.chunks(docs))


@query()
def t14_deoverlap(spark, sf_dir):
    """Passages without the words they repeat from the one before."""
    return chunking.without_overlap(chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(r"""select conv_id, turn, coalesce(len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')) >= 4
 and not regexp_matches(text, '(?i)\b(it|its|that|this|these|those|they|them|their|the (first|second|third|last|former|latter)|he|she|his|her|there|above|instead|also|too|as well|same|other|another)\b'), false) as self_contained from conversations""")
def p18_self_contained(spark, sf_dir):
    """Messages that need nothing said before."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.self_contained(F.col("text")).alias("self_contained"))


@query(r"""select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bCVE-\d{4}-\d{4,7}\b|\b[0-9a-f]{32}\b|\b[0-9a-f]{40}\b|\b[0-9a-f]{64}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda x: lower(x)))) as found from documents""")
def p19_identifiers(spark, sf_dir):
    """Identifiers that answers must ground."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(tx.identifiers(F.col("text"))).alias("found"))


@query(r"""with p as (select doc_id, source || case doc_id % 5 when 0 then ' › References (cont. 2)' when 1 then ' / Appendix A. Bibliography' when 2 then ' › Index of terms' when 3 then ' › Contents' else ' › Results' end as path from documents)
select doc_id, regexp_matches(trim(regexp_replace(list_last(string_split_regex(path, '\s*[›>/]\s*')), '(?i)\s*\(cont\.?\s*\d*\)\s*$', '')), '(?i)^(appendix\s+[a-z0-9]+\.?\s*)?(bibliography|references|works cited|index|(table of )?contents|acknowledg(e)?ments?)$') as back_matter from p""")
def p7_back_matter(spark, sf_dir):
    """Passages under a bibliography, an index and the like."""
    last = F.element_at(F.array(*map(F.lit, (" › References (cont. 2)", " / Appendix A. Bibliography", " › Index of terms", " › Contents", " › Results"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_back_matter(F.concat("source", last)).alias("back_matter"))


_MARKED = r"""with m as (select doc_id, source, case doc_id % 4 when 0 then 'SECRET//NOFORN' || chr(10) || text when 1 then 'Classification: INTERNAL' || chr(10) || text when 2 then '(S) ' || text else text end as text from documents)"""


@query(rf"""{_MARKED}, l as (select doc_id, unnest(string_split(text, chr(10))) as line from m),
b as (select doc_id, trim(regexp_replace(trim(line, '*#_-= ' || chr(9)), '\s+', ' ', 'g')) as b from l), c as (select doc_id, trim(regexp_replace(b, '(?i)^classification:', '')) as b from b),
r as (select doc_id, max(case when length(b) > 80 or b <> upper(b) then null when regexp_matches(b, '^(TOP SECRET)(//[A-Z ]+)*$') then 3 when regexp_matches(b, '^(SECRET)(//[A-Z ]+)*$') then 2 when regexp_matches(b, '^(INTERNAL|COMPANY INTERNAL)$') then 1 when regexp_matches(b, '^(UNCLASSIFIED|PUBLIC)$') then 0 end) as rank from c where b <> '' group by doc_id)
select doc_id, ['public', 'internal', 'secret', 'top'][r.rank + 1] as banner, case when regexp_matches(text, '^\s*\(TS\)\s') then 'top' when regexp_matches(text, '^\s*\(S\)\s') then 'secret' end as portion
from m left join r using (doc_id)""")
def c2_markings(spark, sf_dir):
    """The highest banner line and portion mark of each text; markings are put in by id, as the tables hold none."""
    return classify.markings(classify.marked_fixture(table(spark, sf_dir, "documents"))).select("doc_id", "banner", "portion")


@query(rf"""{_MARKED}, d as (select doc_id, case doc_id % 4 when 0 then 2 when 1 then 1 when 2 then 2 else null end as marked, case when doc_id % 10 = 0 then 0 end as manual, case when source = 'src3' then 1 end as clearance from m),
e as (select doc_id, coalesce(manual, marked, clearance, 0) as rank from d) select doc_id, ['public', 'internal', 'secret', 'top'][rank + 1] as level, rank <= 1 as within from e""")
def c4_levels(spark, sf_dir):
    """Each document's level (set by hand, marked, cleared, default), and whether the ceiling admits it."""
    docs = classify.markings(classify.marked_fixture(table(spark, sf_dir, "documents")))
    manual, cleared = F.when(F.col("doc_id") % 10 == 0, "public"), F.when(F.col("source") == "src3", "internal")
    level = classify.document_level(manual, F.col("banner"), F.col("portion"), cleared)
    return docs.select("doc_id", level.alias("level"), (classify.rank(level) <= classify.rank(F.lit("internal"))).alias("within"))
