"""Queries of editions: reduced exports, volumes as read. Conversations are volumes here, turns sections, lines passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import editions
from folioforge.plans.registry import query
from folioforge.tables import table

_LINES = """c as (select conv_id, turn::int as turn, text from conversations where text is not null),
l as (select conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int - 1 as i from c)"""


def _lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")
    return turns, turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _id(head: str, *columns: str):
    return F.concat(F.lit(head), F.concat_ws(":", *(F.col(c).cast("string") for c in columns)))


@query(f"""with {_LINES},
a as (select 's' || conv_id || ':' || turn as target, 'a' || conv_id || ':' || turn as id, substr(text, 1, 40) as text, case when turn % 2 = 0 then 0 else 1 end as theirs from c where turn % 3 <> 1
union all select 's' || conv_id || ':' || turn, 'b' || conv_id || ':' || turn, substr(text, 5, 30), 1 from c where turn % 3 = 0 or turn % 6 = 1 union all select 's' || conv_id || ':' || turn, 'A' || conv_id || ':' || turn, 'theirs', 1 from c where turn % 3 = 0),
s as (select target, id, text from (select *, row_number() over (partition by target order by theirs, id) as n from a) where n = 1),
r as (select md5(md5(conv_id::varchar) || ':' || turn) as id, conv_id, turn, s.target as section, s.text, row_number() over (partition by conv_id order by turn) - 1 as pos from c join s on s.target = 's' || conv_id || ':' || turn)
select 'passage' as part, id, section as target, pos || ' ' || text as value from r
union all select 'artifact', id, target, 'section_summary ' || text from s union all select distinct 'artifact', 'o' || conv_id, 'd' || conv_id, 'orientation on ' || conv_id from c
union all select 'artifact', 'r' || l.conv_id || ':' || l.turn || ':' || i, r.id, 'reflection ' || substr(line, 1, 20) from l join r on r.conv_id = l.conv_id and r.turn = l.turn where i % 2 = 0
union all select 'tag', r.id, 't' || length(line) % 4, max(i % 3)::varchar from l join r on r.conv_id = l.conv_id and r.turn = l.turn group by r.id, 't' || length(line) % 4""")
def m15_readings(spark, sf_dir):
    """An export of readings: a passage for each section with a summary, reflections pointed to it, tags rolled up to it."""
    turns, lines = _lines(spark, sf_dir)
    volume, section, passage = _id("d", "conv_id"), _id("s", "conv_id", "turn"), _id("p", "conv_id", "turn", "i")
    docs = turns.select(volume.alias("doc_id"), F.md5(F.col("conv_id").cast("string")).alias("content_hash")).distinct()
    sections = turns.select(section.alias("id"), volume.alias("doc_id"), F.col("turn").alias("order_index"))
    passages = lines.select(passage.alias("id"), volume.alias("doc_id"), section.alias("section"), F.col("i").alias("order_index"), F.col("line").alias("text"))

    def written(rows, head, columns, kind, target, text, cartridge):
        return rows.select(_id(head, *columns).alias("id"), F.lit(kind).alias("kind"), target.alias("target"), text.alias("text"), cartridge.cast("string").alias("cartridge"))

    place, none = ("conv_id", "turn"), F.lit(None)
    artifacts = written(turns.where("turn % 3 <> 1"), "a", place, "section_summary", section, F.substring("text", 1, 40), F.when(F.col("turn") % 2 != 0, "c1"))
    artifacts = artifacts.unionByName(written(turns.where("turn % 3 = 0 or turn % 6 = 1"), "b", place, "section_summary", section, F.substring("text", 5, 30), F.lit("c2")))
    artifacts = artifacts.unionByName(written(turns.where("turn % 3 = 0"), "A", place, "section_summary", section, F.lit("theirs"), F.lit("c3")))
    artifacts = artifacts.unionByName(written(turns.select("conv_id").distinct(), "o", ["conv_id"], "orientation", volume, F.concat(F.lit("on "), F.col("conv_id").cast("string")), none))
    artifacts = artifacts.unionByName(written(lines.where("i % 2 = 0"), "r", (*place, "i"), "reflection", passage, F.substring("line", 1, 20), none))
    tags = lines.select(passage.alias("passage"), F.concat(F.lit("t"), (F.length("line") % 4).cast("string")).alias("category"), (F.col("i") % 3).alias("confidence"))
    out = editions.reduced("readings", docs, sections, passages, artifacts, tags)
    texts = out["passages"].select(F.lit("passage").alias("part"), "id", F.col("section").alias("target"), F.concat_ws(" ", F.col("order_index").cast("string"), "text").alias("value"))
    notes = out["artifacts"].select(F.lit("artifact").alias("part"), "id", "target", F.concat_ws(" ", "kind", "text").alias("value"))
    return texts.unionByName(notes).unionByName(out["tags"].select(F.lit("tag").alias("part"), F.col("passage").alias("id"), F.col("category").alias("target"), F.col("confidence").cast("string").alias("value")))


_TITLED = "case turn % 3 when 0 then split_part(text, chr(10), 1) when 1 then 'Untitled' else 'Turn number ' || turn end"


@query(rf"""with {_LINES}, h as (select conv_id, 's' || turn as section, turn as place, {_TITLED} as title, conv_id % 4 = 0 as short, substr(text, 1, 10) as told, turn % 2 = 0 as has from c
union all select conv_id, 'empty', 1000, 'An empty section', conv_id % 4 = 0, null, false from c where turn = 0),
p as (select conv_id, case when turn % 7 <> 6 then 's' || turn end as section, turn * 1000 + i as pos, i, line from l where i % 5 <> 4),
w as (select *, greatest(coalesce(lag(i * 10 + 12) over (partition by conv_id, section order by pos), 0) - i * 10, 0) as shared, row_number() over (partition by conv_id, section order by pos) as n from p),
x as (select conv_id, section, pos, n, case when section is null then line else substr(line, shared::int + 1) end as t from w),
m as (select h.conv_id, place, h.section, title, case when not short and has then told end as summary, pos, n, t from h left join (select * from x where section is not null) x on x.conv_id = h.conv_id and x.section = h.section where not short or pos is not null),
u as (select conv_id, place, section, title, summary, pos, case when n = 1 and lower(trim(regexp_replace(trim(split_part(t, chr(10), 1)), '^#+', ''))) = lower(trim(title)) then regexp_replace(substr(t, length(split_part(t, chr(10), 1)) + 2), '^\s+', '') else t end as t from m
union all select conv_id, null, null, null, null, pos, t from x where section is null)
select conv_id as doc_id, place, section, case when regexp_matches(title, '[A-Za-z]{{5,}}') then title end as title, summary, pos as order_index, t as text,
case when pos % 1000 % 6 = 0 then 'mine' when pos % 1000 % 3 = 0 then 'theirs' end as reflection, (case when pos % 1000 % 6 = 0 then 2 when pos % 1000 % 3 = 0 then 1 else 0 end)::bigint as reflections from u""")
def t38_margins(spark, sf_dir):
    """Volumes as read, with summaries over sections and reflections beside passages; spans overlap by two characters, and a seventh of the turns belong to no section."""
    turns, lines = _lines(spark, sf_dir)
    section, short = F.concat(F.lit("s"), F.col("turn").cast("string")), F.col("conv_id") % 4 == 0
    docs = turns.select(F.col("conv_id").alias("doc_id"), short.alias("readings_only")).distinct()
    title = F.when(F.col("turn") % 3 == 0, F.substring_index("text", "\n", 1)).when(F.col("turn") % 3 == 1, "Untitled").otherwise(F.concat(F.lit("Turn number "), F.col("turn").cast("string")))
    sections = turns.select(F.col("conv_id").alias("doc_id"), section.alias("section"), F.col("turn").alias("order_index"), title.alias("title"))
    sections = sections.unionByName(turns.where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.lit("empty").alias("section"), F.lit(1000).alias("order_index"), F.lit("An empty section").alias("title")))
    at = F.col("turn") * 1000 + F.col("i")
    passages = lines.select(
        F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 7 != 6, section).alias("section"), at.alias("order_index"), F.when(F.col("i") % 5 == 4, "figure").alias("kind"),
        F.col("line").alias("text"), (F.col("i") * 10).alias("char_start"), (F.col("i") * 10 + 12).alias("char_end"),
    )
    summaries = turns.where("turn % 2 = 0").select(F.col("conv_id").alias("doc_id"), section.alias("section"), F.substring("text", 1, 10).alias("text"))
    note = lambda every, text, cartridge, created: lines.where(f"i % {every} = 0").select(F.col("conv_id").alias("doc_id"), at.alias("order_index"), F.lit(text).alias("text"), F.lit(cartridge).cast("string").alias("cartridge"), F.lit(created).alias("created"))
    return editions.margins(docs, sections, passages, summaries, note(3, "theirs", "c1", 1).unionByName(note(6, "mine", None, 2)))


@query(f"""with {_LINES}, f as (select conv_id, turn, i % 10 as n, line from l where i % 5 = 4), r as (select *, row_number() over (partition by conv_id, n order by turn desc, n) as k from f where n = 4 and turn % 3 <> 2)
select conv_id as doc_id, n::int as figure, line as text from r where k = 1""")
def t38_figures(spark, sf_dir):
    """What figures show by their number; every fifth line is a figure's, half of them without a number.

    Of a turn's numbered lines, which the SQL leaves tied, the earliest counts."""
    _, lines = _lines(spark, sf_dir)
    head = F.when((F.col("i") % 10 == 4) & (F.col("turn") % 3 != 2), F.concat(F.lit("Figure 4, p. "), F.col("turn").cast("string"), F.lit("\n\n"))).otherwise(F.lit("A figure\n\n"))
    rows = lines.where("i % 5 = 4").select(F.col("conv_id").alias("doc_id"), F.struct("turn", -F.col("i")).alias("order_index"), F.lit("figure").alias("kind"), F.concat(head, "line").alias("text"))
    return editions.figures(rows)
