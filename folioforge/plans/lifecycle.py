"""Operations queries: incidents, rates, jobs, records, and their streaming twins' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import lifecycle
from folioforge.plans.registry import query
from folioforge.sources import records
from folioforge.tables import table


@query("""with o as (select event_type, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts) <= 600000000 then 0 else 1 end as fresh from events),
n as (select event_type, ts, sum(fresh) over (partition by event_type order by ts rows unbounded preceding) as run from o)
select event_type, min(ts) as first, max(ts) as last, count(*) as n from n group by event_type, run""")
def st1_incident_sessions(spark, sf_dir):
    """ST1, M17: recurrences within 600 seconds are one incident."""
    return lifecycle.sessions(table(spark, sf_dir, "events"), ["event_type"], "ts", 600)


@query("""select event_id, n from (select event_id, count(*) over (partition by event_type order by epoch_us(ts) // 1000000 range between 60 preceding and current row) as n from events) where n >= 2""")
def st3_rate_limit(spark, sf_dir):
    """ST3: calls that are the second or later of their kind within a minute."""
    return lifecycle.preceding(table(spark, sf_dir, "events"), "event_type", "ts", 60).select("event_id", "n").where("n >= 2")


@query("""select user_id, event_type as state, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1""")
def st6_latest_state(spark, sf_dir):
    """ST6: each job's last state."""
    return lifecycle.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_type").alias("state"), "ts")


#: A job's states, for which kinds of events stand here: queued (signup), running (view), yielded (click), done (purchase), failed (error).
TRANSITIONS = {"signup": ["view", "error"], "view": ["click", "purchase", "error"], "click": ["view", "error"], "purchase": [], "error": ["signup"]}
FIRST = ["signup"]
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, after in TRANSITIONS.items() for b in after)


@query(f"""select user_id, event_id as number, before, state from (select user_id, event_id, event_type as state, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
where case when before is null then state <> '{FIRST[0]}' else (before, state) not in (values {_PAIRS}) end""")
def st6_illegal_transitions(spark, sf_dir):
    """ST6: changes of a job's state that its rules don't allow (the streaming form holds the last state of each job)."""
    return lifecycle.illegal_transitions(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", TRANSITIONS, FIRST)


@query()
def st2_debounce(spark, sf_dir):
    """ST2: rebuilds that each user's events reserve, ten minutes after the first; one due while the user's reading (errors, here) goes on waits for its end."""
    events = table(spark, sf_dir, "events")
    reading = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("since"), (F.col("ts") + F.expr("interval 5 minutes")).alias("until"))
    return lifecycle.debounced(events, "user_id", "ts", 600, reading)


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def st8_tumbling(spark, sf_dir):
    """ST8: hourly windows (an extension; the streaming form has a watermark)."""
    window = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""select count(*) || ' events of ' || count(distinct event_type) || ' kinds by ' || count(distinct user_id) || ' users' as summary from events""")
def a22_summary_line(spark, sf_dir):
    """One line over JSON records from a template."""
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", "value", "user_id")).alias("row"))
    return records.summary(rows, "row", "{count} events of {distinct:event_type} kinds by {distinct:user_id} users")


@query("""select event_id, upper(event_type) || ' by ' || user_id || ': ' || substr(event_type, 1, 3) || case when length(event_type) > 3 then '…' else '' end || ' none' as line from events""")
def s16_format_lines(spark, sf_dir):
    """§2.8: records as lines from a template with filters."""
    rows = table(spark, sf_dir, "events")
    record = F.to_json(F.struct("event_type", "user_id"))
    return rows.select("event_id", records.line(record, "{event_type|upper} by {user_id}: {event_type|trunc:3} {missing|default:none}").alias("line"))


@query("""with r as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id) as total,
upper(event_type) || ' {"k":' || regexp_extract(props, '[0-9]+') || '}' as line from events)
select user_id, string_agg(line, chr(10) order by n) || case when max(total) > 3 then chr(10) || '… and ' || (max(total) - 3) || ' more' else '' end as rendered from r where n <= 3 group by user_id""")
def s17_rendered_rows(spark, sf_dir):
    """§2.8: each user's first three events as lines with a JSON field, and how many more there are."""
    rows = table(spark, sf_dir, "events")
    record = F.to_json(F.struct("event_type", F.from_json("props", "k int").alias("props")))
    return records.render_rows(rows.withColumn("record", record), "user_id", "record", "{event_type|upper} {props|json}", 3, [F.asc("ts"), F.asc("event_id")])


@query("""select event_id, (user_id % 3)::int as level, (user_id % 3) <= 1 and event_type <> 'purchase' as usable from events""")
def c8_source_gating(spark, sf_dir):
    """Records usable under a ceiling and a clearance."""
    level = (F.col("user_id") % 3).cast("int")
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"), ((level <= 1) & (F.col("event_type") != "purchase")).alias("usable"))
