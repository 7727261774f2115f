"""Stateful operators over a stream whose state is held between micro-batches: incidents, debounced rebuilds, job states.

Events of a key come in any order within the lateness.  They wait in a list
until the watermark has passed them, then they are taken in order of time and
number, so the results are those of the batch forms in ``operators.lifecycle``
over all events, however they are dealt into micro-batches and wherever the
stream was stopped and started again.  A timer wakes a key when the watermark
reaches what it waits for; a key that waits for nothing holds no state but what
a later event needs.

State is kept by RocksDB, with a checkpoint in the stream's own folder, which
must be one that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: How late an event may be.
LATENESS = "30 minutes"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "at bigint, number bigint, kind string, until bigint"


class Ordered(StatefulProcessor):
    """Takes a key's events in order once the watermark has passed them; ``advance`` says what they do."""

    HELD = "a bigint, b bigint, n bigint, state string"
    names: list[str] = []  #: of the columns that come out

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROWS)
        self.held = handle.getValueState("held", self.HELD)

    def wake(self, micros: int) -> None:
        """Call again when the watermark has reached this time."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["at"], r["number"], r["kind"], r["until"]) for r in rows]
        self.rows.appendList(new)
        self.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.rows.get()) if self.rows.exists() else []
        ready = [r for r in waiting if r[0] <= mark]
        rest = waiting[len(ready) :]
        held = tuple(self.held.get()) if self.held.exists() else None
        out, held, kept, until = self.advance(ready, held, mark)
        if ready:
            if kept or rest:
                self.rows.put([*kept, *rest])
            else:
                self.rows.clear()
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        for time in [*[r[0] for r in rest[:1]], *([until] if until is not None and until > mark else [])]:
            self.wake(time)
        for values in out:
            yield Row(**dict(zip(self.names, [*key, *values], strict=True)))

    def advance(self, ready: list[tuple], held: tuple | None, mark: int) -> tuple[list[tuple], tuple | None, list[tuple], int | None]:
        """What comes out, what is held, which of the rows are kept, and when to call again."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Incidents(Ordered):
    """Recurrences at most ``gap`` apart are one incident: (first, last, n), told once nothing can join it."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def advance(self, ready, held, mark):
        out = []
        for at, *_ in ready:
            if held and at - held[1] <= self.gap:
                held = (held[0], at, held[2] + 1, None)
            else:
                if held:
                    out.append(held[:3])
                held = (at, at, 1, None)
        if held and held[1] + self.gap <= mark:  # what comes later is after the mark
            out.append(held[:3])
            held = None
        return out, held, [], held and held[1] + self.gap


class Debounce(Ordered):
    """Rebuilds that a key's events reserve a quiet window ahead: (asked, due, absorbed); one that falls into a busy spell waits for its end."""

    def __init__(self, quiet_seconds: int):
        self.quiet = quiet_seconds * 1_000_000

    def advance(self, ready, held, mark):
        out, spells = [], [r for r in ready if r[2] == "busy"]

        def moved(due: int, known: int) -> int:
            """The due time after the spells that began by it, of those that ``known`` lets know."""
            for since, _, _, until in spells:
                if since <= min(due, known) and due < until:
                    due = until
            return due

        for at, _, kind, _ in ready:
            if held:
                held = (held[0], moved(held[1], at), held[2], None)
                if at > held[1]:
                    out.append(held[:3])
                    held = None
            if kind == "ask":
                held = (held[0], held[1], held[2] + 1, None) if held else (at, at + self.quiet, 1, None)
        if held:
            held = (held[0], moved(held[1], mark), held[2], None)
            if held[1] <= mark:  # no spell or event up to the due time can come any more
                out.append(held[:3])
                held = None
        last = held[0] if held else mark
        return out, held, [r for r in spells if r[3] > last], held and held[1]


class Jobs(Ordered):
    """Transitions of a job that its states don't allow: (number, before, state)."""

    def __init__(self, allowed: dict[str, list[str]], first: list[str]):
        self.allowed, self.first = allowed, first

    def advance(self, ready, held, mark):
        out = []
        for _, number, state, _ in ready:
            before = held[3] if held else None
            if state not in (self.first if held is None else self.allowed.get(before, [])):
                out.append((number, before, state))
            held = (0, 0, 0, state)
        return out, held, [], None


def _run(rows: DataFrame, keys: list[str], processor: Ordered, schema: str, lateness: str) -> DataFrame:
    """``rows``: keys, ts (timestamp), number, kind, until (microseconds)."""
    spark: SparkSession = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    late = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness).select(*keys, "ts", "at", "number", "kind", "until")
    kinds = dict(late.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    processor.names = [*keys, *(c.split()[0] for c in schema.split(", "))]
    return late.groupBy(*keys).transformWithState(processor, f"{named}, {schema}", "Append", "EventTime")


def _times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


def incidents(events: DataFrame, keys: list[str], gap_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """(keys, first, last, n): the stream's form of ``lifecycle.sessions``; ``events`` has the keys and ts."""
    rows = events.select(*keys, "ts", F.lit(0).cast("bigint").alias("number"), F.lit("event").alias("kind"), F.lit(None).cast("bigint").alias("until"))
    return _times(_run(rows, keys, Incidents(gap_seconds), "first bigint, last bigint, n bigint", lateness), "first", "last")


def debounced(events: DataFrame, key: str, quiet_seconds: int, busy_until: Column | None = None, lateness: str = LATENESS) -> DataFrame:
    """(key, asked, due, absorbed): the stream's form of ``lifecycle.debounced``.

    ``events`` has the key and ts; where ``busy_until`` isn't null the event also begins a busy spell of its key that ends then.
    """
    until = F.lit(None).cast("timestamp") if busy_until is None else busy_until
    marked = events.withColumn("_until", F.unix_micros(until))
    # a spell stands before the request of the same moment
    both = F.when(F.col("_until").isNull(), F.array(F.lit("ask"))).otherwise(F.array(F.lit("busy"), F.lit("ask")))
    rows = marked.select(key, "ts", F.explode(both).alias("kind"), "_until").select(
        key, "ts", F.when(F.col("kind") == "busy", 0).otherwise(1).cast("bigint").alias("number"), "kind", F.when(F.col("kind") == "busy", F.col("_until")).alias("until")
    )
    return _times(_run(rows, [key], Debounce(quiet_seconds), "asked bigint, due bigint, absorbed bigint", lateness), "asked", "due")


def illegal_transitions(events: DataFrame, key: str, state: str, number: str, allowed: dict[str, list[str]], first: list[str], lateness: str = LATENESS) -> DataFrame:
    """(key, number, before, state): the stream's form of ``lifecycle.illegal_transitions``."""
    rows = events.select(key, "ts", F.col(number).cast("bigint").alias("number"), F.col(state).alias("kind"), F.lit(None).cast("bigint").alias("until"))
    return _run(rows, [key], Jobs(allowed, first), "number bigint, before string, state string", lateness)
