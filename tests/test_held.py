import datetime
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import lifecycle
from folioforge.plans import lifecycle as plans
from folioforge.streaming import held, incidents
from folioforge.tables import table


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """Events of a few users in shuffled files, late by at most the lateness, and one far later event that closes all."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = table(spark, sf, "events").where("user_id < 6").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = events.collect()
    random.seed(7)
    # by day, so that no file is later than the lateness of days below
    rows.sort(key=lambda r: (r["ts"].toordinal() // 3, random.random()))
    for i in range(0, len(rows), -(-len(rows) // 5)):
        spark.createDataFrame(rows[i : i + -(-len(rows) // 5)], events.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, events, rows


def streamed(spark, folder, make, tmp_path, stops=2):
    """All that a stream gives, stopped and started again ``stops`` times."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = incidents.event_stream(spark, folder)
    for _ in range(stops):
        query = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
    # the end: an event far later than all
    last = spark.createDataFrame([(-1, -1, "error", datetime.datetime(2099, 1, 1))], "event_id bigint, user_id bigint, event_type string, ts timestamp")
    last.select(*stream.columns).coalesce(1).write.mode("append").parquet(folder)
    query = make(incidents.event_stream(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.parquet(out)


def copied(spark, parts, tmp_path):
    """The files again, as each stream adds its end to them."""
    folder = str(tmp_path / "in")
    paths = spark.read.parquet(parts[0]).groupBy(F.input_file_name().alias("path")).agg(F.min("ts").alias("ts")).orderBy("ts").collect()
    for path, _ in paths:
        spark.read.parquet(path).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_incidents_equal_batch_sessions(spark, parts, tmp_path):
    got = streamed(spark, copied(spark, parts, tmp_path), lambda s: held.incidents(s, ["event_type"], 7200, "9 days"), tmp_path)
    want = lifecycle.sessions(parts[1], ["event_type"], "ts", 7200)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select(*got.columns).collect())
    assert got.where("n > 1").count() > 3


def test_debounce_equals_batch(spark, parts, tmp_path):
    busy = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("interval 9 hours"))
    got = streamed(spark, copied(spark, parts, tmp_path), lambda s: held.debounced(s, "user_id", 20_000, busy, "9 days"), tmp_path)
    spells = parts[1].where("event_type = 'error'").select("user_id", F.col("ts").alias("since"), (F.col("ts") + F.expr("interval 9 hours")).alias("until"))
    want = lifecycle.debounced(parts[1], "user_id", "ts", 20_000, spells)
    assert sorted(map(tuple, got.where("user_id >= 0").collect())) == sorted(tuple(r) for r in want.select(*got.columns).collect())
    assert got.where("absorbed > 1").count() > 3 and got.where("unix_seconds(due) - unix_seconds(asked) > 20000").count() > 0


def test_illegal_transitions_equal_batch(spark, parts, tmp_path):
    got = streamed(spark, copied(spark, parts, tmp_path), lambda s: held.illegal_transitions(s, "user_id", "event_type", "event_id", plans.TRANSITIONS, plans.FIRST, "9 days"), tmp_path)
    want = lifecycle.illegal_transitions(parts[1], "user_id", "event_type", "event_id", plans.TRANSITIONS, plans.FIRST)
    assert sorted(map(str, got.where("user_id >= 0").collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert got.count() > 5


class Fake:
    """A processor's handle whose state is plain values."""

    def __init__(self):
        self.timers = set()

    def registerTimer(self, at):
        self.timers.add(at)

    def getListState(self, *_):
        return Cell([])

    def getValueState(self, *_):
        return Cell(None)


class Cell:
    def __init__(self, empty):
        self.empty, self.value = empty, empty

    def exists(self):
        return bool(self.value)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, values):
        self.value = [*self.value, *values]

    def clear(self):
        self.value = self.empty


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def replay(processor, batches, marks):
    """Outputs of a processor for batches of rows, each followed by its watermark."""
    handle, out = Fake(), []
    processor.names = ["key", *"abc"]
    processor.init(handle)
    for rows, mark in zip(batches, marks):
        if rows:
            list(processor.handleInputRows(("k",), iter([dict(zip(("at", "number", "kind", "until"), r)) for r in rows]), Mark(0)))
        for timer in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(timer)
            out += [tuple(r)[1:] for r in processor.handleExpiredTimer(("k",), Mark(mark), None)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_order_and_batches_give_the_same(seed):
    rng = random.Random(seed)
    second = 1_000_000
    rows = []
    for n in range(60):
        at = rng.randint(1, 4000) * second
        rows.append((at, 1, "ask", None))
        if rng.random() < 0.2:
            rows.append((at, 0, "busy", at + rng.randint(1, 400) * second))
    everything = replay(held.Debounce(60), [rows], [10_000_000])
    # in order of time with some disorder, the watermark below all that comes later
    mixed = sorted(rows, key=lambda r: r[0] + rng.randint(0, 200) * second)
    cuts = sorted(rng.sample(range(len(mixed)), 8))
    batches = [mixed[a:b] for a, b in zip([0, *cuts], [*cuts, len(mixed)])]
    marks = [min([r[0] // 1000 - 1 for later in batches[i + 1 :] for r in later], default=10_000_000) for i in range(len(batches))]
    assert sorted(replay(held.Debounce(60), batches, marks)) == sorted(everything)
    spells = sorted((r[0], r[3]) for r in rows if r[2] == "busy")
    asks, want, i = sorted(r[0] for r in rows if r[2] == "ask"), [], 0
    while i < len(asks):
        due = asks[i] + 60 * second
        for a, b in spells:
            due = b if a <= due < b else due
        j = sum(x <= due for x in asks)
        want.append((asks[i], due, j - i))
        i = j
    assert sorted(everything) == want
    asked = [r for r in rows if r[2] == "ask"]
    one = replay(held.Incidents(60), [asked], [10_000_000])
    assert sorted(replay(held.Incidents(60), [[r for r in b if r[2] == "ask"] for b in batches], marks)) == sorted(one)
    assert sum(r[2] for r in one) == len(asked)


def test_state_is_dropped_when_nothing_waits():
    processor = held.Debounce(60)
    replay(processor, [[(1_000_000, 0, "busy", 90_000_000), (1_000_000, 1, "ask", None)], []], [2_000, 900_000])
    assert not processor.rows.exists() and not processor.held.exists()
