import pytest
from folioforge.operators import store

SCHEMA = "hash string, v int"


@pytest.fixture()
def made(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"), SCHEMA)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(s, snapshot=None):
    return sorted(tuple(r) for r in s.read(snapshot).collect())


def test_second_run_writes_only_what_is_new(spark, made, tmp_path):
    assert held(made) == [] and made.snapshots() == []
    assert made.append(rows(spark, ("aa1", 1), ("ab2", 2), ("aa1", 1), (None, 9))) == 2
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert made.append(rows(spark, ("aa1", 5), ("cc3", 3))) == 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert held(made) == [("aa1", 1), ("ab2", 2), ("cc3", 3)]
    assert held(made, 1) == [("aa1", 1), ("ab2", 2)]
    assert made.append(rows(spark, ("aa1", 7))) == 0 and made.snapshots() == [1, 2]


def test_prefixes_are_folders(spark, made):
    made.append(rows(spark, *((f"{i:02x}x", i) for i in range(40))))
    part = made.read(prefixes=["05", "1f"])
    assert sorted(r["v"] for r in part.collect()) == [5, 31]
    assert "PartitionFilters: [prefix" in part._jdf.queryExecution().toString()


def test_a_crash_before_the_swap_leaves_the_old_snapshot(spark, made, monkeypatch):
    made.append(rows(spark, ("aa", 1)))

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(store.Store, "_commit", dies)
    with pytest.raises(OSError):
        made.append(rows(spark, ("bb", 2)))
    monkeypatch.undo()
    again = store.Store(spark, made.path, SCHEMA)
    assert held(again) == [("aa", 1)] and again.snapshots() == [1]
    assert again.append(rows(spark, ("bb", 3))) == 1 and held(again) == [("aa", 1), ("bb", 3)]


def test_of_two_writers_one_has_to_try_again(spark, made):
    made.append(rows(spark, ("aa", 1)))
    name = made._write(rows(spark, ("bb", 2)), 2)
    made.append(rows(spark, ("cc", 3)))
    with pytest.raises(store.Taken):
        made._commit(2, [*made.writes(1), ("rows", name)])
    assert held(made) == [("aa", 1), ("cc", 3)]


def test_dropped_rows_go_come_back_and_are_compacted(spark, made):
    made.append(rows(spark, ("aa", 1), ("bb", 2), ("cc", 3)))
    assert made.retain(spark.createDataFrame([("aa",), ("zz",)], "hash string")) == 2
    assert held(made) == [("aa", 1)] and len(held(made, 1)) == 3
    assert made.append(rows(spark, ("bb", 22))) == 1 and held(made) == [("aa", 1), ("bb", 22)]
    assert made.retain(spark.createDataFrame([("aa",), ("bb",)], "hash string")) == 0
    made.compact()
    assert held(made) == [("aa", 1), ("bb", 22)] and len(made.snapshots()) == 1
    assert made.fs.listStatus(made._path("rows")).__len__() == 1


def test_values_are_made_once_a_text(spark, made):
    count = spark.sparkContext.accumulator(0)

    def make(texts):
        def run(batches):
            for b in batches:
                count.add(len(b))
                yield b.assign(v=b["text"].str.len())[["hash", "v"]]

        return texts.mapInPandas(run, SCHEMA)

    def cached(*texts):
        return sorted((r["t"], r["v"]) for r in store.cached(made, spark.createDataFrame([(t,) for t in texts], "t string"), make, "t").collect() if r["t"] is not None)

    assert cached("one", "three", "one", None) == [("one", 3), ("one", 3), ("three", 5)]
    first = count.value
    assert cached("one", "fourteen") == [("fourteen", 8), ("one", 3)]
    assert first == 2 and count.value == 3
    assert sorted(r["v"] for r in made.read().collect()) == [3, 8]
